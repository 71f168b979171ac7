"""Validators of identifiers: a struct of valid, strength and normalized for a text column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkveil.functions.binding import let
from sparkveil.functions.checksums import gstin_check_char, luhn_valid, verhoeff_valid

#: White space as web pages have it: ASCII and the Unicode spaces.
SPACE = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
DASHES = r"\-\u2010-\u2015"
# fixed values: payment handles, state codes of vehicles, letters of PAN holders
UPI_HANDLES = tuple(
    "upi ybl ibl axl apl yapl rapl paytm ptyes ptaxis pthdfc ptsbi okaxis oksbi okhdfcbank okicici okbizaxis sbi axisbank axisb icici hdfcbank kotak kmbl federal fbl aubank idfcbank yesbank barodampay cnrb pnb boi cbin unionbank uco indianbank airtel freecharge mobikwik jupiteraxis niyoicici slice tapicici timecosmos waaxis wahdfcbank waicici wasbi".split()
)
STATE_CODES = tuple("AN AP AR AS BR CG CH DD DL DN GA GJ HP HR JH JK KA KL LA LD MH ML MN MP MZ NL OD OR PB PY RJ SK TN TR TS TG UK UA UP WB".split())
PAN_HOLDERS = "ABCFGHJLPT"


def _verdict(valid: Column, strength: Column | str, normalized: Column) -> Column:
    strength = F.lit(strength) if isinstance(strength, str) else strength
    return let(F.coalesce(valid, F.lit(False)), lambda ok: F.struct(ok.alias("valid"), F.when(ok, strength).alias("strength"), F.when(ok, normalized).alias("normalized")))


def digits_of(text: Column) -> Column:
    """Without white space and dashes (ASCII and U+2010 to U+2015)."""
    return F.regexp_replace(text, rf"[{SPACE}{DASHES}]", "")


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def aadhaar(text: Column) -> Column:
    def judge(d: Column) -> Column:
        return _verdict(F.when(d.rlike("^[2-9][0-9]{11}$"), verhoeff_valid(d)), "checksum", d)

    return let(digits_of(text), judge)


def _pan_shape(t: Column) -> Column:
    return t.rlike(f"^[A-Z]{{3}}[{PAN_HOLDERS}][A-Z][0-9]{{4}}[A-Z]$")


def pan(text: Column) -> Column:
    def judge(t: Column) -> Column:
        return _verdict(_pan_shape(t), "structure", t)

    return let(F.upper(F.regexp_replace(text, rf"[{SPACE}]+", "")), judge)


def gstin(text: Column) -> Column:
    def judge(t: Column) -> Column:
        shape = t.rlike("^(0[1-9]|[12][0-9]|3[0-8])[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$") & _pan_shape(F.substring(t, 3, 10))
        return _verdict(F.when(shape, gstin_check_char(F.substring(t, 1, 14)) == F.substring(t, 15, 1)), "checksum", t)

    return let(F.upper(_trim(text)), judge)


def ifsc(text: Column) -> Column:
    def judge(t: Column) -> Column:
        return _verdict(t.rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), "structure", t)

    return let(F.upper(_trim(text)), judge)


def upi(text: Column) -> Column:
    def judge(t: Column) -> Column:
        known = F.substring_index(t, "@", -1).isin(*UPI_HANDLES)
        return _verdict(t.rlike(r"^[a-z0-9][a-z0-9._\-]{1,48}@[a-z][a-z0-9]{1,30}$"), F.when(known, "structure").otherwise("format"), t)

    return let(F.lower(_trim(text)), judge)


def card(text: Column) -> Column:
    def judge(d: Column) -> Column:
        return _verdict(F.when(d.rlike("^(?=[2-6]|81)[0-9]{13,19}$"), luhn_valid(d)), "checksum", d)

    return let(digits_of(text), judge)


def mobile(text: Column) -> Column:
    def judge(d: Column) -> Column:
        bare = F.when((F.length(d) == 12) & d.startswith("91"), F.substring(d, 3, 10)).when((F.length(d) == 11) & d.startswith("0"), F.substring(d, 2, 10)).otherwise(d)
        return let(bare, lambda b: _verdict(b.rlike("^[6-9][0-9]{9}$"), "structure", b))

    return let(digits_of(F.regexp_replace(text, r"^\+", "")), judge)


def pin_code(text: Column) -> Column:
    def judge(d: Column) -> Column:
        return _verdict(d.rlike("^[1-8][0-9]{5}$"), "structure", d)

    return let(digits_of(text), judge)


def bank_account(text: Column) -> Column:
    def judge(d: Column) -> Column:
        return _verdict(d.rlike("^[0-9]{9,18}$"), "format", d)

    return let(digits_of(text), judge)


def vehicle(text: Column) -> Column:
    def judge(t: Column) -> Column:
        state = t.rlike("^[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{4}$") & F.substring(t, 1, 2).isin(*STATE_CODES)
        return _verdict(t.rlike("^[0-9]{2}BH[0-9]{4}[A-Z]{1,2}$") | state, "structure", t)

    return let(F.regexp_replace(F.upper(_trim(text)), rf"[{SPACE}\-]", ""), judge)


def email(text: Column) -> Column:
    def judge(t: Column) -> Column:
        return _verdict(t.rlike(r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$") & (F.length(t) <= 254), "structure", F.lower(t))

    return let(_trim(text), judge)


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "AADHAAR": aadhaar, "PAN": pan, "GSTIN": gstin, "IFSC": ifsc, "UPI_VPA": upi, "CARD_NUMBER": card, "PHONE_IN": mobile,
    "PIN_CODE": pin_code, "BANK_ACCOUNT": bank_account, "VEHICLE_REG": vehicle, "EMAIL": email,
}

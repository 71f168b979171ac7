"""Recognizers of personal data in text: declarative patterns compiled to column expressions.

A span is STRUCT<cls, start, end, text, confidence, evidence, normalized, ord>; start and end count
code points. Everything stays in the JVM: matches with their places come from splitting the text at
marks set around them, validation and context are expressions, and overlaps are resolved by a fold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions import validators as V
from sparkveil.functions.binding import let

SPAN = "struct<cls:string,start:int,end:int,text:string,confidence:double,evidence:array<string>,normalized:string,ord:int>"
STRENGTH = {"checksum": 0.99, "structure": 0.85, "format": 0.5}
WINDOW = 48
#: Set around matches to split at; one that a text has itself counts as another control character, so that places stay.
_MARK, _OTHER = "\x01", "\x02"
_NOT_WORD_BEFORE, _NOT_WORD_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_S = f"[{V.SPACE}]"
_SEP = f"[{V.SPACE}{V.DASHES}]"


@dataclass(frozen=True)
class Recognizer:
    """A pattern, what validates a match, and the words near it that lift its confidence."""

    name: str
    cls: str
    pattern: str
    validate: Callable[[Column], Column] | None = None
    base: float = 0.4
    gate_only: bool = False  # the validator only drops, it does not lift the confidence
    context: tuple[str, ...] = field(default=())
    boost: float = 0.35
    trigger: str | None = None  # what every match holds and is quickly looked for; texts without it are not searched


#: Triggers begin with a digit or a mark, which are rare in texts; the patterns begin with a look back before each letter. They
#: hold what the validators ask of a match, too, as far as it is quickly told: no other match becomes a span.
_TRIGGERS = {
    "aadhaar": rf"[2-9](?<![0-9]{{2}})[0-9]{{3}}{_SEP}?[0-9]{{4}}{_SEP}?[0-9]{{4}}", "pan": rf"[0-9]{{4}}(?<=[A-Za-z]{{5}}[ ]?[0-9]{{4}})[ ]?[A-Za-z]{_NOT_WORD_AFTER}", "gstin": "[0-9]{2}[A-Za-z]{5}[0-9]{4}",
    "ifsc": "0(?<=[A-Za-z]{4}0)[A-Za-z0-9]{6}", "card": rf"[2-68](?<![0-9]{{2}})(?:[ {V.DASHES}]?[0-9]){{12}}", "email": r"@(?<=[A-Za-z0-9._%+-]@)[A-Za-z0-9.-]+\.[A-Za-z]{2}", "upi": "@(?<=[A-Za-z0-9._-]@)[A-Za-z][A-Za-z0-9]",
    "phone-in": rf"[6-9][0-9]{{4}}[{V.SPACE}-]?[0-9]{{5}}(?![0-9@])", "pincode": "[1-8](?<![0-9]{2})[0-9]{5}(?![0-9])", "bank-account": "[0-9](?<![0-9-][0-9])[0-9]{8}",
    "vehicle-reg": rf"[0-9]{{4}}(?<=[0-9][{V.SPACE}-]?[A-Za-z]{{1,3}}[{V.SPACE}-]?[0-9]{{4}}){_NOT_WORD_AFTER}|BH[{V.SPACE}-]?[0-9]{{4}}",
    "dob": r"[0-9](?<=[0-9][/\-.][01]?[0-9])[/\-.](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[/\-.][01]?[0-9][/\-.][0-9]", "amount-inr": rf"(?:₹|Rs\.?|INR){_S}?[0-9]", "spaced": "[0-9](?<![0-9] ?[0-9])(?: [0-9]){9}",
}
#: The recognizers that look for an address: their triggers begin with @. Others begin with a digit, or with a mark of these.
_ADDRESSES, _MARKS = ("email", "upi"), {"amount-inr": ("₹", "Rs", "INR"), "vehicle-reg": ("BH",)}
#: What each text with a trigger holds, as Java and Python both write it; Python leaves out texts without it before they travel.
_ROUGH = rf"@|[0-9][ {V.DASHES}]?[0-9]|0[A-Za-z0-9]{{6}}|(?:₹|Rs\.?|INR){_S}?[0-9]"
# fixed values: patterns, context words, base confidences and boosts
DEFAULT = (
    Recognizer("aadhaar", "AADHAAR", rf"(?<![0-9]{_SEP})(?<![0-9])[0-9]{{4}}{_SEP}?[0-9]{{4}}{_SEP}?[0-9]{{4}}(?!{_SEP}?[0-9])", V.aadhaar, context=("aadhaar", "aadhar", "uid", "uidai", "आधार")),
    Recognizer("pan", "PAN", rf"{_NOT_WORD_BEFORE}[A-Za-z]{{5}}[ ]?[0-9]{{4}}[ ]?[A-Za-z]{_NOT_WORD_AFTER}", V.pan, context=("pan", "permanent account")),
    Recognizer("gstin", "GSTIN", rf"{_NOT_WORD_BEFORE}[0-9]{{2}}[A-Za-z]{{5}}[0-9]{{4}}[A-Za-z][1-9A-Za-z][Zz][0-9A-Za-z]{_NOT_WORD_AFTER}", V.gstin, context=("gst", "gstin")),
    Recognizer("ifsc", "IFSC", rf"{_NOT_WORD_BEFORE}[A-Za-z]{{4}}0[A-Za-z0-9]{{6}}{_NOT_WORD_AFTER}", V.ifsc, context=("ifsc", "branch", "neft", "rtgs", "imps")),
    Recognizer("card", "CARD_NUMBER", rf"(?<![0-9])(?:[0-9][ {V.DASHES}]?){{12,18}}[0-9](?![0-9])", V.card, context=("card", "credit", "debit", "visa", "mastercard", "rupay")),
    Recognizer("email", "EMAIL", rf"{_NOT_WORD_BEFORE}(?=[A-Za-z0-9_])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_NOT_WORD_AFTER}", V.email, context=("email", "e-mail", "mail id")),
    Recognizer("upi", "UPI_VPA", rf"(?i:{_NOT_WORD_BEFORE}[a-z0-9][a-z0-9._-]{{1,48}}@[a-z][a-z0-9]{{1,30}}{_NOT_WORD_AFTER}(?!\.))", V.upi, context=("upi", "vpa", "pay", "gpay", "phonepe", "paytm")),
    Recognizer("phone-in", "PHONE_IN", rf"(?<![0-9@])(?:\+91[{V.SPACE}-]?|91[{V.SPACE}-]?|0)?[6-9][0-9]{{4}}[{V.SPACE}-]?[0-9]{{5}}(?![0-9@])", V.mobile, context=("phone", "mobile", "contact", "whatsapp", "call", "sms", "मोबाइल", "फ़ोन", "फोन", "दूरभाष")),
    Recognizer("pincode", "PIN_CODE", "(?<![0-9])[1-8][0-9]{5}(?![0-9])", V.pin_code, 0.3, True, ("pin", "pincode", "pin code", "postal", "zip", "पिन", "पिनकोड", "डाक"), 0.45),
    Recognizer("bank-account", "BANK_ACCOUNT", "(?<![0-9-])[0-9]{9,18}(?![0-9-])", V.bank_account, 0.25, True, ("account", "a/c", "acct", "acc no", "khata", "खाता", "खाता संख्या"), 0.5),
    Recognizer("vehicle-reg", "VEHICLE_REG", rf"{_NOT_WORD_BEFORE}[A-Za-z]{{2}}[{V.SPACE}-]?[0-9]{{1,2}}[{V.SPACE}-]?[A-Za-z]{{1,3}}[{V.SPACE}-]?[0-9]{{4}}{_NOT_WORD_AFTER}|{_NOT_WORD_BEFORE}[0-9]{{2}}[{V.SPACE}-]?BH[{V.SPACE}-]?[0-9]{{4}}[{V.SPACE}-]?[A-Za-z]{{1,2}}{_NOT_WORD_AFTER}", V.vehicle, 0.45, False, ("vehicle", "registration", "rc", "number plate")),
    Recognizer("dob", "DOB", rf"{_NOT_WORD_BEFORE}(?:[0-3]?[0-9][/\-.][01]?[0-9][/\-.](?:19|20)[0-9]{{2}}|(?:19|20)[0-9]{{2}}[/\-.][01]?[0-9][/\-.][0-3]?[0-9]){_NOT_WORD_AFTER}", None, 0.3, False, ("dob", "birth", "born", "janm"), 0.5),
    Recognizer("amount-inr", "AMOUNT", rf"(?:₹|Rs\.?|INR){_S}?(?:[0-9]{{1,3}}(?:,[0-9]{{2,3}})+|[0-9]{{1,7}})(?:\.[0-9]{{1,2}})?{_NOT_WORD_AFTER}", None, 0.8, False, ("balance", "amount", "total", "due", "paid", "salary"), 0.15),
)
_SPACED = "(?<![0-9])(?<![0-9] )[0-9](?: [0-9]){9,18}(?! ?[0-9])"


def _no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, pattern: str, trigger: str | None = None) -> Column:
    """ARRAY<STRUCT<i, start, end, text>> of the matches of a pattern; a text without any costs one search, of the ``trigger`` if there is one."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), f"({pattern})", f"{_MARK}$1{_MARK}")
    pieces = F.split(marked, _MARK, -1)
    none = F.array().cast("array<struct<i:int,start:int,end:int,text:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), none.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        found = F.struct(F.floor(acc["k"] / 2).cast("int").alias("i"), acc["at"].alias("start"), end.alias("end"), piece.alias("text"))
        out = F.when(F.pmod(acc["k"], F.lit(2)) == 1, F.concat(acc["out"], F.array(found))).otherwise(acc["out"])
        return F.struct(end.alias("at"), (acc["k"] + 1).alias("k"), out.alias("out"))

    some = text.rlike(pattern) if trigger is None else text.rlike(trigger) & text.rlike(pattern)
    return F.when(some, F.aggregate(pieces, start, step, lambda acc: acc["out"])).otherwise(none)


def spans_of(text: Column, spec: Recognizer, order: int) -> Column:
    """The spans of one recognizer. ``order`` is its place in the registry: it breaks ties."""

    def near(m: Column) -> Column:
        first = F.greatest(m["start"] - WINDOW, F.lit(0))
        before = F.lower(F.substring(text, first + 1, m["start"] - first))
        after = F.lower(F.substring(text, m["end"] + 1, F.lit(WINDOW)))
        return let(F.concat(before, F.lit(_MARK), after), lambda w: F.coalesce(*[F.when(w.contains(c), F.lit(c)) for c in spec.context]))

    def span(m: Column, v: Column | None, word: Column | None) -> Column:
        evidence, confidence = F.array(F.lit(f"pattern:{spec.name}")), F.lit(spec.base)
        if v is not None and not spec.gate_only:
            lift = F.when(v["strength"] == "checksum", STRENGTH["checksum"]).when(v["strength"] == "structure", STRENGTH["structure"]).otherwise(STRENGTH["format"])
            confidence = F.greatest(confidence, lift)
            evidence = F.concat(evidence, F.array(F.concat(F.lit(f"pattern:{spec.name}-"), v["strength"])))
        if word is not None:
            evidence = F.when(word.isNull(), evidence).otherwise(F.concat(evidence, F.array(F.concat(F.lit("pattern:context="), F.regexp_replace(word, "[^a-z0-9/]", "")))))
            confidence = F.when(word.isNull(), confidence).otherwise(F.least(F.lit(0.99), confidence + F.lit(spec.boost)))
        return F.struct(
            F.lit(spec.cls).alias("cls"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), confidence.cast("double").alias("confidence"),
            evidence.alias("evidence"), (F.lit(None) if v is None else v["normalized"]).cast("string").alias("normalized"), (F.lit(order * 1_000_000) + m["i"]).cast("int").alias("ord"),
        )

    found = matches(text, spec.pattern, spec.trigger or (_TRIGGERS.get(spec.name) if spec in DEFAULT else None))
    if spec.validate is not None:
        found = F.filter(F.transform(found, lambda m: F.struct(m.alias("m"), spec.validate(m["text"]).alias("v"))), lambda x: x["v"]["valid"])
    else:
        found = F.transform(found, lambda m: F.struct(m.alias("m")))

    def judge(x: Column) -> Column:
        v = x["v"] if spec.validate is not None else None
        return let(near(x["m"]), lambda w: span(x["m"], v, w)) if spec.context else span(x["m"], v, None)

    return F.transform(found, judge).cast(f"array<{SPAN}>")


def spaced_digits(text: Column, order: int) -> Column:
    """Digits set apart by single blanks that make a valid Aadhaar, card or mobile number, in that order."""

    def checks(m: Column) -> Column:
        return let(F.replace(m["text"], F.lit(" "), F.lit("")), lambda d: F.struct(m.alias("m"), V.aadhaar(d).alias("AADHAAR"), V.card(d).alias("CARD_NUMBER"), V.mobile(d).alias("PHONE_IN")))

    kinds = ("AADHAAR", "CARD_NUMBER", "PHONE_IN")

    def judge(x: Column) -> Column:
        m, cls = x["m"], F.coalesce(*[F.when(x[c]["valid"], F.lit(c)) for c in kinds])
        return F.struct(
            cls.alias("cls"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.when(cls == "PHONE_IN", 0.85).otherwise(0.99).alias("confidence"),
            F.array(F.lit("pattern:digit-spacing-evasion")).alias("evidence"), F.coalesce(*[x[c]["normalized"] for c in kinds]).alias("normalized"), (F.lit(order * 1_000_000) + m["i"]).cast("int").alias("ord"),
        )

    valid = F.filter(F.transform(matches(text, _SPACED, _TRIGGERS.get("spaced")), checks), lambda x: x["AADHAAR"]["valid"] | x["CARD_NUMBER"]["valid"] | x["PHONE_IN"]["valid"])
    return F.transform(valid, judge).cast(f"array<{SPAN}>")


def may_have(text: Column, *classes: str) -> Column:
    """Whether a text has a candidate of one of ``classes``: what no pattern of theirs matches has no span of them."""
    found = [text.rlike(r.pattern) if r.name not in _TRIGGERS else text.rlike(_TRIGGERS[r.name]) & text.rlike(r.pattern) for r in DEFAULT if r.cls in classes]
    if {"AADHAAR", "CARD_NUMBER", "PHONE_IN"} & set(classes):
        found.append(text.rlike(_TRIGGERS.get("spaced", _SPACED)) & text.rlike(_SPACED))
    return reduce(Column.__or__, found, F.lit(False))


def resolve_overlaps(spans: Column) -> Column:
    """Of overlapping spans the most confident stays, then the longest, then the first registered; in order of place."""
    ranked = F.transform(spans, lambda s: F.struct((-s["confidence"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["ord"].alias("c"), s.alias("s")))
    ordered = F.transform(F.array_sort(ranked), lambda r: r["s"])
    kept = F.aggregate(ordered, _no_spans(), lambda k, s: F.when(F.exists(k, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])), k).otherwise(F.concat(k, F.array(s))))
    placed = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("a"), s.alias("s"))))
    return F.transform(placed, lambda r: r["s"])


def _highest(spec: Recognizer) -> float:
    """The highest confidence that a span of a recognizer can have."""
    lifted = max(spec.base, *STRENGTH.values()) if spec.validate is not None and not spec.gate_only else spec.base
    return min(0.99, lifted + spec.boost) if spec.context else lifted


class Registry:
    """Recognizers in order of registration."""

    def __init__(self, specs: tuple[Recognizer, ...] = DEFAULT, spaced: bool = True, extra: tuple[Callable[[Column], Column], ...] = ()):
        self.specs, self.spaced, self.extra = specs, spaced, extra
        self._built: dict[tuple, Column] = {}

    def register(self, spec: Recognizer | Callable[[Column], Column]) -> Registry:
        """A registry with one recognizer more: a spec, or a function from text to spans (such as a pandas UDF)."""
        if isinstance(spec, Recognizer):
            return Registry((*self.specs, spec), self.spaced, self.extra)
        return Registry(self.specs, self.spaced, (*self.extra, spec))

    def candidates(self, text: Column, threshold: float = 0.0) -> Column:
        """The spans of all recognizers that can reach ``threshold``. A text is looked at once for any of them, and once for addresses; what it has no trigger of is not run."""
        named = [("spaced", lambda: spaced_digits(text, 0))] if self.spaced else []
        named += [(s.name if s in DEFAULT else None, lambda s=s, i=i: spans_of(text, s, i)) for i, s in enumerate(self.specs, 1) if _highest(s) >= threshold]
        told = [(n, f) for n, f in named if n in _TRIGGERS]
        found = [f() for n, f in named if n not in _TRIGGERS]
        for address in (False, True):
            if own := [(n, f) for n, f in told if (n in _ADDRESSES) == address]:
                any_of = lambda names: "(?:" + "|".join(_TRIGGERS[n] for n in names) + ")"
                # one kind of character is quickly looked for, and a mark that no text has costs no search
                some = text.contains("@") & text.rlike("(?=@)" + any_of([n for n, _ in own])) if address else text.rlike("(?=[0-9])" + any_of([n for n, _ in own]))
                if marked := [n for n, _ in own if n in _MARKS]:
                    some = some | (reduce(Column.__or__, [text.contains(m) for n in marked for m in _MARKS[n]]) & text.rlike("(?=[₹RIB])" + any_of(marked)))
                found.append(F.when(some, F.concat(*[f() for _, f in own])).otherwise(_no_spans()))
        found += [f(text) for f in self.extra]
        return F.concat(*found) if found else _no_spans()

    @property
    def trigger(self) -> str | None:
        """What a text must have for any recognizer to find anything; None if that is not known."""
        own = all(s in DEFAULT for s in self.specs) and not self.extra
        return "[0-9@]" if own else None

    @property
    def rough(self) -> str | None:
        """The same for single values, which are often short: more than a digit or an @."""
        return _ROUGH if self.trigger else None

    def analyze(self, text: Column | str, threshold: float = 0.5) -> Column:
        """All spans of at least ``threshold``, overlaps resolved; a null text has none.

        For a column given by name the expression is built once and used again: it has some thousand nodes.

        The threshold comes first: a span that wins an overlap is never less confident than the loser,
        so the order makes no difference, and fewer spans are compared.
        """
        if isinstance(text, str):
            key = (text, threshold, id(SparkContext._gateway))
            if key not in self._built:
                self._built[key] = self.analyze(F.col(text), threshold)
            return self._built[key]
        found = F.filter(self.candidates(F.coalesce(text, F.lit("")), threshold), lambda s: s["confidence"] >= threshold)
        if self.trigger:
            found = F.when(text.rlike(self.trigger), found).otherwise(_no_spans())
        return let(found, lambda f: F.when(F.size(f) > 1, resolve_overlaps(f)).otherwise(f))


#: The default recognizers.
STANDARD = Registry()


def each_span(df: DataFrame, *kept: str, spans: Column | str = "spans") -> DataFrame:
    """``kept`` and s, a row for each of ``spans``. A plain explode lets Spark infer a filter on its input, for which all recognizers would run a second time."""
    return df.select(*kept, F.explode_outer(spans).alias("s")).filter(F.col("s").isNotNull())


def detect(df: DataFrame, text: str = "text", registry: Registry | None = None, threshold: float = 0.5, to: str = "spans") -> DataFrame:
    """``df`` with the spans of a text column added."""
    return df.withColumn(to, (registry or STANDARD).analyze(text, threshold))

"""Small scalar rules used by policy, gate and scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude_bucket(raw: Column) -> Column:
    """The decade of an amount, as 1eK_to_1eK+1; null unless a number above 0. Digits and dots are kept, so a dot of "Rs." counts."""
    n = F.regexp_replace(raw, "[^0-9.]", "").try_cast("double")
    e = F.floor(F.log10(n)).cast("int")
    return F.when(n > 0, F.concat(F.lit("1e"), e.cast("string"), F.lit("_to_1e"), (e + 1).cast("string")))


def length_bucket(n: Column) -> Column:
    return F.when(n <= 8, "1_to_8").when(n <= 16, "8_to_16").when(n <= 32, "16_to_32").otherwise("over_32")


def safe_div(a: Column, b: Column) -> Column:
    """a / b; 1 for 0 / 0, 0 for anything else over 0."""
    return F.when(b == 0, F.when(a == 0, 1.0).otherwise(0.0)).otherwise(a.cast("double") / F.nullif(b, F.lit(0)).cast("double"))


def packet_log_key(packet_id: Column) -> Column:
    return F.concat(F.lit("pkt_"), F.substring(F.sha2(packet_id.cast("binary"), 256), 1, 16))


def file_limit(help_text: Column) -> Column:
    """Bytes that a field's help allows ("max 5 MB"), at most 20 MiB; null help gives 20 MiB."""
    most = 20 * 1024 * 1024
    pattern = r"(?i)(?:max(?:imum)?|up to|limit(?:ed to)?|under|less than)[^0-9]{0,20}([0-9]+(?:\.[0-9]+)?) ?(k|m)i?b"
    n = F.regexp_extract(help_text, pattern, 1).try_cast("double")
    unit = F.when(F.lower(F.regexp_extract(help_text, pattern, 2)) == "k", 1024.0).otherwise(1024.0 * 1024.0)
    return F.least(F.coalesce(n * unit, F.lit(float(most))), F.lit(float(most))).cast("long")


def file_accepted(name: Column, mime: Column, accept: Column) -> Column:
    """Whether a file fits an accept list: .ext, type/* or type/subtype; an empty list takes all."""
    rules = F.transform(F.split(F.lower(F.coalesce(accept, F.lit(""))), ","), lambda x: F.trim(x))
    rules = F.filter(rules, lambda x: x != "")

    def fits(rule: Column) -> Column:
        family = F.concat(F.substring_index(rule, "/", 1), F.lit("/"))
        return F.when(rule.startswith("."), F.lower(name).endswith(rule)).when(rule.endswith("/*"), F.lower(mime).startswith(family)).otherwise(F.lower(mime) == rule)

    return (F.size(rules) == 0) | F.coalesce(F.exists(rules, fits), F.lit(False))


def file_problem(name: Column, mime: Column, size: Column, accept: Column, help_text: Column) -> Column:
    """What is wrong with a chosen file: empty, too_large (for its field's help) or not_accepted; null if nothing is."""
    known = F.coalesce(size, F.lit(0))
    return F.when(known <= 0, "empty").when(known > file_limit(help_text), "too_large").when(~file_accepted(name, mime, accept), "not_accepted")


def upload_prompt(question: Column) -> Column:
    """Whether a question's text asks for a file."""
    return F.coalesce(F.regexp_replace(question, r"\s+", " ").rlike(r"(?i)\bupload\s+[0-9]+\s+(?:supported\s+)?files?\b|\b(?:file|photo|image)\s+(?:upload|attachment)\b"), F.lit(False))


def upload_action(role: Column, label: Column) -> Column:
    """Whether a button or link picks a file."""
    says = F.regexp_replace(label, r"\s+", " ").rlike(r"(?i)\b(?:add|upload|choose|select|browse|attach)(?:\s+(?:a|an|your))?(?:\s+(?:file|files|photo|image|document))?\b")
    return F.coalesce(role.isin("button", "link") & says, F.lit(False))


def upload_help(question: Column) -> Column:
    """What a question says of the number and size of files, or null."""
    q = F.regexp_replace(question, r"\s+", " ")
    count = F.nullif(F.regexp_extract(q, r"(?i)\bupload\s+[0-9]+\s+(?:supported\s+)?files?\b", 0), F.lit(""))
    most = F.nullif(F.regexp_extract(q, r"(?i)\bmax(?:imum)?(?:\s+file\s+size)?\s*[:-]?\s*[0-9]+(?:[.][0-9]+)?\s*(?:bytes?|kb|mb|gb|kib|mib|gib)\b", 0), F.lit(""))
    return F.nullif(F.concat_ws(". ", count, most), F.lit(""))


def origin_class(host: Column) -> Column:
    """The kind of site that a host name tells of; the first rule that fits."""
    h = F.lower(host)
    # fixed values: kinds of site and the host names that tell of them, in order
    rules = [
        ("government", r"\.gov\.in$|\.nic\.in$|\.gov$"), ("banking", "bank|hdfc|icici|sbi|axis|kotak|pnb|barod"), ("payments", "pay|upi|razorpay|billdesk|paytm|phonepe"),
        ("healthcare", "hospital|health|clinic|pharma|medic"), ("mail", "mail|outlook|proton"), ("social", r"facebook|instagram|twitter|x\.com|linkedin|reddit|social"),
        ("commerce", "amazon|flipkart|myntra|shop|store|cart"), ("enterprise", "jira|salesforce|zoho|workday|sap|crm"), ("education", "edu|university|college|school|nptel"),
        ("media", "news|times|hindu|ndtv|media|youtube"), ("developer", r"github|gitlab|stackoverflow|localhost|127\.0\.0\.1"),
    ]
    out = None
    for name, pattern in rules:
        out = F.when(h.rlike(pattern), name) if out is None else out.when(h.rlike(pattern), name)
    return out.otherwise("other")


def nearest_rank(values: Column, p: float) -> Column:
    """The nearest-rank percentile of an array: the element at ceil(p * n / 100) of its order."""
    n = F.size(values)
    at = F.greatest(F.ceil(F.lit(float(p)) / 100 * n).cast("int"), F.lit(1))
    return F.get(F.array_sort(values), at - 1)

"""The egress gate: packets are checked, receipted and rate-limited before they leave."""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.taxonomy import legend_key, token_class
from sparkveil.operators import ranges
from sparkveil.operators.recognizers import STANDARD, Registry, each_span
from sparkveil.operators.vault import live, scan
from sparkveil.sources.durable import durable_columns

SCHEMA_ID = "scp/1.0"
TRIPWIRE = 0.8
MOST_BYTES = 2 * 1024 * 1024
MOST_REQUEST = 4 * 1024 * 1024
SENDS, WINDOW_MS = 30, 60_000
MOST_ELEMENTS, MOST_TEXTS, MOST_HISTORY, MOST_INTENT, MOST_TEXT = 600, 200, 50, 1000, 4000

VALUE = "struct<kind:string,text:string,token:string,length:int,length_bucket:string,magnitude_bucket:string,currency:string,masked:boolean>"
STATE = "struct<filled:boolean,disabled:boolean,focused:boolean,required:boolean,checked:boolean,expanded:boolean,invalid:boolean,readonly:boolean,partially_visible:boolean>"
ELEMENT = f"struct<id:string,role:string,label:string,state:{STATE},value:{VALUE},evidence:array<string>,confidence:double,source:string,risk:string>"
PACKET = f"""packet_id string, captured_at_ms long, mode string, page_kind string,
    visual struct<present:boolean,format:string,sha256:string,data_b64:string>, elements array<{ELEMENT}>,
    legend map<string,struct<shape:string,recoverable:boolean>>, intent string, untrusted_text array<struct<src:string,text:string>>"""

_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_ULID = "^[0-9A-HJKMNP-TV-Z]{26}$"


def _issue(when: Column, path: str, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(path).alias("path"), message.alias("message")))


def packet_issues() -> Column:
    """ARRAY<STRUCT<path, message>>: what is wrong with a packet, beyond the types of PACKET."""
    v, mode = F.col("visual"), F.col("mode")
    tokens = F.filter(F.transform("elements", lambda e: F.substring_index(e["value"]["token"], "#", 1)), lambda t: t.isNotNull())
    missing = F.array_except(tokens, F.coalesce(F.map_keys("legend"), F.array().cast("array<string>")))
    rules = [
        _issue(~F.length("packet_id").between(10, 64) | F.col("packet_id").isNull(), "packet_id", "must have 10 to 64 characters"),
        _issue(F.coalesce(F.col("captured_at_ms") <= 0, F.lit(True)), "captured_at_ms", "must be positive"),
        _issue(~F.coalesce(mode.isin("shield", "fortress", "wireframe"), F.lit(False)), "policy.mode", "unknown mode"),
        _issue((mode == "wireframe") & v["present"], "visual.present", "forbidden_in_mode"),
        _issue(v["present"] & (v["format"].isNull() | v["sha256"].isNull()), "visual", "incomplete"),
        _issue(v["data_b64"].isNotNull() & ~F.coalesce(v["present"], F.lit(False)), "visual.data_b64", "without_image"),
        _issue(v["sha256"].isNotNull() & ~v["sha256"].rlike("^[0-9a-f]{64}$"), "visual.sha256", "must be 64 hex digits"),
        _issue(F.size("elements") > MOST_ELEMENTS, "elements", f"at most {MOST_ELEMENTS}"),
        _issue(F.exists("elements", lambda e: ~F.coalesce(e["id"].rlike("^e[0-9]+$"), F.lit(False))), "elements.id", "must be e and digits"),
        _issue(F.exists("elements", lambda e: F.length(e["label"]) > 300), "elements.label", "at most 300 characters"),
        _issue(F.exists("elements", lambda e: F.size(e["evidence"]) > 16), "elements.evidence", "at most 16"),
        _issue(F.exists("elements", lambda e: (e["confidence"] < 0) | (e["confidence"] > 1)), "elements.confidence", "must be from 0 to 1"),
        _issue(F.size(missing) > 0, "elements.value", F.concat(F.lit("not_in_legend:"), F.get(missing, F.lit(0)))),
        _issue(F.length("intent") > MOST_INTENT, "task.intent", f"at most {MOST_INTENT} characters"),
        _issue(F.size("untrusted_text") > MOST_TEXTS, "untrusted_text", f"at most {MOST_TEXTS}"),
        _issue(F.exists("untrusted_text", lambda t: F.length(t["text"]) > MOST_TEXT), "untrusted_text.text", f"at most {MOST_TEXT} characters"),
    ]
    return F.filter(F.array(*rules), lambda i: i.isNotNull())


def scannable() -> Column:
    """A packet as one JSON text without what can't leak: a well-formed id, times, hashes and image bytes."""
    own_id = F.when(~F.lower("packet_id").rlike(_UUID) & ~F.col("packet_id").rlike(_ULID), F.col("packet_id"))
    return F.to_json(F.struct(own_id.alias("packet_id"), "mode", "page_kind", "elements", "legend", "intent", "untrusted_text"))


def without_filled() -> Column:
    """The scannable text without values that shield mode lets through on purpose; for the vault scan."""
    kept = F.transform("elements", lambda e: e.withField("value", F.when(e["value"]["kind"] == "filled", e["value"].withField("text", F.lit(None).cast("string"))).otherwise(e["value"])))
    elements = F.when(F.col("mode") == "shield", kept).otherwise(F.col("elements"))
    return F.to_json(F.struct("mode", "page_kind", elements.alias("elements"), "legend", "intent", "untrusted_text"))


def serialized() -> Column:
    return F.to_json(F.struct("packet_id", "captured_at_ms", "mode", "page_kind", "visual", "elements", "legend", "intent", "untrusted_text"))


def gate(packets: DataFrame, vault: DataFrame | None = None, registry: Registry | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``packets`` (schema PACKET, session and sent_at_ms) with the gate's verdict, before the rate limit.

    Adds issues, reasons (all that fail of tripwire, vault, visual and size; schema issues alone where
    there are any), bytes, payload_sha256, legend_counts and passed. Nothing passes by default: a null packet fails.
    """
    registry = registry or STANDARD
    rows = packets.withColumn("issues", packet_issues()).withColumn("_scan", scannable()).withColumn("_payload", serialized())
    v = F.col("visual")
    wrong = v["data_b64"].isNotNull() & ~F.sha2(v["data_b64"].cast("binary"), 256).eqNullSafe(v["sha256"])
    classes = F.filter(F.transform("elements", lambda e: token_class(e["value"]["token"])), lambda c: c.isNotNull())
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(classes)), lambda c: F.struct(legend_key(c), F.size(F.filter(classes, lambda x: x == c)))))
    rows = rows.withColumns({"_tripped": F.size(registry.analyze("_scan", TRIPWIRE)) > 0, "_wrong": F.coalesce(wrong, F.lit(False)), "bytes": F.octet_length("_payload"), "payload_sha256": F.sha2(F.col("_payload").cast("binary"), 256)})
    rows = rows.withColumn("legend_counts", counts).drop("_scan", "_payload")
    leaked = F.lit(False)
    if vault is not None:  # all that a packet tells by itself is known before rows meet the vault: they are written once, without their JSON texts
        rows = durable_columns(rows.withColumn("_row", F.monotonically_increasing_id()))
        met = scan(rows.select("session", "_row", without_filled().alias("_bare")), live(vault), payload="_bare", kept=["_row"]).select("_row").distinct()
        rows = rows.join(met.withColumn("_leaked", F.lit(True)), "_row", "left")
        leaked = F.coalesce("_leaked", F.lit(False))
    found = F.array(F.when(F.col("_tripped"), "tripwire"), F.when(leaked, "vault"), F.when(F.col("_wrong"), "visual"), F.when(F.col("bytes") > most_bytes, "size"))
    reasons = F.when(F.size("issues") > 0, F.array(F.lit("schema"))).otherwise(F.filter(found, lambda r: r.isNotNull()))
    rows = rows.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)
    told = [*packets.columns, "issues", "reasons", "bytes", "payload_sha256", "legend_counts", "passed"]
    return rows.select(*dict.fromkeys(told))


def rate_limit(sends: DataFrame, session: str = "session", at: str = "sent_at_ms", order: str | tuple[str, ...] = "seq", most: int = SENDS, window_ms: int = WINDOW_MS) -> DataFrame:
    """``sends`` (session, at, order) with allowed: at most ``most`` allowed ones in any ``window_ms``.

    Refused attempts use nothing up, so each decision depends on those before. Where a session pauses for ``window_ms`` or longer
    nothing counts any more, so it is cut there and the parts are walked on their own; the state is the times still inside the window,
    at most ``most``. Each row is judged once, repeated ones too; a null session is one session, a row without a time is not allowed.
    """
    order = (order,) if isinstance(order, str) else order

    def step(state: dict, time: int | None) -> tuple:
        if time is None:
            return (False,)
        live = state.setdefault("live", deque())
        while live and live[0] <= time - window_ms:
            live.popleft()
        allowed = len(live) < most
        if allowed:
            live.append(time)
        return (allowed,)

    rows = ranges.dealt(sends.withColumn("_time", F.col(at).cast("long")), session, ["_time", *order])
    cut = ranges.islands(rows, session, "_time", window_ms)
    return ranges.in_order(cut, "island", [ranges.AT], ["_time"], "allowed boolean", step).drop("_time", "island", ranges.PART, ranges.AT)


def outcomes(gated: DataFrame, most: int = SENDS, window_ms: int = WINDOW_MS) -> DataFrame:
    """Gated packets with outcome sent or blocked, one row for each attempt: those that pass all checks go to the rate limit."""
    gated = durable_columns(gated.withColumn("_attempt", F.monotonically_increasing_id()))
    limited = rate_limit(gated.filter("passed").select("session", "packet_id", "_attempt", "sent_at_ms"), order=("packet_id", "_attempt"), most=most, window_ms=window_ms)
    rows = gated.join(limited.select("_attempt", "allowed"), "_attempt", "left")
    reasons = F.when(F.col("allowed") == F.lit(False), F.array(F.lit("rate_limit"))).otherwise(F.col("reasons"))
    return rows.withColumn("reasons", reasons).withColumn("outcome", F.when(F.col("passed") & F.col("allowed"), "sent").otherwise("blocked")).drop("allowed", "_attempt")


def receipts(decided: DataFrame) -> DataFrame:
    """What is recorded of each packet, sent or blocked; no payload."""
    v = F.col("visual")
    return decided.select("session", "packet_id", "sent_at_ms", "mode", "outcome", "reasons", "bytes", "payload_sha256", F.coalesce(v["present"], F.lit(False)).alias("image"), "legend_counts")


def audit(decided: DataFrame) -> DataFrame:
    """One event for each stage that a packet came to, in order."""
    stages = ["schema", "tripwire", "vault", "visual", "size", "rate_limit"]
    failed = lambda s: F.array_contains("reasons", s)
    reached = [F.lit(True), *[~failed("schema")] * 4, F.size(F.array_except("reasons", F.array(F.lit("rate_limit")))) == 0]
    events = F.filter(F.array(*[F.when(r, F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), (~failed(s)).alias("ok"))) for i, (s, r) in enumerate(zip(stages, reached, strict=True))]), lambda e: e.isNotNull())
    return decided.select("session", "packet_id", F.explode(events).alias("e")).select("session", "packet_id", "e.*")


def rescan(packets: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Spans at the tripwire's threshold in each text of a packet by itself: packet_id, path, cls."""
    leaves = [
        packets.select("packet_id", F.lit("task.intent").alias("path"), F.col("intent").alias("text")),
        packets.select("packet_id", F.posexplode("untrusted_text").alias("i", "t")).select("packet_id", F.concat(F.lit("untrusted_text["), F.col("i"), F.lit("].text")).alias("path"), F.col("t.text").alias("text")),
        packets.select("packet_id", F.posexplode("elements").alias("i", "e")).select(
            "packet_id", F.explode(F.array(*[F.struct(F.concat(F.lit("elements["), F.col("i"), F.lit(f"].{n}")).alias("path"), c.alias("text")) for n, c in (("label", F.col("e.label")), ("value.text", F.col("e.value.text")), ("value.token", F.col("e.value.token")))])).alias("l")
        ).select("packet_id", "l.path", "l.text"),
    ]
    every = reduce(DataFrame.unionByName, leaves).filter("text is not null")
    found = (registry or STANDARD).analyze("text", TRIPWIRE)
    return each_span(every, "packet_id", "path", spans=found).select("packet_id", "path", F.col("s.cls").alias("cls"))

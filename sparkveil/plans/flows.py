"""Queries over attempts, sessions and areas in which the hard cases occur: repeated ids, null and hot sessions, refusals of every kind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.functions import checksums
from sparkveil.functions.geometry import box
from sparkveil.operators import gate, intake, media, percentiles, policy, recognizers, vault, wire
from sparkveil.plans.catalogue import _D, _INVERSE, _LUHN, _P, _VERHOEFF, _stream, query
from sparkveil.plans.exchange import _duck, _view
from sparkveil.sources.durable import shared_folder
from sparkveil.sources.synthetic import table

# ---------------------------------------------------------------- the gate

#: An attempt for each order. Ids repeat, sessions may be null; some hold an address, a value of their own or another session's vault, a wrong hash, or too much.
_ATTEMPTS = """SELECT o_orderkey AS k, concat('packet-', lpad(CAST(o_orderkey - o_orderkey % 3 AS {s}), 12, '0')) AS packet_id, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey % 40 END AS session, o_orderkey * 100 AS sent_at_ms,
    concat('fill in', CASE WHEN o_orderkey % 11 = 0 THEN ' for a.b@mail.example.com' ELSE '' END, CASE o_orderkey % 7 WHEN 0 THEN concat(' held-', CAST(o_custkey % 40 AS {s}), '-value') WHEN 1 THEN ' held-77-value' ELSE '' END) AS intent,
    o_orderkey % 4 = 0 AS image, o_orderkey % 12 = 4 AS wrong, o_orderkey % 15 = 2 AS large FROM {t}"""
_HELD = "SELECT CASE WHEN k < 40 THEN k END AS session, concat('held-', CAST(CASE WHEN k < 40 THEN k ELSE 0 END AS {s}), '-value') AS value FROM (SELECT DISTINCT o_custkey % 41 AS k FROM {t})"
_BYTES, _SENDS, _WINDOW = 900, 3, 60_000


def _attempts(spark: SparkSession, sf_dir: str, costly: bool = True) -> DataFrame:
    rows = _view(spark, sf_dir, _ATTEMPTS, "orders", costly=costly)
    sha = F.when(F.col("wrong"), F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2(F.lit("x").cast("binary"), 256))
    visual = F.struct(F.col("image").alias("present"), F.when(F.col("image"), "image/png").alias("format"), F.when(F.col("image"), sha).alias("sha256"), F.when(F.col("image"), "x").alias("data_b64"))
    texts = F.when(F.col("large"), F.array(F.struct(F.lit("e1").alias("src"), F.repeat(F.lit("z "), F.lit(_BYTES // 2)).alias("text")))).otherwise(F.array())
    return rows.select(
        "k", "packet_id", F.lit(1).cast("long").alias("captured_at_ms"), F.lit("fortress").alias("mode"), F.lit("other").alias("page_kind"), visual.alias("visual"), F.array().cast(f"array<{gate.ELEMENT}>").alias("elements"),
        F.create_map().cast("map<string,struct<shape:string,recoverable:boolean>>").alias("legend"), "intent", texts.cast("array<struct<src:string,text:string>>").alias("untrusted_text"), "session", "sent_at_ms",
    )


# a null session's vault is its own: in ``_HELD`` its value is held-0-value
_DUCK_GATED = f"""WITH RECURSIVE a AS (SELECT *, coalesce(session, -1) AS s FROM ({_duck(_ATTEMPTS, 'orders')})),
    c AS (SELECT *, list_filter([CASE WHEN k % 11 = 0 THEN 'tripwire' END, CASE WHEN k % 7 = 0 AND (session IS NOT NULL OR contains(intent, 'held-0-value')) THEN 'vault' END, CASE WHEN image AND wrong THEN 'visual' END, CASE WHEN large THEN 'size' END], lambda r: r IS NOT NULL) AS reasons FROM a),
    e AS (SELECT s, k, sent_at_ms AS t0, row_number() OVER (PARTITION BY s ORDER BY sent_at_ms) AS r FROM c WHERE len(reasons) = 0),
    w AS (SELECT s, k, r, TRUE AS allowed, [t0] AS live FROM e WHERE r = 1
    UNION ALL SELECT s, k, r, len(kept) < {_SENDS}, CASE WHEN len(kept) < {_SENDS} THEN list_append(kept, t0) ELSE kept END FROM (SELECT e.*, list_filter(w.live, lambda t: t > e.t0 - {_WINDOW}) AS kept FROM w JOIN e ON e.s = w.s AND e.r = w.r + 1))"""


@query(
    f"""{_DUCK_GATED} SELECT c.k, c.session, c.packet_id, CASE WHEN len(reasons) = 0 AND w.allowed THEN 'sent' ELSE 'blocked' END AS outcome, CASE WHEN len(reasons) = 0 AND NOT w.allowed THEN 'rate_limit' ELSE array_to_string(reasons, ',') END AS reasons
    FROM c LEFT JOIN w USING (k)"""
)
def gate_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with a vault: each attempt has one outcome, by all of its checks and the rate limit."""
    gated = gate.gate(_attempts(spark, sf_dir), vault=_view(spark, sf_dir, _HELD, "orders"), most_bytes=_BYTES)
    return gate.outcomes(gated, most=_SENDS, window_ms=_WINDOW).select("k", "session", "packet_id", "outcome", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""{_DUCK_GATED}, d AS (SELECT c.*, w.allowed FROM c LEFT JOIN w USING (k)), g AS (SELECT k, unnest(range(0, 6))::INT AS step, reasons, allowed FROM d)
    SELECT stage, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed FROM (SELECT (['schema', 'tripwire', 'vault', 'visual', 'size', 'rate_limit'])[step + 1] AS stage,
    CASE step WHEN 5 THEN allowed ELSE NOT list_contains(reasons, (['schema', 'tripwire', 'vault', 'visual', 'size'])[step + 1]) END AS ok FROM g WHERE step < 5 OR len(reasons) = 0) GROUP BY stage"""
)
def gate_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many attempts each stage of the gate passed and stopped."""
    gated = gate.gate(_attempts(spark, sf_dir), vault=_view(spark, sf_dir, _HELD, "orders"), most_bytes=_BYTES)
    events = gate.audit(gate.outcomes(gated, most=_SENDS, window_ms=_WINDOW))
    return events.groupBy("stage").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


#: Plans that hide a value where the packet's id stands, deeper, in a key, escaped, or in a second id.
_SMUGGLED = r"""SELECT o_orderkey AS plan_id, concat('packet-', lpad(CAST(o_orderkey AS {s}), 12, '0')) AS packet_id, concat('{"schema":"plan/1.0","packet_id":"packet-', lpad(CAST(o_orderkey AS {s}), 12, '0'), '","reasoning_summary":"go on","steps":[{"action":"scroll","scroll":{"direction":"down","amount":"page"},"value":{"kind":"literal","text":"',
    CASE o_orderkey % 8 WHEN 1 THEN 'a.b@mail.example.com' WHEN 4 THEN 'a.b@mail.example.com' ELSE 'a' END, '"', CASE o_orderkey % 8 WHEN 2 THEN ',"packet_id":"mail a.b@mail.example.com"' WHEN 3 THEN ',"packet_id":"held-value"' WHEN 5 THEN ',"a.b@mail.example.com":1' WHEN 6 THEN ',"packet_id":"packet-000000000000"' ELSE '' END,
    '},"requires_confirmation":false}],"needs_more_context":false,"confidence":0.5}') AS raw FROM {t}"""


@query(f"SELECT plan_id, CASE WHEN plan_id % 8 IN (1, 2, 3, 4, 5) THEN 'blocked' ELSE 'pass' END AS outcome, CASE WHEN plan_id % 8 IN (1, 2, 4, 5) THEN 'tripwire' WHEN plan_id % 8 = 3 THEN 'vault' ELSE '' END AS reasons FROM ({_duck(_SMUGGLED, 'orders')})")
def answer_smuggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planners' answers that hide private values: only the packet's own id, at the top, is not read."""
    packets = _attempts(spark, sf_dir, costly=False).withColumn("packet_id", F.concat(F.lit("packet-"), F.lpad(F.col("k").cast("string"), 12, "0"))).withColumn("session", F.lit(1))
    held = _view(spark, sf_dir, "SELECT DISTINCT 1 AS session, 'held-value' AS value FROM {t}", "orders")
    return wire.guard_answers(_view(spark, sf_dir, _SMUGGLED, "orders", costly=True), packets, vault=held).select("plan_id", "outcome", F.array_join("reasons", ",").alias("reasons"))


# ---------------------------------------------------------------- percentiles

_GROUPS = "SELECT CASE WHEN l_linenumber < 6 THEN 'most' WHEN l_linenumber = 6 THEN l_returnflag END AS grp, l_extendedprice FROM lineitem"


@query(f"SELECT grp, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, max(l_extendedprice) AS p100, count(l_extendedprice) AS n FROM ({_GROUPS}) GROUP BY grp")
def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of groups, one of which holds most rows: intervals are narrowed until 500 values are left to sort."""
    grp = F.when(F.col("l_linenumber") < 6, "most").when(F.col("l_linenumber") == 6, F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").select(grp.alias("grp"), "l_extendedprice")
    return percentiles.nearest_ranks(rows, ["grp"], "l_extendedprice", {"p50": 50, "p95": 95, "p100": 100}, small=500)


@query("SELECT sum(p50) AS p50_sum, count(*) AS stages, sum(p50) <= 175 AS within FROM (SELECT event_type, round(quantile_disc(value, 0.5), 6) AS p50 FROM events GROUP BY event_type)")
def latency_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the stages' medians, and whether it is within the frame's target."""
    found = percentiles.nearest_ranks(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 50}).select(F.round("p50", 6).alias("p50"))
    return found.agg(F.sum("p50").alias("p50_sum"), F.count("*").alias("stages")).withColumn("within", F.col("p50_sum") <= 175)


# ---------------------------------------------------------------- pages of many lines

@query("SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN 'too_many_lines' ELSE 'selective' END AS treatment, (CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 9 ELSE 1 END)::BIGINT AS n_masks, (CASE p_partkey % 3 WHEN 0 THEN 640 * 480 WHEN 1 THEN 9 * 200 ELSE 200 END)::DOUBLE AS area FROM part WHERE p_size < 3")
def media_long_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with more lines than are read are masked whole: nothing on them stays visible."""
    sheets = table(spark, sf_dir, "part").filter("p_size < 3").select(F.col("p_partkey").alias("page_id"), F.lit("image").alias("kind"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(False).alias("hint"))
    lines = sheets.withColumn("i", F.explode(F.sequence(F.lit(1), F.when(F.col("page_id") % 3 == 0, 450).when(F.col("page_id") % 3 == 1, 400).otherwise(50))))
    text = F.when(F.col("i") % 45 == 7, F.concat(F.lit("mail a"), F.col("i"), F.lit("@mail.example.com"))).otherwise("plain words")
    texts = lines.select("page_id", F.col("i").cast("int").alias("pos"), text.alias("text"), box(F.lit(10), F.col("i"), F.lit(200), F.lit(1)).alias("box"))
    none = texts.limit(0).select("page_id", "pos", "box")
    found = intake.inspect_pages(sheets, texts, none, none)
    masks = found["masks"].groupBy("page_id").agg(F.count("*").alias("n_masks"), F.sum(F.col("box.w") * F.col("box.h")).alias("area"))
    return found["report"].select("page_id", "treatment").join(masks.hint("merge"), "page_id")


# ---------------------------------------------------------------- sessions with several ends

_KINDS = "CASE event_id % 5 WHEN 2 THEN 'navigated' WHEN 3 THEN 'activated' WHEN 4 THEN 'closed' ELSE 'run' END"
_PANEL = f"SELECT user_id, event_id, ts, {_KINDS} AS kind, event_id % 3 AS tab, CASE WHEN event_id % 7 <> 6 THEN event_type END AS origin, CASE WHEN event_id % 5 < 2 THEN concat('task', CAST(event_id % 4 AS {{s}})) END AS task FROM {{t}}"
_ENDS = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM ({_duck(_PANEL, 'events')})),
    w AS (SELECT user_id, event_id, r, CASE WHEN kind = 'run' THEN 'new_task' END AS ended, CASE WHEN kind = 'run' THEN tab END AS s_tab, CASE WHEN kind = 'run' THEN origin END AS s_origin, CASE WHEN kind = 'run' THEN task END AS s_task FROM e WHERE r = 1
    UNION ALL SELECT user_id, event_id, r, why, CASE WHEN kind = 'run' OR (kind = 'activated' AND why IS NOT NULL) THEN tab WHEN why = 'tab_closed' THEN NULL ELSE s_tab END, CASE WHEN kind = 'run' THEN origin WHEN why IS NOT NULL THEN NULL ELSE s_origin END, CASE WHEN kind = 'run' THEN task WHEN why IS NOT NULL THEN NULL ELSE s_task END
    FROM (SELECT e.*, s_tab, s_origin, s_task, CASE kind WHEN 'run' THEN CASE WHEN s_task IS DISTINCT FROM e.task THEN 'new_task' WHEN s_tab IS NOT NULL AND s_tab IS DISTINCT FROM e.tab THEN 'tab_switched' WHEN s_origin IS NOT NULL AND s_origin IS DISTINCT FROM e.origin THEN 'origin_changed' END
        WHEN 'closed' THEN CASE WHEN s_tab = e.tab THEN 'tab_closed' END WHEN 'activated' THEN CASE WHEN s_tab <> e.tab THEN 'tab_switched' END
        ELSE CASE WHEN s_tab = e.tab AND (e.origin IS NULL OR s_origin IS NULL OR s_origin <> e.origin) THEN 'origin_changed' END END AS why FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1))
    SELECT user_id, event_id, ended, sum((ended IS NOT NULL)::INT) OVER (PARTITION BY user_id ORDER BY r)::BIGINT AS session_no FROM w"""


@query(_ENDS)
def session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where sessions end: new tasks, other or closed tabs, other origins."""
    return vault.session_ends(_view(spark, sf_dir, _PANEL, "events")).select("user_id", "event_id", "ended", "session_no")


def _panel_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir)
    task = F.when(F.col("event_id") % 5 < 2, F.concat(F.lit("task"), (F.col("event_id") % 4).cast("string")))
    return rows.select("user_id", "event_id", "ts", F.expr(_KINDS).alias("kind"), (F.col("event_id") % 3).alias("tab"), F.when(F.col("event_id") % 7 != 6, F.col("event_type")).alias("origin"), task.alias("task"))


@query(_ENDS)
def stream_session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream."""
    from sparkveil.streaming import stateful

    return stateful.run_once(stateful.session_ends(_panel_stream(spark, sf_dir)), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- receipts before packets


@query("SELECT 'packet-' || lpad(event_id::VARCHAR, 12, '0') AS packet_id, CASE WHEN event_id % 3 = 0 THEN 'blocked' ELSE 'sent' END AS outcome, event_id % 3 <> 0 AS packet FROM events")
def stream_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of a stream of decided packets, and whether the packet is there, too."""
    from sparkveil.streaming import receipts

    k = F.col("event_id")
    visual = F.struct(F.lit(False).alias("present"), *[F.lit(None).cast("string").alias(c) for c in ("format", "sha256", "data_b64")])
    decided = _stream(spark, sf_dir).select(
        F.col("user_id").alias("session"), F.concat(F.lit("packet-"), F.lpad(k.cast("string"), 12, "0")).alias("packet_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("sent_at_ms"), F.lit("shield").alias("mode"), visual.alias("visual"),
        F.when(k % 3 == 0, "blocked").otherwise("sent").alias("outcome"), F.when(k % 3 == 0, F.array(F.lit("tripwire"))).otherwise(F.array().cast("array<string>")).alias("reasons"), F.length("event_type").alias("bytes"), F.sha2("event_type", 256).alias("payload_sha256"),
        F.create_map().cast("map<string,int>").alias("legend_counts"),
    )
    folder = f"{shared_folder(spark)}/receipts-{uuid.uuid4().hex}"
    run = receipts.start(decided, folder, f"{folder}/checkpoint")
    run.awaitTermination()
    if run.exception() is not None:
        raise RuntimeError(str(run.exception()))
    packets = receipts.sent_packets(spark, folder).select("packet_id", F.lit(True).alias("packet"))
    return receipts.kept_receipts(spark, folder).join(packets, "packet_id", "left").select("packet_id", "outcome", F.coalesce("packet", F.lit(False)).alias("packet"))


# ---------------------------------------------------------------- a cache of assets


@query(
    """SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 6 = 0 OR (doc_id % 6 = 4 AND text = 'old') THEN 'hit' WHEN doc_id % 6 = 3 THEN 'missing' WHEN doc_id % 6 IN (2, 5) THEN 'mismatch' WHEN doc_id % 6 = 4 THEN 'refetched' ELSE 'fetched' END AS status,
    CASE WHEN doc_id % 6 IN (0, 1, 4) THEN sha256(text) END AS content_sha256 FROM documents"""
)
def asset_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets from a cache that is whole, empty or corrupt, and a source that is right, wrong or empty."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), (F.col("doc_id") % 6).alias("k"), F.col("text").cast("binary").alias("content"))
    wanted = docs.select("name", F.sha2("content", 256).alias("sha256"))
    cache = docs.filter("k in (0, 4, 5)").select("name", F.when(F.col("k") == 0, F.col("content")).otherwise(F.lit("old").cast("binary")).alias("content"))
    source = docs.filter("k <> 3").select("name", F.when(F.col("k").isin(2, 5), F.concat("content", F.lit("!").cast("binary"))).otherwise(F.col("content")).alias("content"))
    return media.read_through(wanted, cache, source).select("name", "status", F.sha2("content", 256).alias("content_sha256"))


# ---------------------------------------------------------------- values split over regions

_SPLIT = "SELECT c_custkey, concat('4', lpad(CAST(c_custkey * 7919 % 1000003 AS {s}), 7, '3'), lpad(CAST(c_custkey % 9973 AS {s}), 8, '2')) AS d FROM {t}"
_VALID = f"SELECT c_custkey, d FROM ({_duck(_SPLIT, 'customer')}) WHERE {_LUHN.format(d='d')}"


@query(f"SELECT c_custkey::VARCHAR AS page_id, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['e2', 'e3'] ELSE ['e2', 'e3', 'e4'] END) AS id, 'CARD_NUMBER' AS cross_class, d AS cross_value FROM ({_VALID})")
def split_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card numbers that stand in two or three regions of one line."""
    cards = _view(spark, sf_dir, _SPLIT, "customer").filter(checksums.luhn_valid(F.col("d")))
    d, two = F.col("d"), F.col("c_custkey") % 2 == 0
    four = lambda i: F.substring(d, i, 4)
    halves = F.concat_ws(" ", four(1), four(5)), F.concat_ws(" ", four(9), four(13))
    texts = F.when(two, F.array(F.lit("Card number"), halves[0], halves[1], F.lit("thanks"))).otherwise(F.array(F.lit("Card number"), halves[0], four(9), four(13)))
    rows = cards.select(F.col("c_custkey").cast("string").alias("page_id"), F.posexplode(texts).alias("i", "raw_text"))
    below = (F.col("i") == 3) & F.col("raw_text").rlike("^t")
    placed = rows.select("page_id", (F.col("i") + 1).cast("int").alias("pos"), F.concat(F.lit("e"), F.col("i") + 1).alias("id"), "raw_text", F.lit(None).cast("string").alias("raw_value"), box(F.col("i") * 100, F.when(below, 200).otherwise(10), F.lit(90), F.lit(20)).alias("box"))
    return policy.cross_region(placed, "fortress")


# ---------------------------------------------------------------- spans of every recognizer

#: A value for each order, of thirteen kinds by its key; some are no valid ones. Check digits are each engine's own.
_STEMS = "SELECT o_orderkey AS k, o_orderkey % 13 AS kind, o_custkey % 2 = 0 AS told, o_custkey AS c, concat('2', lpad(CAST(o_orderkey % 1000000 AS {s}), 6, '0'), lpad(CAST(o_custkey % 10000 AS {s}), 4, '0')) AS stem, concat('27AAPFU', lpad(CAST(o_custkey % 10000 AS {s}), 4, '0'), 'F1Z') AS company FROM {t}"
_VALUES = """SELECT *, CASE kind WHEN 0 THEN concat(substr(stem, 1, 4), ' ', substr(stem, 5, 4), ' ', substr(stem, 9, 3), digit) WHEN 1 THEN concat(substr(stem, 1, 4), ' ', substr(stem, 5, 4), ' ', substr(stem, 9, 3), wrong) WHEN 2 THEN concat('ABC', CASE WHEN c % 4 = 2 THEN 'X' ELSE 'P' END, 'E', lpad(CAST(k % 10000 AS {s}), 4, '0'), 'F')
    WHEN 3 THEN concat(company, sign) WHEN 4 THEN concat('SBIN', CASE WHEN c % 3 = 1 THEN '1' ELSE '0' END, lpad(CAST(k % 1000000 AS {s}), 6, '0')) WHEN 5 THEN concat('user', CAST(c AS {s}), CASE WHEN c % 3 = 0 THEN '@nobank' ELSE '@okicici' END)
    WHEN 6 THEN concat('9', lpad(CAST(c % 10000 AS {s}), 4, '0'), ' ', lpad(CAST(k % 100000 AS {s}), 5, '0')) WHEN 7 THEN CAST(100000 + k * 7 % 800000 AS {s}) WHEN 8 THEN CAST(10000000000 + k * 31 AS {s}) WHEN 9 THEN concat(CASE WHEN c % 3 = 1 THEN 'ZZ' ELSE 'KA' END, ' 0', CAST(k % 10 AS {s}), ' AB ', lpad(CAST(c % 10000 AS {s}), 4, '0'))
    WHEN 10 THEN concat('0', CAST(1 + k % 9 AS {s}), '/05/19', CAST(60 + k % 40 AS {s})) WHEN 11 THEN concat('Rs. ', CAST(1 + c % 99999 AS {s})) ELSE regexp_replace(concat(stem, digit), '([0-9])', '{one} '{all}) END AS value,
    CASE WHEN NOT told THEN 'note' ELSE CASE kind WHEN 2 THEN 'pan' WHEN 3 THEN 'gstin' WHEN 4 THEN 'ifsc' WHEN 5 THEN 'upi' WHEN 6 THEN 'phone' WHEN 7 THEN 'pincode' WHEN 8 THEN 'account' WHEN 9 THEN 'vehicle' WHEN 10 THEN 'birth' WHEN 11 THEN 'total' ELSE 'aadhaar' END END AS word FROM {t}"""
_DIGITS = f"""SELECT *, d::VARCHAR AS digit, ((d + 1) % 10)::VARCHAR AS wrong, ('{checksums.BASE36}')[((36 - total % 36) % 36 + 1)::INT] AS sign FROM (SELECT *, ({_INVERSE})[{_VERHOEFF.format(d='stem', p=_P, t=_D, s=1)} + 1]::INT AS d,
    list_sum(list_transform(range(0, 14), lambda i: (strpos('{checksums.BASE36}', company[14 - i]) - 1) * (2 - i % 2) // 36 + (strpos('{checksums.BASE36}', company[14 - i]) - 1) * (2 - i % 2) % 36)) AS total FROM ({_duck(_STEMS, 'orders')}))"""


@query(
    f"""WITH v AS ({_VALUES.replace('{s}', 'VARCHAR').replace('{t}', '(' + _DIGITS + ')').replace('{one}', chr(92) + '1').replace('{all}', ", 'g'")}),
    e AS (SELECT k, kind, told, length(word) + 2 AS start, length(word) + 2 + length(trim(value)) AS "end", c, (['AADHAAR', NULL, 'PAN', 'GSTIN', 'IFSC', 'UPI_VPA', 'PHONE_IN', 'PIN_CODE', 'BANK_ACCOUNT', 'VEHICLE_REG', 'DOB', 'AMOUNT', 'AADHAAR'])[kind + 1] AS cls,
    CASE WHEN kind IN (0, 3, 12) THEN 0.99 WHEN kind IN (2, 4, 6, 9) OR (kind = 5 AND c % 3 <> 0) THEN CASE WHEN told THEN 0.99 ELSE 0.85 END WHEN kind = 5 THEN CASE WHEN told THEN 0.85 ELSE 0.5 END WHEN kind = 7 THEN CASE WHEN told THEN 0.75 ELSE 0.3 END WHEN kind = 8 THEN CASE WHEN told THEN 0.75 ELSE 0.25 END
    WHEN kind = 10 THEN CASE WHEN told THEN 0.8 ELSE 0.3 END WHEN kind = 11 THEN CASE WHEN told THEN 0.95 ELSE 0.8 END END::DOUBLE AS confidence FROM v)
    SELECT k, cls, start::INT AS start, "end"::INT AS "end", confidence FROM e WHERE cls IS NOT NULL AND confidence >= 0.3 AND NOT (kind = 2 AND c % 4 = 2) AND NOT (kind = 4 AND c % 3 = 1) AND NOT (kind = 9 AND c % 3 = 1)"""
)
def synthetic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of identifiers of every kind, with and without a word of their context near, valid and not."""
    stems = _view(spark, sf_dir, _STEMS, "orders", costly=True)
    digit = checksums.verhoeff_digit(F.col("stem"))
    full = stems.withColumn("digit", digit.cast("string")).withColumn("wrong", ((digit + 1) % 10).cast("string")).withColumn("sign", checksums.gstin_check_char(F.col("company")))
    values = spark.sql(_VALUES.replace("{s}", "STRING").replace("{one}", "$1").replace("{all}", "").replace("{t}", "{rows}"), rows=full)
    texts = values.select("k", F.concat("word", F.lit(": "), F.trim("value"), F.lit(" end.")).alias("text"))
    found = recognizers.detect(texts, threshold=0.3)
    return recognizers.each_span(found, "k").select("k", "s.cls", "s.start", "s.end", F.round("s.confidence", 4).alias("confidence"))

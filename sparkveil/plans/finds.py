"""Queries that reach what a session needs beside detection: re-grounding, lost answers, files, codes, exports, and a page's way to its request."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.functions import geometry, scalars, validators
from sparkveil.functions.geometry import box
from sparkveil.operators import grounding, intake, media, perception, policy, prompts, vault, wire
from sparkveil.plans.catalogue import _DUCK_VAULT, _FORMS, _duck, _minted, _stream, query
from sparkveil.plans.exchange import _view
from sparkveil.sources import export, synthetic
from sparkveil.sources.durable import durable, shared_folder
from sparkveil.sources.synthetic import table, view

# ---------------------------------------------------------------- finding again

#: Elements as they were seen, and what has become of each, by the number of its supplier.
_SEEN = f"SELECT l_orderkey AS page_id, concat('e', CAST(l_linenumber AS STRING)) AS id, l_suppkey % 9 AS fate, l_linenumber AS n FROM {synthetic.LINES}"
_FATES = {1: "element no longer in the document", 2: "element role changed since capture", 3: "element moved 50px since capture", 4: "element size changed since capture", 5: "element label changed since capture", 6: "element is no longer visible", 7: "element disabled state changed since capture", 8: "element readonly state changed since capture"}


@query("SELECT page_id, id, CASE fate " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _FATES.items()) + f" END AS problem FROM ({_duck(_SEEN)})")
def regrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each element of a snapshot is still the one that was seen."""
    seen = view(spark, sf_dir, _SEEN, "lineitem")
    fate = F.col("fate")
    at = lambda moved, wider: box(F.lit(10) + F.when(moved, 30).otherwise(0), F.col("n") * 40 + F.when(moved, 40).otherwise(0), F.lit(100) + F.when(wider, 60).otherwise(0), F.lit(20))
    never = F.lit(False)
    targets = seen.select("page_id", "id", F.lit("textbox").alias("role"), F.concat(F.lit("Name "), "id").alias("label"), at(never, never).alias("box"), never.alias("disabled"), never.alias("readonly"))
    current = seen.filter("fate <> 1").select(
        "page_id", "id", F.when(fate == 2, "button").otherwise("textbox").alias("role"), F.when(fate == 5, "Other").otherwise(F.concat(F.lit("Name "), "id", F.lit(" (2)"))).alias("label"), at(fate == 3, fate == 4).alias("box"),
        (fate != 6).alias("visible"), (fate == 7).alias("disabled"), (fate == 8).alias("readonly"),
    )
    return grounding.reground(targets, current).select("page_id", "id", "problem")


@query(f"WITH s AS ({_duck(_SEEN)}) SELECT page_id, arg_min(id, n) AS field, arg_min(id, n) AS region, min(n)::BIGINT AS attempts FROM s WHERE fate IN (0, 4) OR (fate = 2 AND n >= 2) GROUP BY page_id")
def lost_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field of each page whose answer is gone: empty, or invalid after two attempts; closed fields do not count."""
    seen = view(spark, sf_dir, _SEEN, "lineitem")
    fate, label = F.col("fate"), F.concat(F.lit("Field "), "id")
    entered = seen.select("page_id", F.col("n").alias("seq"), "id", label.alias("label"), F.lit(0).alias("ordinal"), F.col("n").cast("long").alias("attempts"))
    current = seen.select("page_id", F.col("n").alias("pos"), "id", label.alias("label"), (~fate.isin(0, 3, 4, 6)).alias("filled"), (fate == 2).alias("invalid"), (fate == 3).alias("disabled"), (fate == 6).alias("readonly"))
    return grounding.lost_answers(entered, current)


@query(f"WITH s AS ({_duck(_SEEN)}), f AS (SELECT page_id, count(*) FILTER (WHERE fate IN (1, 2)) AS twins, max(CASE WHEN fate IN (1, 2) THEN id END) AS only_one FROM s GROUP BY page_id) SELECT s.page_id, s.id, CASE WHEN fate IN (0, 3) THEN s.id WHEN fate IN (1, 2) AND twins = 1 THEN 'x' || only_one END AS found FROM s JOIN f USING (page_id)")
def upload_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file fields to fill: those of the same id and label, or the only one of a label; else it is not sure."""
    seen = view(spark, sf_dir, _SEEN, "lineitem")
    label = F.when(F.col("fate").isin(1, 2), "Scan of it").otherwise(F.concat(F.lit("Photo "), "id"))
    reviewed = seen.select("page_id", "id", label.alias("label"))
    current = seen.select("page_id", F.when(F.col("fate").isin(1, 2), F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"), label.alias("label"), F.when(F.col("fate").isin(0, 1, 2, 3), "file").otherwise("text").alias("input_type"))
    return grounding.upload_targets(reviewed, current).select("page_id", "id", "found")


@query("SELECT 'src/' || doc_id || '.ts' AS path, 2 AS line, CASE doc_id % 5 WHEN 0 THEN 'fetch(' ELSE 'new WebSocket' END AS call FROM documents WHERE doc_id % 5 IN (0, 1) AND doc_id % 7 <> 3")
def network_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the network in sources that may not make any; comments and allowed files do not count."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/"), "doc_id", F.lit(".ts")).alias("path"))
    line = F.when(F.col("doc_id") % 5 == 0, "x = fetch(1)").when(F.col("doc_id") % 5 == 1, "new WebSocket(u)").when(F.col("doc_id") % 5 == 2, "// fetch(1)").when(F.col("doc_id") % 5 == 3, "/* fetch(1) */").otherwise("prefetch (1)")
    files = rows.select("path", F.concat(F.lit("let x\n"), line, F.lit("\nend")).alias("content"))
    return grounding.network_calls(files, rows.filter("doc_id % 7 = 3").select("path")).select("path", F.col("line").cast("int").alias("line"), "call")


# ---------------------------------------------------------------- tokens, keys, codes, files


@query(f"WITH v AS ({_DUCK_VAULT}), t AS (SELECT s_nationkey::BIGINT AS session, s_suppkey, 'PII:' || CASE s_suppkey % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PAN' ELSE 'AADHAAR' END || '#' || (s_suppkey % 14) AS token FROM supplier) SELECT t.session, t.s_suppkey, t.token, v.value FROM t LEFT JOIN v ON v.session = t.session AND v.token = t.token AND NOT v.overflow")
def resolved_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values behind tokens, where the session's vault has them."""
    kind = F.when(F.col("s_suppkey") % 3 == 0, "EMAIL").when(F.col("s_suppkey") % 3 == 1, "PAN").otherwise("AADHAAR")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("session"), "s_suppkey", F.concat(F.lit("PII:"), kind, F.lit("#"), F.col("s_suppkey") % 14).alias("token"))
    return vault.resolve(rows, _minted(spark, sf_dir)).select("session", "s_suppkey", "token", "value")


@query("SELECT o_orderkey, 'pkt_' || substr(sha256('packet-' || o_orderkey), 1, 16) AS log_key, o_custkey::VARCHAR || o_orderkey::VARCHAR AS digits FROM orders")
def log_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for a packet's id in logs, and digits without what sets them apart."""
    rows = table(spark, sf_dir, "orders")
    apart = F.concat(F.col("o_custkey").cast("string"), F.lit(" –- "), F.col("o_orderkey").cast("string"))
    return rows.select("o_orderkey", scalars.packet_log_key(F.concat(F.lit("packet-"), F.col("o_orderkey").cast("string"))).alias("log_key"), validators.digits_of(apart).alias("digits"))


@query("SELECT s_nationkey AS frame, s_suppkey * 3 + i AS ord FROM supplier, (SELECT unnest(range(0, 3)) AS i) WHERE i = 0 OR (i = 1 AND s_suppkey % 2 = 0)")
def code_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that were read twice: a box inside another one is the same code."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("frame"), "s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    left = F.when((F.col("i") == 1) & (F.col("s_suppkey") % 2 == 0), 60).when(F.col("i") == 1, 4).otherwise(F.col("i") * 2)
    boxes = rows.select("frame", (F.col("s_suppkey") * 3 + F.col("i")).alias("ord"), box(left, F.col("s_suppkey") * 100, F.when(F.col("i") == 0, 50).otherwise(40), F.when(F.col("i") == 0, 50).otherwise(40)).alias("box"))
    return media.distinct_codes(boxes).select("frame", "ord")


@query(
    """SELECT p_partkey, p_size % 4 = 1 AS asks_file, p_size % 3 = 0 AS picks, CASE WHEN p_size % 4 = 1 THEN 'upload ' || p_size || ' files. Max 5 MB' END AS help,
    CASE WHEN p_size % 10 = 0 THEN 'empty' WHEN p_size % 10 = 1 THEN 'too_large' WHEN p_size % 10 = 2 THEN 'no_dimensions' WHEN p_size % 10 = 3 THEN 'too_many_pixels' WHEN p_size % 10 = 4 THEN 'no_such_page' END AS refused FROM part"""
)
def upload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and buttons that ask for files, what they say of them, and files that are not taken in."""
    n = F.col("p_size")
    question = F.when(n % 4 == 1, F.concat(F.lit("Please  upload "), n, F.lit(" files. Max 5 MB each"))).otherwise("Your name")
    role, label = F.when(n % 3 < 2, "button").otherwise("text"), F.when(n % 3 == 1, "Send it").otherwise("Choose a file")
    k = n % 10
    refused = intake.file_refusal(F.when(k == 0, 0).when(k == 1, intake.MOST_FILE + 1).otherwise(1000), F.when(k == 2, 0).when(k == 3, 1 << 20).otherwise(640), F.when(k == 3, 1 << 10).otherwise(480), F.lit(3), F.when(k == 4, 4).otherwise(1))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.upload_prompt(question).alias("asks_file"), scalars.upload_action(role, label).alias("picks"), scalars.upload_help(question).alias("help"), refused.alias("refused"))


@query("SELECT user_id AS session, event_type AS memory_key, coalesce(max_by(event_id, event_id) FILTER (WHERE event_id % 11 = 0), min(event_id)) AS value FROM events GROUP BY user_id, event_type")
def remembered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that is kept for each field: the latest correction by a person, else the first."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("memory_key"), F.col("event_id").alias("value"), F.col("event_id").alias("at"), (F.col("event_id") % 11 == 0).alias("corrected"))
    return prompts.remember(rows)


@query("SELECT s_suppkey, (s_suppkey % 50 * 1.5)::DOUBLE AS x, 3.0::DOUBLE AS y, 15.0::DOUBLE AS w, (s_suppkey % 7 * 1.5)::DOUBLE AS h FROM supplier")
def device_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in device pixels as they lie in the image."""
    b = geometry.device_to_image(box(F.col("s_suppkey") % 50, F.lit(2), F.lit(10), F.col("s_suppkey") % 7), F.lit(1.5))
    return table(spark, sf_dir, "supplier").select("s_suppkey", b.alias("b")).select("s_suppkey", "b.*")


# ---------------------------------------------------------------- exports


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS c_acctbal FROM customer")
def exported_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were exported as JSON lines, read again."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    export.write_json(rows, folder)
    return spark.read.schema(rows.schema).json(folder)


@query("SELECT n_name, '| ' || n_name || ' | ' || n || ' | ' || printf('%.1f', 100.0 * n_grave / n) || ' % |' AS line FROM (SELECT n_name, count(*) AS n, count(*) FILTER (WHERE c_custkey % 2 = 0) AS n_grave FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)")
def exported_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of rates as Markdown, line by line."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), (F.count_if(F.col("c_custkey") % 2 == 0) / F.count("*")).alias("rate"))
    lines = export.markdown(rows, ("n_name", "n", "rate")).strip().split("\n")[2:]
    return spark.createDataFrame([(x.split(" | ")[0].removeprefix("| "), x) for x in lines], "n_name string, line string")


# ---------------------------------------------------------------- streams


@query("SELECT user_id AS tab, event_id AS version, event_id < coalesce(max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), event_id) AS stale FROM events")
def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of tabs as a stream: one that comes after a later version is stale."""
    from sparkveil.streaming import stateful

    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("tab"), F.col("event_id").alias("version"), "ts")
    return stateful.run_once(stateful.fresh_snapshots(rows), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


@query("SELECT user_id AS stream, event_id AS frame, CASE WHEN b IS NULL THEN 4 ELSE (event_id % 3 <> b % 3)::INT + (event_id % 5 <> b % 5)::INT + (event_id % 2 <> b % 2)::INT END::BIGINT AS n_changed FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)")
def stream_frame_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tiles of a stream's frame differ from the frame before."""
    from sparkveil.streaming import stateful

    k = F.col("event_id")
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("stream"), k.alias("frame"), "ts", F.array(k % 3, k % 5, k % 2, F.lit(7).cast("long")).alias("hashes"))
    return stateful.run_once(stateful.frame_diffs(rows), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- from a page to its request


@query("SELECT (1000000 + c_custkey)::VARCHAR AS page_id, 200 AS status, 0 AS n_faults, 6 AS n_elements, 1 AS n_texts, 'PII:EMAIL,PII:PERSON_NAME' AS legend, 'Write to PII:EMAIL#1 today' AS said, instr(c_name, '@') = 0 AS clean FROM customer")
def page_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms on their way out: perceived, sanitized, packed as JSON, and read as the receiver reads it. No value of the form is in the packet."""
    forms = view(spark, sf_dir, _FORMS.format(s="STRING", t="{customer}"), "customer", costly=True)
    clean = policy.sanitize(perception.regions(forms).drop("truncated"), "fortress")
    held = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000).cast("string").alias("page_id"), "c_name", F.concat(F.lit("c"), "c_custkey", F.lit("@mail.example.com")).alias("mail"))
    meta = held.select(
        "page_id", F.concat(F.lit("packet-"), "page_id").alias("packet_id"), F.lit(1).cast("long").alias("captured_at_ms"), F.lit("fortress").alias("mode"), F.lit("other").alias("origin_class"), F.lit(True).alias("tls"), F.lit("form").alias("page_kind"),
        F.lit("en").alias("lang"), F.lit(800).alias("w"), F.lit(600).alias("h"), F.lit(1.5).alias("dpr"),
    )
    raw = durable(wire.build_packets(meta, clean).select("page_id", F.col("packet_id").alias("request_id"), "raw"))  # read three times
    read = wire.read_requests(raw.select("request_id", "raw")).select("request_id", "status", "n_faults")
    said = raw.join(read, "request_id").join(held, "page_id")
    of = lambda path: F.get_json_object("raw", path)
    legend = F.array_join(F.array_sort(F.json_object_keys(of("$.redaction_legend"))), ",")
    return said.select(
        "page_id", "status", "n_faults", F.json_array_length(of("$.elements")).alias("n_elements"), F.json_array_length(of("$.untrusted_text")).alias("n_texts"), legend.alias("legend"), of("$.untrusted_text[0].text").alias("said"),
        (~F.col("raw").contains(F.col("c_name")) & ~F.col("raw").contains(F.col("mail"))).alias("clean"),
    )


# ---------------------------------------------------------------- shadow roots

_CARDS = """SELECT c_custkey AS page_id, concat('<main><x-card><h2 slot="title">Title ', CAST(c_custkey AS {s}), '</h2><p>light ', CAST(c_custkey AS {s}), '</p><p slot="none">gone</p><template shadowrootmode="open"><section><h1>root ', CAST(c_custkey AS {s}),
    '</h1><slot name="title"></slot><x-in><template shadowrootmode="open"><p>deep ', CAST(c_custkey AS {s}), '</p><div><template shadowrootmode="closed"><p>closed</p></template></div></template><p>not slotted</p></x-in><slot></slot></section></template></x-card><template><p>inert</p></template><p>after</p></main>') AS html FROM {t}"""


@query("SELECT c_custkey::VARCHAR AS page_id, n::INT AS pos, (['heading', 'text', 'heading', 'text', 'text'])[n] AS role, (['root ' || c_custkey, 'deep ' || c_custkey, 'Title ' || c_custkey, 'light ' || c_custkey, 'after'])[n] AS raw_text FROM customer, (SELECT unnest(range(1, 6)) AS n)")
def shadow_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of pages with nested shadow roots: a root's content before its host's, of which only what has a slot is seen."""
    return perception.regions(_view(spark, sf_dir, _CARDS, "customer", costly=True)).select("page_id", "pos", "role", "raw_text")

"""Queries over packets, plans and requests as JSON text, over sessions and over uploads, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.functions import scalars
from sparkveil.operators import vault, wire
from sparkveil.operators.gate import MOST_REQUEST
from sparkveil.plans.catalogue import _packets, query
from sparkveil.sources.synthetic import spread, table, view

# ---------------------------------------------------------------- requests

#: A request for each order; some are faulty, by the order's number.
_RAW = """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 4000 = 6 THEN concat('{"schema":"', repeat('x', 4194304), '"}') WHEN o_orderkey % 10 = 1 THEN substr(raw, 1, length(raw) - 1) ELSE raw END AS raw FROM (
    SELECT o_orderkey, concat('{"schema":"scp/1.0","packet_id":"packet-', CAST(o_orderkey AS {s}), '-abc","captured_at_ms":', CAST(1 + o_custkey AS {s}), CASE WHEN o_orderkey % 10 = 2 THEN ',"cookie":"a"' ELSE '' END,
    ',"policy":{"mode":"', CASE o_orderkey % 10 WHEN 3 THEN 'wireframe' WHEN 5 THEN 'open' ELSE 'shield' END, '","policy_version":"1","invariant_floor":', CASE WHEN o_orderkey % 10 = 7 THEN 'false' ELSE 'true' END, '}',
    ',"device":{"backend":"none","tier":"T0","viewport":{"w":800,"h":600,"dpr":1.5}},"origin":{"class":"other","tls":true,"page_kind":"form","lang":"en"}',
    ',"visual":{"present":', CASE WHEN o_orderkey % 10 = 3 THEN CONCAT('true,"format":"image/png","sha256":"', repeat('ab', 32), '"') ELSE 'false' END, ',"regions_redacted":0}',
    ',"elements":[{"id":"e1","role":"textbox","label":null,"box":[0,0,10,10],"value":{"kind":"placeholder","token":"PII:EMAIL#1"},"evidence":["structural:role"],"confidence":', CASE WHEN o_orderkey % 10 = 8 THEN '1.5' ELSE '0.9' END, ',"source":"dom"}]',
    ',"redaction_legend":{', CASE WHEN o_orderkey % 10 = 9 THEN '' ELSE '"PII:EMAIL":{"shape":"address","recoverable_by_client":true}' END, '}',
    ',"task":{"intent":"', CASE WHEN o_orderkey % 20 = 4 THEN concat('write to user', CAST(o_custkey AS {s}), '@mail.example.com') ELSE 'fill it' END, '","history":[]},"untrusted_text":[{"src":"e1","text":"seen text"}]}') AS raw FROM {t})"""
_J = "json_extract_string(raw, '{}')"


def _duck(sql: str, name: str) -> str:
    return sql.replace("{s}", "VARCHAR").replace("{t}", name)


def _view(spark: SparkSession, sf_dir: str, sql: str, name: str, costly: bool = False) -> DataFrame:
    """The rows of ``sql``, whose braces and backslashes are text, over the table that ``{t}`` stands for."""
    text = sql.replace("{s}", "STRING").replace("{t}", "\0").replace("\\", "\\\\").replace("{", "{{").replace("}", "}}").replace("\0", "{" + name + "}")
    return view(spark, sf_dir, text, name, costly=costly)


_DUCK_RAW = _duck(_RAW, "orders")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _RAW, "orders", costly=True)


@query(
    f"""WITH r AS ({_DUCK_RAW}), f AS (SELECT request_id, CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END AS raw, strlen(raw) > 4194304 AS large, strlen(raw) <= 4194304 AND json_valid(raw) AS good FROM r),
    c AS (SELECT *, CASE WHEN good THEN (len(list_filter(json_keys(raw), lambda k: k NOT IN ('schema', 'packet_id', 'captured_at_ms', 'policy', 'device', 'origin', 'visual', 'elements', 'redaction_legend', 'task', 'untrusted_text')))
        + ({_J.format('$.policy.mode')} NOT IN ('shield', 'fortress', 'wireframe'))::INT + ({_J.format('$.policy.invariant_floor')} <> 'true')::INT + ({_J.format('$.elements[0].confidence')}::DOUBLE NOT BETWEEN 0 AND 1)::INT
        + ({_J.format('$.policy.mode')} = 'wireframe' AND {_J.format('$.visual.present')} = 'true')::INT + (NOT list_contains(json_keys(raw, '$.redaction_legend'), split_part({_J.format('$.elements[0].value.token')}, '#', 1)))::INT) ELSE 0 END AS n FROM f),
    d AS (SELECT *, good AND n = 0 AND regexp_matches({_J.format('$.task.intent')}, '[a-z0-9]+@[a-z.]+') AS leaks FROM c)
    SELECT request_id, CASE WHEN large THEN 413 WHEN NOT good THEN 400 WHEN n > 0 OR leaks THEN 422 ELSE 200 END AS status,
    CASE WHEN large THEN 'body_too_large' WHEN NOT good THEN 'invalid_json' WHEN n > 0 THEN 'schema_validation' WHEN leaks THEN 'rescan_detected_pii' ELSE 'received' END AS reason, n::INT AS n_faults,
    CASE WHEN leaks THEN 'EMAIL' ELSE '' END AS classes FROM d"""
)
def requests_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of JSON text: what becomes of each."""
    return wire.read_requests(_requests(spark, sf_dir)).select("request_id", "status", "reason", "n_faults", F.array_join("classes", ",").alias("classes"))


@query(f"SELECT request_id, 'packet.task.intent' AS path, 'EMAIL' AS cls FROM ({_DUCK_RAW}) WHERE strlen(raw) <= 4194304 AND json_valid(raw) AND regexp_matches(CASE WHEN json_valid(raw) THEN {_J.format('$.task.intent')} END, '[a-z0-9]+@[a-z.]+')")
def rescan_all_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire.rescan_json(_requests(spark, sf_dir).filter(F.octet_length("raw") <= MOST_REQUEST))


@query(f"SELECT request_id, strlen(raw)::INT AS bytes, sha256(raw) AS sha256 FROM ({_DUCK_RAW}) WHERE NOT json_valid(raw)")
def failed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire.failed_requests(_requests(spark, sf_dir))


# ---------------------------------------------------------------- answers of planners

_PLAN = """SELECT concat('packet-', lpad(CAST(l_orderkey AS {s}), 12, '0')) AS packet_id, concat('{"schema":"plan/1.0","packet_id":"packet-', lpad(CAST(CASE WHEN l_orderkey % 13 = 5 THEN l_orderkey + 1 ELSE l_orderkey END AS {s}), 12, '0'),
    '","reasoning_summary":"', CASE WHEN l_orderkey % 7 = 1 THEN 'send it to me.too@mail.example.com' ELSE 'next field' END, '","steps":[{"action":"', CASE WHEN l_orderkey % 11 = 2 THEN 'fly' ELSE 'click' END, '"', CASE WHEN l_orderkey % 11 = 3 THEN '' ELSE ',"target_element_id":"e1"' END,
    ',"requires_confirmation":true}', CASE WHEN l_orderkey % 17 = 4 THEN ',{"action":"click","target_element_id":"e99","requires_confirmation":false}' ELSE '' END, '],"needs_more_context":false,"confidence":', CASE WHEN l_orderkey % 19 = 6 THEN '2' ELSE '0.5' END, '}') AS raw
    FROM (SELECT l_orderkey FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM {t} GROUP BY l_orderkey, l_linenumber) WHERE l_linenumber = 1 AND l_suppkey % 7 <> 0)"""
_DUCK_PLAN = _duck(_PLAN, "lineitem")


@query(
    f"""WITH p AS (SELECT *, lpad(regexp_extract(packet_id, '[0-9]+'), 12, '0')::BIGINT AS k FROM ({_DUCK_PLAN})),
    c AS (SELECT *, {_J.format('$.steps[0].action')} NOT IN ('click', 'type', 'clear', 'select', 'focus', 'scroll', 'wait', 'done', 'abort') OR ({_J.format('$.steps[0].action')} = 'click' AND {_J.format('$.steps[0].target_element_id')} IS NULL) OR {_J.format('$.confidence')}::DOUBLE > 1 AS bad,
        ({_J.format('$.packet_id')} <> packet_id)::INT + coalesce({_J.format('$.steps[1].target_element_id')} = 'e99', FALSE)::INT AS n, regexp_matches({_J.format('$.reasoning_summary')}, '@') AS leaks, json_array_length(raw, '$.steps') AS n_steps FROM p)
    SELECT packet_id, CASE WHEN bad OR n > 0 OR leaks THEN 'blocked' ELSE 'pass' END AS outcome, CASE WHEN bad THEN 'schema' ELSE concat_ws(',', CASE WHEN n > 0 THEN 'guard' END, CASE WHEN leaks THEN 'tripwire' END) END AS reasons,
    CASE WHEN NOT bad THEN n_steps END::INT AS n_steps, CASE WHEN bad THEN 0 ELSE n END::BIGINT AS n_problems FROM c"""
)
def answer_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planners' answers to packets: which pass, and why others do not."""
    answers = _view(spark, sf_dir, _PLAN, "lineitem").withColumn("plan_id", F.col("packet_id"))
    return wire.guard_answers(answers, _packets(spark, sf_dir)).select("packet_id", "outcome", F.array_join("reasons", ",").alias("reasons"), "n_steps", "n_problems")


_RESPONSES = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('{"choices":[{"message":{"content":"{\\"a\\":', CAST(o_custkey AS {s}), '}"}}]}') WHEN 1 THEN concat('{"choices":[{"message":{"content":[{"type":"text","text":"{\\"a\\":"},{"type":"image"},{"text":"', CAST(o_custkey AS {s}), '}"}]}}]}')
    WHEN 2 THEN concat('{"choices":[{"message":{"content":"```json {\\"a\\":', CAST(o_custkey AS {s}), '} ```"}}]}') ELSE '{"error":"none"}' END AS response FROM {t}"""


@query(
    f"""SELECT o_orderkey, CASE WHEN c IS NULL THEN NULL WHEN json_type(c) = 'ARRAY' THEN (SELECT string_agg(t, chr(10)) FROM (SELECT unnest(json_extract_string(c, '$[*].text')) AS t) WHERE t IS NOT NULL)
    ELSE trim(regexp_replace(c->>'$', '^```json|```$', '', 'g')) END AS content FROM (SELECT o_orderkey, json_extract(response, '$.choices[0].message.content') AS c FROM ({_duck(_RESPONSES, 'orders')}))"""
)
def plan_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan inside planners' responses of several shapes."""
    return _view(spark, sf_dir, _RESPONSES, "orders").select("o_orderkey", wire.plan_content(F.col("response")).alias("content"))


_CHOICES = """SELECT o_orderkey AS packet_id, CASE o_orderkey % 2 WHEN 0 THEN 'form' ELSE 'article' END AS page_kind, o_custkey % 6 <> 0 AS asks, o_custkey % 3 AS n_steps, CASE o_custkey % 2 WHEN 0 THEN 'type' ELSE 'click' END AS action, 'e1' AS target,
    CAST(NULL AS {s}) AS value_kind, FALSE AS requires_confirmation, o_custkey % 5 = 0 AS failed, CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 0 END AS problems, o_orderkey % 4 AS n2, CASE o_orderkey % 3 WHEN 0 THEN 'type' ELSE 'click' END AS action2 FROM {t}"""


@query(
    f"""WITH c AS (SELECT *, CASE WHEN NOT asks THEN NULL WHEN failed THEN 'failed' WHEN n2 = 0 AND n_steps > 0 THEN 'empty' WHEN page_kind = 'form' AND NOT (CASE WHEN n_steps = 0 OR n2 = 0 THEN n_steps = n2 ELSE action = action2 END) THEN 'disagrees'
    WHEN problems > 0 THEN 'guard' END AS fallback FROM ({_duck(_CHOICES, 'orders')}))
    SELECT packet_id, CASE WHEN NOT asks OR fallback IS NOT NULL THEN 'local' WHEN page_kind = 'form' THEN 'local_confirmed' ELSE 'configured' END AS used, fallback FROM c"""
)
def plan_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic plan or the configured planner's, by the ladder of fallbacks."""
    rows = _view(spark, sf_dir, _CHOICES, "orders")
    local = rows.select("packet_id", "page_kind", "asks", "n_steps", "action", "target", "value_kind", "requires_confirmation")
    told = rows.filter("asks").select("packet_id", "failed", "problems", F.col("n2").alias("n_steps"), F.col("action2").alias("action"), "target", "value_kind", "requires_confirmation")
    return wire.choose_plans(local, told)


_ENV = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE concat(' http://h', CAST(o_custkey AS {s})) END AS endpoint, CASE o_orderkey % 3 WHEN 0 THEN 'm1' WHEN 1 THEN ' ' END AS model, CASE o_orderkey % 4 WHEN 0 THEN '-5' WHEN 1 THEN 'soon' WHEN 2 THEN '250.5' END AS timeout,
    CASE o_orderkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '2.5' WHEN 2 THEN '0' END AS temperature, CASE o_orderkey % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'Model' WHEN 2 THEN 'heuristic' END AS mode FROM {t}"""


@query(
    f"""SELECT o_orderkey, trim(endpoint) AS endpoint, coalesce(nullif(trim(model), ''), 'default') AS model, CASE WHEN try_cast(timeout AS DOUBLE) > 0 THEN try_cast(timeout AS DOUBLE) ELSE 30000 END AS timeout_ms,
    CASE WHEN try_cast(temperature AS DOUBLE) BETWEEN 0 AND 2 THEN try_cast(temperature AS DOUBLE) ELSE 0 END AS temperature, CASE WHEN mode IN ('model', 'heuristic', 'auto') THEN mode ELSE 'auto' END AS mode
    FROM ({_duck(_ENV, 'orders')}) WHERE trim(endpoint) <> ''"""
)
def planner_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, sf_dir, _ENV, "orders")
    env = F.map_from_arrays(F.array(*[F.lit(f"PLANNER_{n}") for n in ("ENDPOINT", "MODEL", "TIMEOUT_MS", "TEMPERATURE", "MODE")]), F.array("endpoint", "model", "timeout", "temperature", "mode"))
    return rows.select("o_orderkey", wire.planner_config(env).alias("c")).filter("c is not null").select("o_orderkey", "c.*")


_STEPS = """SELECT o_custkey % 50 AS session, o_orderkey AS step, CASE o_orderkey % 4 WHEN 0 THEN 'literal' WHEN 1 THEN 'placeholder' ELSE 'user_prompt' END AS value_kind, CASE WHEN o_orderkey % 6 <> 3 THEN concat('k', CAST(o_custkey % 9 AS {s})) END AS memory_key,
    concat('f', CAST(o_orderkey % 5 AS {s})) AS field_id, CASE WHEN o_orderkey % 4 = 1 THEN concat(CASE o_custkey % 2 WHEN 0 THEN 'PII:PAN#' ELSE 'PII:EMAIL#' END, CAST(o_orderkey % 6 AS {s})) END AS token, CASE WHEN o_orderkey % 4 = 0 THEN 'text' END AS literal,
    o_orderkey % 10 = 7 AS rejected, o_orderkey % 14 = 3 AS asked FROM {t}"""
_KEPT = "SELECT s % 50 AS session, concat('k', CAST(s % 4 AS {s})) AS memory_key, concat('kept', CAST(s AS {s})) AS value FROM (SELECT o_orderkey AS s FROM {t} WHERE o_orderkey < 50)"
_GIVEN = "SELECT s % 50 AS session, concat('f', CAST(s % 5 AS {s})) AS field_id, concat('given', CAST(s AS {s})) AS value FROM (SELECT o_orderkey AS s FROM {t} WHERE o_orderkey BETWEEN 50 AND 99)"
_HELD = "SELECT s % 50 AS session, concat(CASE s % 2 WHEN 0 THEN 'PII:PAN#' ELSE 'PII:EMAIL#' END, CAST(s % 6 AS {s})) AS token, concat('held', CAST(s AS {s})) AS value, FALSE AS overflow FROM (SELECT o_orderkey AS s FROM {t} WHERE o_orderkey BETWEEN 100 AND 149)"


@query(
    f"""SELECT s.session, s.step, CASE WHEN value_kind = 'user_prompt' THEN CASE WHEN NOT rejected THEN coalesce(k.value, g.value) END WHEN value_kind = 'placeholder' THEN h.value ELSE literal END AS value,
    CASE WHEN value_kind = 'literal' THEN 'literal' WHEN value_kind = 'placeholder' AND h.value IS NOT NULL THEN 'vault' WHEN value_kind = 'user_prompt' AND NOT rejected AND k.value IS NOT NULL THEN 'remembered' WHEN value_kind = 'user_prompt' AND NOT rejected AND g.value IS NOT NULL THEN 'supplied'
    WHEN asked OR s.memory_key IS NULL THEN 'stopped' ELSE 'ask' END AS origin, value_kind = 'placeholder' AND h.value IS NOT NULL AND starts_with(s.token, 'PII:PAN') AS confirm
    FROM ({_duck(_STEPS, 'orders')}) s LEFT JOIN ({_duck(_KEPT, 'orders')}) k ON s.session = k.session AND s.memory_key = k.memory_key
    LEFT JOIN ({_duck(_GIVEN, 'orders')}) g ON s.session = g.session AND s.field_id = g.field_id LEFT JOIN ({_duck(_HELD, 'orders')}) h ON s.session = h.session AND s.token = h.token"""
)
def resolved_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the values of plans' steps come from."""
    made = lambda sql: _view(spark, sf_dir, sql, "orders")
    out = wire.resolve_steps(made(_STEPS), made(_KEPT), made(_GIVEN), made(_HELD))
    return out.withColumn("confirm", F.coalesce("confirm", F.lit(False)))


# ---------------------------------------------------------------- sessions


@query("SELECT user_id, event_id, count(*) OVER w AS sent, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER w::BIGINT AS redacted, sum(length(event_type)) OVER w::BIGINT AS bytes FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of each session's packets: sent, redacted, bytes."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("at"), "event_id", (F.col("event_id") % 3 == 0).cast("int").alias("redacted"), F.length("event_type").alias("bytes"))
    return vault.running_totals(rows, ("redacted", "bytes")).select(F.col("session").alias("user_id"), "event_id", "sent", "redacted", "bytes")


# ---------------------------------------------------------------- uploads

_CHOSEN = """SELECT p_partkey, concat('scan', CAST(p_partkey AS {s}), CASE p_size % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' ELSE '.txt' END) AS name, CASE p_size % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' ELSE 'text/plain' END AS mime, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '.pdf, .jpg' WHEN 2 THEN 'image/*' ELSE 'application/pdf' END AS accept,
    p_size * 100000 AS size, CASE p_size % 5 WHEN 0 THEN 'Max file size: 2 MB' WHEN 1 THEN 'up to 500 KB' WHEN 2 THEN 'upload 1 supported file' ELSE NULL END AS help FROM {t}"""


@query(
    f"""SELECT p_partkey, CASE WHEN size <= 0 THEN 'empty' WHEN size > CASE WHEN help LIKE '%2 MB' THEN 2 * 1048576 WHEN help LIKE '%500 KB' THEN 500 * 1024 ELSE 20 * 1048576 END THEN 'too_large'
    WHEN NOT CASE accept WHEN '' THEN TRUE WHEN '.pdf, .jpg' THEN lower(name) LIKE '%.pdf' WHEN 'image/*' THEN mime LIKE 'image/%' ELSE mime = 'application/pdf' END THEN 'not_accepted' END AS problem FROM ({_duck(_CHOSEN, 'part')})"""
)
def file_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with chosen files: their size or their kind."""
    rows = _view(spark, sf_dir, _CHOSEN, "part")
    return rows.select("p_partkey", scalars.file_problem(*[F.col(c) for c in ("name", "mime", "size", "accept", "help")]).alias("problem"))


@query("SELECT p_partkey, base64(encode(p_name)) AS data, sha256(base64(encode(p_name))) AS sha256 FROM part")
def file_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkveil.operators import intake

    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").cast("binary").alias("content"))
    return rows.select("p_partkey", intake.payload(F.col("content")).alias("p")).select("p_partkey", "p.*")


# ---------------------------------------------------------------- images and documents

_SEEN = """SELECT p.p_partkey AS page_id, l.i AS pos, CASE (p.p_partkey * 3 + l.i * 7 + p.p_size) % 6 WHEN 0 THEN 'Aadhaar card of India' WHEN 1 THEN 'Signed by the holder' WHEN 2 THEN concat('mail a', CAST(p.p_partkey AS {s}), '@mail.example.com') WHEN 3 THEN 'nothing here' WHEN 4 THEN 'number 12345678 x' ELSE 'plain words' END AS text
    FROM {t} p JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3) l ON l.i <= p.p_size % 4"""
_SHEETS = "SELECT p_partkey AS page_id, CASE p_size % 7 WHEN 0 THEN 'pdf' ELSE 'image' END AS kind, 640 AS width, 480 AS height, p_partkey % 5 = 0 AS hint, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS faces, CASE p_partkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 20 ELSE 0 END AS codes FROM {t}"


def _inspected(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from sparkveil.functions.geometry import box
    from sparkveil.operators import intake

    sheets = _view(spark, sf_dir, _SHEETS, "part")
    texts = _view(spark, sf_dir, _SEEN, "part").withColumn("box", box(F.lit(10), F.col("pos") * 30, F.lit(200), F.lit(20)))
    found = lambda n: sheets.filter(f"{n} > 0").select("page_id", F.explode(F.sequence(F.lit(1), F.col(n))).alias("pos")).withColumn("box", box(F.lit(300), F.col("pos") * 10, F.lit(50), F.lit(50)))
    return intake.inspect_pages(sheets.drop("faces", "codes"), texts, found("faces"), found("codes"))


_DUCK_SHEETS = f"""WITH t AS ({_duck(_SEEN, 'part')}), a AS (SELECT page_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(text, '@')) AS n_mail, bool_or(regexp_matches(text, 'Aadhaar')) AS card, bool_or(regexp_matches(text, 'Signed by')) AS sig,
    bool_or(length(regexp_replace(text, '[^0-9]', '', 'g')) >= 8) AS num FROM t GROUP BY page_id),
    s AS (SELECT p.page_id, kind = 'pdf' AS pdf, hint, coalesce(n_lines, 0) AS n_lines, coalesce(n_mail, 0) AS n_mail, CASE WHEN kind = 'pdf' THEN 0 ELSE faces END AS n_faces, least(codes, 1) AS n_codes, codes, hint OR coalesce(card, FALSE) AS identity, coalesce(sig, FALSE) AS sig, coalesce(num, FALSE) AS num FROM ({_duck(_SHEETS, 'part')}) p LEFT JOIN a USING (page_id)),
    w AS (SELECT *, pdf OR sig OR (hint AND n_codes = 0) OR (identity AND NOT num) OR (n_lines = 0 AND n_faces = 0 AND n_codes = 0) OR (identity AND n_lines + n_faces + n_codes = 0) AS whole FROM s)"""


@query(
    f"""{_DUCK_SHEETS} SELECT page_id, n_lines, n_faces::BIGINT AS n_faces, n_codes::BIGINT AS n_codes, identity, sig AS signature, CASE WHEN whole THEN 1 ELSE CASE WHEN identity THEN n_lines ELSE n_mail END + n_faces + n_codes END::BIGINT AS n_masks,
    CASE WHEN pdf THEN 'pdf_masked' WHEN hint AND n_codes = 0 THEN 'code_not_found' WHEN identity AND NOT num THEN 'number_not_found' WHEN whole AND (identity OR sig) THEN 'cue_not_placed' WHEN whole THEN 'nothing_recognized' WHEN identity THEN 'all_lines' ELSE 'selective' END AS treatment,
    concat_ws(' ', CASE WHEN n_mail > 0 THEN 'EMAIL:' || n_mail END, CASE WHEN n_faces > 0 THEN 'FACE:' || n_faces END, CASE WHEN identity THEN 'ID_DOCUMENT:1' END, CASE WHEN n_codes > 0 THEN 'QR_BARCODE:' || n_codes END, CASE WHEN sig THEN 'SIGNATURE:1' END) AS by_class FROM w"""
)
def media_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found on pages of images and documents, and how they are treated."""
    out = _inspected(spark, sf_dir)["report"].drop("seen_classes")
    return out.withColumn("by_class", F.array_join(F.transform("by_class", lambda x: F.concat(x["cls"], F.lit(":"), x["n"])), " "))


@query(f"{_DUCK_SHEETS} SELECT page_id, count(*) AS n, sum(area)::DOUBLE AS area FROM (SELECT page_id, 640 * 480 AS area FROM w WHERE whole UNION ALL SELECT t.page_id, 4000 FROM t JOIN w USING (page_id) WHERE NOT whole AND (identity OR regexp_matches(text, '@')) UNION ALL SELECT page_id, 2500 FROM w WHERE NOT whole AND n_faces = 1 UNION ALL SELECT page_id, CASE WHEN codes > 16 THEN 640 * 480 ELSE 2500 END FROM w WHERE NOT whole AND codes > 0) GROUP BY page_id")
def media_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inspected(spark, sf_dir)["masks"].groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("box.w") * F.col("box.h")).alias("area"))


@query(f"SELECT page_id, pos, 'PII:EMAIL#1' AS text FROM ({_duck(_SEEN, 'part')}) WHERE regexp_matches(text, '@')")
def media_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed tokens of pages: a page's one address has one token."""
    return _inspected(spark, sf_dir)["tokens"]


_CODES = "SELECT s_suppkey, CAST(20 + s_suppkey % 90 AS DOUBLE) AS x, CAST(15 + s_suppkey % 70 AS DOUBLE) AS y, CAST(10 + s_suppkey % 31 AS DOUBLE) AS side, s_suppkey % 2 = 0 AS square, s_suppkey % 9 = 0 AS none FROM {t}"


@query(
    f"""WITH c AS (SELECT *, CASE WHEN square THEN ceil(side * 0.3) + 4 ELSE 4 END AS pad, CASE WHEN square THEN side ELSE 0 END AS tall FROM ({_duck(_CODES, 'supplier')}))
    SELECT s_suppkey, CASE WHEN none THEN 0 ELSE greatest(0, floor(x - pad)) END::DOUBLE AS x, CASE WHEN none THEN 0 ELSE greatest(0, floor(y - pad)) END::DOUBLE AS y,
    CASE WHEN none THEN 128 ELSE least(128, ceil(x + side + pad)) - greatest(0, floor(x - pad)) END::DOUBLE AS w, CASE WHEN none THEN 96 ELSE least(96, ceil(y + tall + pad)) - greatest(0, floor(y - pad)) END::DOUBLE AS h FROM c"""
)
def code_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes to mask for codes, from the points where they were read."""
    from sparkveil.operators import intake

    rows = _view(spark, sf_dir, _CODES, "supplier")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, side = F.col("x"), F.col("y"), F.col("side")
    points = F.when(F.col("none"), F.array().cast("array<struct<x:double,y:double>>")).when(F.col("square"), F.array(point(x, y + side), point(x, y), point(x + side, y))).otherwise(F.array(point(x, y), point(x + side, y)))
    return rows.select("s_suppkey", intake.code_box(points, F.lit(128), F.lit(96), F.col("square")).alias("b")).select("s_suppkey", "b.*")


@query("SELECT s_suppkey AS id, 48 AS width, 27 AS height, TRUE AS png_read, TRUE AS masked FROM supplier")
def encoded_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked images as they are sent, here with an edge of 48 at most: sizes, and that what was encoded reads as an image of that size."""
    from sparkveil.functions.geometry import box
    from sparkveil.operators import intake, media
    from sparkveil.plans.catalogue import _frames

    rect = box(F.col("frame") % 40, F.lit(5), F.lit(12), F.lit(10))
    images = _frames(spark, sf_dir).select(F.col("frame").alias("id"), "width", "height", "data", F.array(rect).alias("rects"))
    made = media.inspect_images(intake.encode_masked(images, most_edge=48), "png")
    return made.select("id", "width", "height", (F.col("clean") & (F.col("meta.width") == F.col("width")) & (F.col("meta.height") == F.col("height"))).alias("png_read"), F.col("refused").isNull().alias("masked"))


# ---------------------------------------------------------------- form controls and prompts

_FIELDS = """SELECT c_custkey AS page_id, concat('<form><span id="q">Town of ', c_name, '</span><input aria-labelledby="q none" value="v', CAST(c_custkey AS {s}), '" aria-invalid="', CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END, '" aria-describedby="h" aria-errormessage="e"><p id="h">Say it</p><p id="e">Wrong ', CAST(c_custkey AS {s}), '</p>',
    '<label>Notes <textarea>note ', CAST(c_custkey AS {s}), '</textarea></label><label for="s">Size</label><select id="s"><option value="">none<option', CASE WHEN c_custkey % 2 = 0 THEN ' selected' ELSE '' END, '>Small<option>Large</select>',
    '<div role="radiogroup" aria-label="Colour"><span role="radio" aria-checked="', CASE WHEN c_custkey % 4 = 1 THEN 'true' ELSE 'false' END, '">Red</span><span role="radio" aria-checked="true">Blue</span></div><div role="combobox" aria-label="Search"><input value="in', CAST(c_custkey AS {s}), '"></div><input type="file" aria-label="Scan"></form>') AS html FROM {t}"""


@query(
    """SELECT c_custkey AS page_id, nth, (['Town of ' || c_name, 'Notes note ' || c_custkey, 'Size', 'Colour', 'Search', 'Scan'])[nth] AS label, (['v' || c_custkey, 'note ' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Small' ELSE '' END, CASE WHEN c_custkey % 4 = 1 THEN 'Red, Blue' ELSE 'Blue' END, 'in' || c_custkey, ''])[nth] AS value,
    nth = 1 AND c_custkey % 3 = 0 AS invalid, CASE WHEN nth = 1 AND c_custkey % 3 = 0 THEN 'Wrong ' || c_custkey END AS message, CASE WHEN nth = 1 THEN 'Say it' END AS help, (['', '', 'none, Small, Large', 'Red, Blue', '', ''])[nth] AS options FROM customer, (SELECT unnest(range(1, 7))::INT AS nth)"""
)
def form_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls of forms: labels by reference, around and for; chosen options; composite widgets as one; what is wrong."""
    from pyspark.sql import Window as W

    from sparkveil.operators import perception

    found = perception.controls(_view(spark, sf_dir, _FIELDS, "customer", costly=True))
    nth = F.row_number().over(W.partitionBy("page_id").orderBy("pos"))
    return found.select("page_id", nth.alias("nth"), "label", "value", "invalid", "message", "help", F.coalesce("options", F.lit("")).alias("options"))


@query("""SELECT c_custkey AS task_id, unnest(['f1', 'f2', 'f3']) AS field_id, unnest(['Asha Rao', 'c' || c_custkey || '@mail.example.com', 'Town' || c_nationkey]) AS value FROM customer""")
def prompt_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a prompt gives without naming the field: a leading name, and where someone lives."""
    from sparkveil.operators import prompts

    rows = spread(table(spark, sf_dir, "customer"))
    prompt = F.concat(F.lit("Asha Rao, email: c"), F.col("c_custkey"), F.lit("@mail.example.com. I live in Town"), F.col("c_nationkey"), F.lit(", please submit"))
    field = lambda i, label: F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(None).cast("string").alias("structural_class"))
    tasks = rows.select(F.col("c_custkey").alias("task_id"), prompt.alias("prompt"), F.array(field("f1", "Full name"), field("f2", "Email address"), field("f3", "City")).alias("fields"))
    return prompts.answers(tasks).select("task_id", F.explode("answers").alias("a")).select("task_id", "a.field_id", "a.value")

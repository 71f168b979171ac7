"""Packets and plans as JSON text: building, strict reading, the walk over all strings, and the guard of answers.

JSON of any depth has no column form, so strict checks and the walk parse it in Python over Arrow batches; what they
find, and everything after it, are columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkveil.functions.taxonomy import CLASSES, MODES
from sparkveil.operators import planner
from sparkveil.operators.gate import MOST_ELEMENTS, MOST_HISTORY, MOST_INTENT, MOST_REQUEST, MOST_TEXT, MOST_TEXTS, PACKET, SCHEMA_ID, TRIPWIRE
from sparkveil.operators.recognizers import STANDARD, Registry, each_span
from sparkveil.operators.vault import live, scan
from sparkveil.sources.durable import durable_columns
from sparkveil.sources.shipping import ship

PLAN_ID, POLICY_VERSION = "plan/1.0", "2026.1"
Check = Callable[[object, str, list], None]

# ---------------------------------------------------------------- a small grammar of strict JSON records


def text(most: int | None = None, least: int = 0, pattern: str | None = None) -> Check:
    shape = re.compile(pattern) if pattern else None

    def check(v: object, at: str, found: list) -> None:
        if not isinstance(v, str):
            found.append((at, "not_text"))
        elif len(v) < least or (most is not None and len(v) > most):
            found.append((at, "length"))
        elif shape and not shape.fullmatch(v):
            found.append((at, "form"))

    return check


def number(low: float | None = None, high: float | None = None, whole: bool = False, above: float | None = None) -> Check:
    def check(v: object, at: str, found: list) -> None:
        if isinstance(v, bool) or not isinstance(v, int | float) or (whole and v != int(v)):
            found.append((at, "not_number"))
        elif (low is not None and v < low) or (high is not None and v > high) or (above is not None and v <= above):
            found.append((at, "range"))

    return check


def flag(only: bool | None = None) -> Check:
    return lambda v, at, found: None if isinstance(v, bool) and (only is None or v is only) else found.append((at, "not_flag"))


def one_of(*known: str) -> Check:
    return lambda v, at, found: None if v in known else found.append((at, "unknown_value"))


def optional(inner: Check) -> Check:
    inner.optional = True
    return inner


def nullable(inner: Check) -> Check:
    return lambda v, at, found: None if v is None else inner(v, at, found)


def many(inner: Check, most: int | None = None, exactly: int | None = None) -> Check:
    def check(v: object, at: str, found: list) -> None:
        if not isinstance(v, list):
            found.append((at, "not_list"))
            return
        if (most is not None and len(v) > most) or (exactly is not None and len(v) != exactly):
            found.append((at, "length"))
        for i, x in enumerate(v):
            inner(x, f"{at}[{i}]", found)

    return check


def record(strict: bool = True, **fields: Check) -> Check:
    def check(v: object, at: str, found: list) -> None:
        if not isinstance(v, dict):
            found.append((at, "not_record"))
            return
        for name, inner in fields.items():
            if name in v:
                inner(v[name], f"{at}.{name}", found)
            elif not getattr(inner, "optional", False):
                found.append((f"{at}.{name}", "missing"))
        if strict:
            found += [(f"{at}.{name}", "unknown_key") for name in v if name not in fields]

    return check


def mapping(inner: Check) -> Check:
    def check(v: object, at: str, found: list) -> None:
        if not isinstance(v, dict):
            found.append((at, "not_record"))
            return
        for name, x in v.items():
            inner(x, f"{at}.{name}", found)

    return check


def by_kind(**kinds: Check) -> Check:
    """A record whose field ``kind`` tells which of several it is."""

    def check(v: object, at: str, found: list) -> None:
        kind = v.get("kind") if isinstance(v, dict) else None
        if kind in kinds:
            kinds[kind](v, at, found)
        else:
            found.append((f"{at}.kind", "unknown_value"))

    return check


_TOKEN = text(pattern="PII:(?:" + "|".join(CLASSES) + r")#[0-9]+")
_ID = text(pattern="e[0-9]+")
# fixed values: names, kinds and limits of what packets and plans hold, on which both ends of the wire must agree
_STATE = record(**{n: optional(flag()) for n in ("filled", "disabled", "focused", "required", "checked", "expanded", "invalid", "readonly", "partially_visible")})
_AMOUNTS = {n: optional(text()) for n in ("length_bucket", "magnitude_bucket", "currency", "domain_class")} | {n: optional(flag()) for n in ("format_valid", "masked")}
_VALUE = by_kind(
    empty=record(False), filled=record(False, text=text(2000)), placeholder=record(False, token=_TOKEN, length=optional(number(low=0, whole=True)), **_AMOUNTS),
    redacted=record(False, token=optional(_TOKEN)), unexplained_masked=record(False),
)
_ROLES = "textbox password button link checkbox radio combobox listbox option slider switch tab menuitem heading text label image canvas video iframe document form table list listitem dialog alert progressbar region unknown".split()
_ELEMENT = record(
    id=_ID, role=one_of(*_ROLES), label=nullable(text(300)), box=many(number(), exactly=4), state=optional(_STATE), value=optional(_VALUE), evidence=many(text(pattern="(?:structural|pattern|semantic|visual|fusion):[a-z0-9_\\-=.]+"), 16),
    confidence=number(0, 1), source=one_of("dom", "vision", "dom+vision"), risk=optional(one_of("state_changing", "navigation", "destructive")), note=optional(text(300)),
)
#: fixed values: the fields of a packet and their limits
PACKET_RULES = record(
    schema=one_of(SCHEMA_ID), packet_id=text(64, 10), captured_at_ms=number(whole=True, above=0),
    policy=record(mode=one_of(*MODES), policy_version=text(32), invariant_floor=flag(True)),
    device=record(backend=one_of("webgpu", "wasm-simd-threads", "wasm", "none"), tier=one_of("T0", "T1", "T2", "T3"), viewport=record(w=number(whole=True, above=0), h=number(whole=True, above=0), dpr=number(above=0))),
    origin=record(**{"class": one_of("government", "banking", "payments", "healthcare", "mail", "social", "commerce", "enterprise", "education", "media", "developer", "other")}, tls=flag(), page_kind=text(64), lang=text(16)),
    visual=record(
        present=flag(), format=optional(one_of("image/webp", "image/png")), w=optional(number(whole=True, above=0)), h=optional(number(whole=True, above=0)), sha256=optional(text(pattern="[0-9a-f]{64}")),
        redaction_overlay=optional(one_of("flat_fill", "label_stamp", "none")), regions_redacted=number(low=0, whole=True), data_b64=optional(text(1_500_000, pattern="[A-Za-z0-9+/]+={0,2}")),
    ),
    elements=many(_ELEMENT, MOST_ELEMENTS), redaction_legend=mapping(record(shape=text(300), recoverable_by_client=flag())),
    task=record(intent=text(MOST_INTENT), history=many(record(step=number(whole=True, above=0), action=text(40), element_label=nullable(text(300)), result=one_of("ok", "failed", "aborted")), MOST_HISTORY)),
    untrusted_text=many(record(src=_ID, text=text(MOST_TEXT)), MOST_TEXTS),
)
_STEP_VALUE = by_kind(
    user_prompt=record(False, prompt_text=text(300)), placeholder=record(False, token=_TOKEN), literal=record(False, text=text(2000)), option_label=record(False, label=text(300)),
)
_STEP_FIELDS = record(
    action=one_of("click", "type", "clear", "select", "focus", "scroll", "wait", "done", "abort"), target_element_id=optional(_ID), value=optional(_STEP_VALUE),
    scroll=optional(record(direction=one_of("up", "down"), amount=one_of("page", "half", "to_element"))), wait_ms=optional(number(whole=True, above=0, high=10_000)), requires_confirmation=flag(), confirmation_reason=optional(text(300)),
)


def _step(v: object, at: str, found: list) -> None:
    _STEP_FIELDS(v, at, found)
    if isinstance(v, dict):
        needs = {"target_element_id": planner.TARGETED, "value": ("type", "select"), "scroll": ("scroll",)}
        found += [(f"{at}.{name}", "missing_for_action") for name, actions in needs.items() if v.get("action") in actions and not v.get(name)]


PLAN_RULES = record(schema=one_of(PLAN_ID), packet_id=text(64, 10), reasoning_summary=text(2000), steps=many(_step, 20), needs_more_context=flag(), confidence=number(0, 1))


def packet_faults(packet: object) -> list[tuple[str, str]]:
    """Everything that is wrong with a packet, as (path, code)."""
    found: list[tuple[str, str]] = []
    PACKET_RULES(packet, "packet", found)
    if isinstance(packet, dict) and not found:  # rules across fields hold for well-formed packets
        visual = packet["visual"]
        if visual["present"] and packet["policy"]["mode"] == "wireframe":
            found.append(("packet.visual.present", "forbidden_in_mode"))
        if visual["present"] and not (visual.get("format") and visual.get("sha256")):
            found.append(("packet.visual", "incomplete"))
        if "data_b64" in visual and not visual["present"]:
            found.append(("packet.visual.data_b64", "without_image"))
        for i, e in enumerate(packet["elements"]):
            token = (e.get("value") or {}).get("token")
            if token and token.split("#")[0] not in packet["redaction_legend"]:
                found.append((f"packet.elements[{i}].value", "not_in_legend"))
    return found


def plan_faults(plan: object) -> list[tuple[str, str]]:
    found: list[tuple[str, str]] = []
    PLAN_RULES(plan, "plan", found)
    return found


def leaves(value: object, at: str) -> Iterator[tuple[str, str]]:
    """Every string inside a JSON value with its path."""
    left = [(value, at)]
    while left:
        v, at = left.pop()
        if isinstance(v, str):
            yield at, v
        elif isinstance(v, list):
            left += [(x, f"{at}[{i}]") for i, x in enumerate(v) if isinstance(x, str | list | dict)][::-1]
        elif isinstance(v, dict):
            left += [(x, f"{at}.{k}") for k, x in v.items() if isinstance(x, str | list | dict)][::-1]


def _read(raw: str | None) -> tuple[bool, object]:
    def no_constant(name: str):
        raise ValueError(name)

    try:
        return True, json.loads(raw, parse_constant=no_constant) if raw is not None else None
    except (ValueError, RecursionError):
        return False, None


_FAULTS = "array<struct<path:string,code:string>>"


def _faults_of(rules: Callable[[object], list]) -> Callable[[Column], Column]:
    @F.pandas_udf(_FAULTS)
    def faults(raw: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            good, value = _read(text)
            return [{"path": p, "code": c} for p, c in (rules(value) if good and text is not None else [("", "not_json")])]

        return raw.map(one) if len(raw) else raw

    return faults


# ---------------------------------------------------------------- requests


def read_requests(requests: DataFrame, raw: str = "raw", most_bytes: int = MOST_REQUEST, registry: Registry | None = None) -> DataFrame:
    """``requests`` (request_id, raw: JSON text) with status, reason, n_faults and classes.

    413 body_too_large, 400 invalid_json, 422 schema_validation, 422 rescan_detected_pii, 200 received. A body over
    the limit is not parsed. Null bodies are no JSON.
    """
    ship(requests.sparkSession)
    rows = _checked(requests, raw, most_bytes)
    no_json = F.exists("_faults", lambda f: f["code"] == "not_json")
    found = rescan_json(rows.filter(F.size("_faults") == 0).select("request_id", F.col("_body").alias("raw")), registry=registry)
    found = found.groupBy("request_id").agg(F.array_sort(F.collect_set("cls")).alias("classes"))  # of 26 classes
    rows = rows.select("request_id", "_fits", "_faults").join(found, "request_id", "left")
    fits = F.col("_fits")
    reason = F.when(~fits, "body_too_large").when(no_json, "invalid_json").when(F.size("_faults") > 0, "schema_validation").when(F.col("classes").isNotNull(), "rescan_detected_pii").otherwise("received")
    status = F.when(~fits, 413).when(no_json, 400).when((F.size("_faults") > 0) | F.col("classes").isNotNull(), 422).otherwise(200)
    n = F.when(fits & ~no_json, F.size("_faults")).otherwise(0)
    return rows.select("request_id", status.alias("status"), reason.alias("reason"), n.alias("n_faults"), F.coalesce("classes", F.array().cast("array<string>")).alias("classes"), F.col("_faults").alias("faults"))


def _checked(requests: DataFrame, raw: str, most_bytes: int) -> DataFrame:
    """``requests`` with _fits, _body (null over the limit) and _faults: what is wrong with a body that fits."""
    fits = F.coalesce(F.octet_length(raw) <= most_bytes, F.lit(True))
    return requests.withColumn("_fits", fits).withColumn("_body", F.when(F.col("_fits"), F.col(raw))).withColumn("_faults", F.when(F.col("_fits"), _faults_of(packet_faults)(F.col("_body"))))


def failed_requests(requests: DataFrame, raw: str = "raw", most_bytes: int = MOST_REQUEST) -> DataFrame:
    """request_id, bytes and sha256 of the requests that ``read_requests`` answers with invalid_json; bodies go nowhere but through their own task."""
    ship(requests.sparkSession)
    failed = _checked(requests, raw, most_bytes).filter(F.exists("_faults", lambda f: f["code"] == "not_json"))
    return failed.select("request_id", attempt(F.col(raw)).alias("a")).select("request_id", "a.*")


#: Identifiers that machines make: their digits are no personal data.
_MADE_ID = r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}|[0-9a-hjkmnp-tv-z]{20,26})$"


def rescan_json(packets: DataFrame, key: str = "request_id", raw: str = "raw", threshold: float = TRIPWIRE, registry: Registry | None = None) -> DataFrame:
    """Spans in every string of a JSON text by itself, at any depth: key, path and cls. Digests, image bytes and a
    well-formed packet id are passed over. What is no JSON has no strings; strings that no recognizer can find anything in stay where they are read."""
    ship(packets.sparkSession)
    registry = registry or STANDARD
    rough = registry.rough

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = re.compile(rough).search if rough else lambda s: True

        def packed(batch: pa.RecordBatch, of: list, paths: list, texts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(paths, pa.string()), pa.array(texts, pa.string())], [key, "path", "text"])

        for batch in batches:
            of, paths, texts = [], [], []
            for i, body in enumerate(batch.column(1)):
                for path, said in leaves(_read(body.as_py())[1], "packet"):
                    if some(said):
                        of.append(i), paths.append(path), texts.append(said)
                if len(of) >= 10_000:
                    yield packed(batch, of, paths, texts)
                    of, paths, texts = [], [], []
            yield packed(batch, of, paths, texts)

    every = packets.select(key, raw).mapInArrow(run, StructType([packets.schema[key], StructField("path", StringType()), StructField("text", StringType())]))
    own_id = (F.col("path") == "packet.packet_id") & F.col("text").rlike(_MADE_ID)
    every = every.filter(~F.col("path").endswith(".sha256") & ~F.col("path").endswith(".data_b64") & ~own_id)
    return each_span(every, key, "path", spans=registry.analyze("text", threshold)).select(key, "path", F.col("s.cls").alias("cls"))


def attempt(raw: Column) -> Column:
    """What is recorded of an input that is no packet: its bytes and digest; of none at all, those of a fixed text."""
    said = F.coalesce(raw, F.lit("undefined"))
    return F.struct(F.octet_length(said).alias("bytes"), F.sha2(said.cast("binary"), 256).alias("sha256"))


def build_packets(meta: DataFrame, sanitized: dict[str, DataFrame], history: DataFrame | None = None) -> DataFrame:
    """Packets as JSON text: page_id, packet_id and raw.

    ``meta`` has page_id, packet_id, captured_at_ms, mode, origin_class, tls, page_kind, lang, w, h and dpr;
    ``sanitized`` is what ``policy.sanitize`` returns; ``history`` (page_id, step, action, element_label, result) is cut to
    its last entries. No image goes with these packets: see ``operators.intake`` for those that have one.
    """
    pack = lambda df, order, what: df.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, what.alias("x")))), lambda r: r["x"]).alias("xs"))  # noqa: E731  a page's regions are bounded
    # a null label is said, so elements are written one by one
    element = F.struct("id", "role", "label", F.array("box.x", "box.y", "box.w", "box.h").alias("box"), "evidence", "confidence", "source", "risk", "value")
    text_of = F.to_json(element)
    text_of = F.when(F.col("label").isNull(), F.concat(F.lit('{"label":null,'), F.substring(text_of, 2, 10_000_000))).otherwise(text_of)
    elements = pack(sanitized["elements"].filter(f"pos <= {MOST_ELEMENTS}"), ["pos"], text_of).withColumnRenamed("xs", "elements")
    texts = pack(sanitized["untrusted_text"], ["pos"], F.struct("src", "text")).select("page_id", F.slice("xs", 1, MOST_TEXTS).alias("texts"))
    legend = sanitized["legend"].groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("legend_key", F.struct(F.col("legend_key").alias("shape"), F.col("recoverable").alias("recoverable_by_client")))))).alias("legend"))
    rows = meta.join(elements, "page_id", "left").join(texts, "page_id", "left").join(legend, "page_id", "left").join(sanitized["summary"], "page_id", "left")
    rows = rows.join(sanitized["intents"].groupBy("page_id").agg(F.min("intent").alias("intent")), "page_id", "left")
    none = F.array().cast("array<struct<step:int,action:string,element_label:string,result:string>>")
    if history is not None:
        rows = rows.join(pack(history, ["step"], F.struct("step", "action", "element_label", "result")).select("page_id", F.slice("xs", F.greatest(F.size("xs") - MOST_HISTORY, F.lit(0)) + 1, F.lit(MOST_HISTORY)).alias("history")), "page_id", "left")
    else:
        rows = rows.withColumn("history", none)
    head = F.struct(
        F.lit(SCHEMA_ID).alias("schema"), "packet_id", "captured_at_ms", F.struct("mode", F.lit(POLICY_VERSION).alias("policy_version"), F.lit(True).alias("invariant_floor")).alias("policy"),
        F.struct(F.lit("none").alias("backend"), F.lit("T0").alias("tier"), F.struct("w", "h", "dpr").alias("viewport")).alias("device"),
        F.struct(F.col("origin_class").alias("class"), "tls", "page_kind", F.substring(F.coalesce("lang", F.lit("")), 1, 16).alias("lang")).alias("origin"),
        F.struct(F.lit(False).alias("present"), F.coalesce("regions_redacted", F.lit(0)).alias("regions_redacted")).alias("visual"),
        F.coalesce("legend", F.create_map().cast("map<string,struct<shape:string,recoverable_by_client:boolean>>")).alias("redaction_legend"),
        F.coalesce("texts", F.array().cast("array<struct<src:string,text:string>>")).alias("untrusted_text"),
    )
    body = F.to_json(head)
    # a null label of a step is said, too
    task = F.to_json(F.struct(F.struct(F.substring(F.coalesce("intent", F.lit("")), 1, MOST_INTENT).alias("intent"), F.coalesce("history", none).alias("history")).alias("task")), {"ignoreNullFields": "false"})
    listed = F.concat(F.lit(","), F.substring(task, F.lit(2), F.length(task) - 2), F.lit(',"elements":['), F.array_join(F.coalesce("elements", F.array().cast("array<string>")), ","), F.lit("]}"))
    return rows.select("page_id", "packet_id", F.concat(F.substring(body, F.lit(1), F.length(body) - 1), listed).alias("raw"))


# ---------------------------------------------------------------- answers

_PLAN = "struct<packet_id:string,steps:array<struct<action:string,target_element_id:string,value:struct<kind:string,token:string>,requires_confirmation:boolean>>>"


def plan_content(response: Column) -> Column:
    """The plan's JSON text inside a model's response: its content or the texts of its parts, without a code fence.
    Null where the response has neither."""
    message = F.get_json_object(response, "$.choices[0].message.content")
    parts = F.from_json(message, "array<struct<text:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")
    said = F.trim(F.when(message.startswith("["), joined).otherwise(message))
    fenced = F.regexp_extract(said, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(said), F.lit(""))


def guard_answers(answers: DataFrame, packets: DataFrame, vault: DataFrame | None = None, registry: Registry | None = None) -> DataFrame:
    """``answers`` (plan_id, packet_id: the packet asked about, raw: the plan's JSON text) with outcome and reasons.

    A plan is checked like a packet: its form (schema, which ends the checks), its steps against the packet (guard), its
    own text for personal data (tripwire) and for values of the session's vault (vault: session, token, value).
    ``packets`` has the schema of ``operators.gate.PACKET`` and session. Nothing passes by default. Each answer gives one
    row, repeated ones too; one about a packet_id that several packets have is refused by the guard, as it is not known which.
    """
    ship(answers.sparkSession)
    rows = answers.select("plan_id", "packet_id", "raw", _faults_of(plan_faults)(F.col("raw")).alias("_faults"), F.from_json("raw", _PLAN).alias("_plan")).withColumn("_formed", F.size("_faults") == 0)
    formed = F.col("_formed")
    steps = F.transform("_plan.steps", lambda s: F.struct(s["action"].alias("action"), s["target_element_id"].alias("target"), s["value"]["kind"].alias("value_kind"), s["value"]["token"].alias("token"), s["requires_confirmation"].alias("requires_confirmation")))
    # only the top-level id, where it is the one of the packet asked about, is left out; all else is read, whatever its key
    fields = F.map_entries(F.from_json("raw", "map<string,string>"))
    read = F.filter(fields, lambda e: ~((e["key"] == "packet_id") & e["value"].eqNullSafe(F.col("packet_id"))))
    bare = F.array_join(F.transform(read, lambda e: F.concat_ws("\n", e["key"], e["value"])), "\n")
    rows = rows.select("plan_id", "packet_id", "_formed", F.col("_plan.packet_id").alias("_answers"), F.when(formed, steps.cast(f"array<{planner.STEP}>")).alias("_steps"), F.when(formed, bare).alias("_bare"))
    rows = rows.withColumn("_tripped", F.size((registry or STANDARD).analyze("_bare", TRIPWIRE)) > 0)
    # an answer meets its packet once, and all but the vault is told in its row
    asked = packets.groupBy("packet_id").agg(F.first("session").alias("session"), F.first("elements").alias("_elements"), (F.count("*") > 1).alias("_several"))
    rows = rows.join(asked, "packet_id", "left").withColumn("_several", F.coalesce("_several", F.lit(False)))
    own = F.coalesce(F.aggregate(planner.problems_within(F.col("_steps"), F.col("_elements")), F.lit(0), lambda n, p: n + F.size(p)), F.lit(0)) + F.when(F.col("_answers").eqNullSafe(F.col("packet_id")), 0).otherwise(1)
    rows = rows.withColumn("_problems", F.when(formed & ~F.col("_several"), own).otherwise(0).cast("long")).drop("_elements")
    rows = durable_columns(rows.withColumn("_row", F.monotonically_increasing_id()))
    unsure = rows.filter(formed & F.col("_several"))
    if not unsure.select("_row").isEmpty():  # of several packets of one id, the elements of all count
        ids = unsure.select("packet_id").distinct()
        refused = planner.guard(unsure.select(F.col("_row").alias("plan_id"), "packet_id", F.col("_answers").alias("answers"), F.col("_steps").alias("steps")), packets.join(ids, "packet_id", "left_semi"))
        rows = rows.join(refused.groupBy(F.col("plan_id").alias("_row")).agg(F.count("*").alias("_refused")), "_row", "left").withColumn("_problems", F.coalesce("_refused", "_problems"))
    leaked = F.lit(False)
    if vault is not None:
        met = scan(rows.select("session", "_row", "_bare"), live(vault), payload="_bare", kept=["_row"]).select("_row").distinct()
        rows = rows.join(met.withColumn("_leaked", F.lit(True)), "_row", "left")
        leaked = F.coalesce("_leaked", F.lit(False))
    found = F.array(F.when((F.col("_problems") > 0) | F.col("_several"), "guard"), F.when(F.col("_tripped"), "tripwire"), F.when(leaked, "vault"))
    reasons = F.when(~formed, F.array(F.lit("schema"))).otherwise(F.filter(found, lambda r: r.isNotNull()))
    rows = rows.withColumn("reasons", reasons)
    return rows.select("plan_id", "packet_id", F.when(F.size("reasons") == 0, "pass").otherwise("blocked").alias("outcome"), "reasons", F.when(formed, F.size("_steps")).alias("n_steps"), F.col("_problems").alias("n_problems"))


def choose_plans(local: DataFrame, configured: DataFrame) -> DataFrame:
    """Which plan answers a packet, of the deterministic one and a configured planner's: packet_id, used and fallback.

    ``local`` has packet_id, page_kind, asks (see ``planner.wants_model``), n_steps and the first step's action, target,
    value_kind and requires_confirmation; ``configured`` has packet_id, failed, problems, n_steps and its own first step.
    The configured plan is used if it came, is guarded, is not empty where the local one is not, and, on forms, agrees
    with the local step; there it only confirms the local plan.
    """
    fields = ("action", "target", "value_kind", "requires_confirmation")
    told = configured.select("packet_id", "failed", "problems", F.col("n_steps").alias("_n"), *[F.col(c).alias(f"_{c}") for c in fields])
    rows = local.join(told, "packet_id", "left")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    agrees = F.when((F.col("n_steps") == 0) | (F.col("_n") == 0), F.col("n_steps") == F.col("_n")).otherwise(same)
    form = F.col("page_kind").startswith("form")
    why = F.when(~F.col("asks"), F.lit(None)).when(F.coalesce("failed", F.lit(True)), "failed").when((F.col("_n") == 0) & (F.col("n_steps") > 0), "empty").when(form & ~agrees, "disagrees").when(F.col("problems") > 0, "guard")
    rows = rows.withColumn("fallback", why)
    return rows.select("packet_id", F.when(F.col("asks") & F.col("fallback").isNull(), F.when(form, "local_confirmed").otherwise("configured")).otherwise("local").alias("used"), "fallback")


def planner_config(env: Column) -> Column:
    """A planner's settings from a MAP<STRING, STRING> of variables, with defaults; null without an endpoint."""
    said = lambda name: F.nullif(F.trim(F.try_element_at(env, F.lit(name))), F.lit(""))
    amount = lambda name, least, most, strict, usual: (lambda n: F.when(((n > least) if strict else (n >= least)) & (n <= most), n).otherwise(usual))(said(name).try_cast("double"))
    mode = said("PLANNER_MODE")
    settings = F.struct(
        said("PLANNER_ENDPOINT").alias("endpoint"), F.coalesce(said("PLANNER_MODEL"), F.lit("default")).alias("model"), amount("PLANNER_TIMEOUT_MS", 0, 1e300, True, 30_000.0).alias("timeout_ms"),
        amount("PLANNER_TEMPERATURE", 0, 2, False, 0.0).alias("temperature"), F.when(mode.isin("heuristic", "model", "auto"), mode).otherwise("auto").alias("mode"),
    )
    return F.when(said("PLANNER_ENDPOINT").isNotNull(), settings)


#: Rules of a planner's prompt, in words of this engine; a form's page adds the last two.
_PROMPT = (
    "Answer with one JSON object of schema " + PLAN_ID + " for packet {packet_id}.", "Use only elements of the packet, by id; never give coordinates.", "A step on an element with a risk needs requires_confirmation.",
    "Do not make up private values: name a placeholder for its own element, or ask the user, once for each element.", "Leave elements alone whose value is filled or a placeholder, unless they are invalid.",
    "Put navigation after data entry.", "For a file field give a click; the user picks the file.",
)
_FORM_PROMPT = ("The page is a form: give one step only.", "Do not submit while a required field is empty or invalid.")


def system_prompt(packet_id: Column, page_kind: Column) -> Column:
    usual = F.concat(*[F.concat(*[packet_id if p == "{packet_id}" else F.lit(p) for p in re.split(r"(\{packet_id\})", line) if p], F.lit("\n")) for line in _PROMPT])
    return F.when(page_kind.startswith("form"), F.concat(usual, F.lit("\n".join(_FORM_PROMPT)))).otherwise(usual)


def resolve_steps(steps: DataFrame, remembered: DataFrame, supplied: DataFrame, vault: DataFrame) -> DataFrame:
    """Where each step's value comes from: ``steps`` (session, step, value_kind, memory_key, field_id, token, literal, rejected, asked)
    with value, origin and confirm.

    A prompt takes the remembered value (not one that the form rejected), else the one that the task supplied, else it is
    asked for, once: a question asked before stops the plan. A placeholder takes the vault's value, and needs consent if its
    class is invariant; without one it is asked for in the same way. A literal is itself.
    """
    from sparkveil.functions.taxonomy import is_invariant, token_class

    rows = steps.join(remembered.select("session", "memory_key", F.col("value").alias("_kept")), ["session", "memory_key"], "left")
    rows = rows.join(supplied.select("session", "field_id", F.col("value").alias("_given")), ["session", "field_id"], "left")
    rows = rows.join(vault.filter("not overflow").select("session", "token", F.col("value").alias("_held")), ["session", "token"], "left")
    prompt, holds = F.col("value_kind") == "user_prompt", F.col("value_kind") == "placeholder"
    stop = F.col("asked") | F.col("memory_key").isNull()
    value = F.when(prompt, F.coalesce(F.when(~F.col("rejected"), F.col("_kept")), F.when(~F.col("rejected"), F.col("_given")))).when(holds, F.col("_held")).otherwise(F.col("literal"))
    origin = F.when(prompt & F.col("rejected") & F.col("asked"), "stopped").when(prompt & ~F.col("rejected") & F.col("_kept").isNotNull(), "remembered").when(prompt & ~F.col("rejected") & F.col("_given").isNotNull(), "supplied")
    origin = origin.when(holds & F.col("_held").isNotNull(), "vault").when(prompt | holds, F.when(stop, "stopped").otherwise("ask")).otherwise(F.coalesce("value_kind", F.lit("none")))
    confirm = holds & F.col("_held").isNotNull() & is_invariant(token_class(F.col("token")))
    return rows.select("session", "step", value.alias("value"), origin.alias("origin"), F.coalesce(confirm, F.lit(False)).alias("confirm"))


__all__ = ["PACKET", "attempt", "build_packets", "choose_plans", "guard_answers", "packet_faults", "plan_content", "plan_faults", "planner_config", "read_requests", "rescan_json", "resolve_steps", "system_prompt"]

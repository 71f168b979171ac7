"""The sanitizer: what of a page's regions and texts leaves, under a privacy mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.scalars import length_bucket, magnitude_bucket
from sparkveil.functions.taxonomy import THRESHOLDS, is_invariant, legend_key, redacts
from sparkveil.operators.intervals import overlapping
from sparkveil.operators.recognizers import STANDARD, Registry, each_span
from sparkveil.operators.vault import CAP, mint
from sparkveil.sources.durable import durable

MOST_TEXT, MOST_FILLED, MOST_LABEL, MOST_EVIDENCE = 4000, 2000, 300, 16
CONTROLS = ("textbox", "password", "combobox", "listbox", "checkbox", "radio", "slider", "switch")
#: Channels of a region in the order in which they are read; a task's intent comes after all regions.
VALUE, TEXT, LABEL = 0, 1, 2
LAST = 2**31 - 1

REGION = """page_id string, pos int, id string, role string, label string, box struct<x:double,y:double,w:double,h:double>, source string,
    confidence double, evidence array<string>, explained boolean, raw_value string, raw_text string, structural_class string, visual_class string,
    input_type string, risk string"""


def _redacted_spans(text: str, mode: str, registry: Registry) -> Column:
    """Spans that the mode redacts. They are chosen after overlaps are resolved: a milder winner still hides a loser."""
    return F.filter(registry.analyze(text, THRESHOLDS[mode]), lambda s: redacts(mode, s["cls"]))


def replaced(text: Column, cuts: Column) -> Column:
    """``text`` with each cut (start, end, token; in order, disjoint) replaced by its token."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), c["token"])
        return F.struct(out.alias("out"), c["end"].alias("at"))

    folded = F.aggregate(cuts, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))
    return F.when(F.size(cuts) > 0, folded).otherwise(text)


def sanitize_texts(texts: DataFrame, mode: str, session: str = "session", key: tuple[str, ...] = ("pos",), text: str = "text", registry: Registry | None = None, cap: int = CAP) -> DataFrame:
    """``texts`` with clean: each redacted span replaced by its session's token, and n_redacted.

    ``key`` orders the texts of a session, and with the session names a row: tokens are numbered by key, then by place in
    the text. A null text stays null.
    """
    seen = texts.withColumn("_spans", _redacted_spans(text, mode, registry or STANDARD))
    cuts = each_span(seen, session, *key, spans="_spans").select(
        session, *key, F.col("s.cls").alias("cls"), F.coalesce("s.normalized", "s.text").alias("value"), F.struct(*key, F.col("s.start")).alias("seq"), F.col("s.start").alias("start"), F.col("s.end").alias("end")
    )
    vault = mint(cuts.select(session, "cls", "value", "seq"), session, cap)
    tokens = cuts.join(vault.select(session, "cls", "value", "token"), [session, "cls", "value"])
    own = tokens.groupBy(session, *key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("_cuts"))
    met = texts.join(own, [session, *key], "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<struct<start:int,end:int,token:string>>")))
    return met.withColumn("clean", replaced(F.col(text), F.col("_cuts"))).withColumn("n_redacted", F.size("_cuts")).drop("_cuts")


def cross_region(regions: DataFrame, mode: str, registry: Registry | None = None) -> DataFrame:
    """Regions that carry part of a value split over a visual line: page_id, id, cls and the reassembled value.

    Regions with text are read by (y, x) and join the first line whose first member is within the
    tolerance, half the lesser height or 8 pixels. A page's regions are folded in that order; pages are
    bounded by what perception reports.
    """
    said = F.trim(F.coalesce("raw_text", "raw_value", F.lit("")))
    textual = regions.withColumn("part", said).filter("part <> ''")
    member = F.struct(F.col("box.y").alias("y"), F.col("box.x").alias("x"), F.col("pos").alias("pos"), F.col("box.h").alias("h"), F.col("id").alias("id"), F.col("part").alias("part"))
    pages = textual.groupBy("page_id").agg(F.array_sort(F.collect_list(member)).alias("m"))
    none = F.array().cast("array<array<struct<y:double,x:double,pos:int,h:double,id:string,part:string>>>")

    def place(lines: Column, r: Column) -> Column:
        fits = F.transform(lines, lambda line: F.abs(F.get(line, F.lit(0))["y"] - r["y"]) <= F.greatest(F.lit(8.0), F.least(F.get(line, F.lit(0))["h"], r["h"]) / 2))
        at = F.array_position(fits, F.lit(True))
        grown = F.transform(lines, lambda line, i: F.when(i + 1 == at, F.concat(line, F.array(r))).otherwise(line))
        return F.when(at > 0, grown).otherwise(F.concat(lines, F.array(F.array(r))))

    lines = pages.select("page_id", F.explode(F.aggregate("m", none, place)).alias("line")).filter(F.size("line") > 1)
    ordered = F.transform(F.array_sort(F.transform("line", lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["pos"].alias("pos"), r.alias("r")))), lambda s: s["r"])
    lines = lines.select("page_id", ordered.alias("line"))
    joined = F.array_join(F.transform("line", lambda r: r["part"]), " ")
    lines = lines.withColumn("_joined", joined).select("page_id", "line", _redacted_spans("_joined", mode, registry or STANDARD).alias("spans")).filter(F.size("spans") > 0)
    # where each part begins and ends in the joined text
    bounds = F.aggregate(
        "line", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<id:string,start:int,end:int>>").alias("out")),
        lambda acc, r: F.struct((acc["at"] + F.length(r["part"]) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(r["id"].alias("id"), acc["at"].alias("start"), (acc["at"] + F.length(r["part"])).alias("end"))).cast("array<struct<id:string,start:int,end:int>>")).alias("out")),
        lambda acc: acc["out"],
    )
    lines = durable(lines.select("page_id", F.monotonically_increasing_id().alias("line_no"), bounds.alias("parts"), "spans"))
    parts = lines.select("line_no", F.explode("parts").alias("p")).select("line_no", F.col("p.id").alias("id"), F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"))
    spans = each_span(lines, "page_id", "line_no").select("page_id", "line_no", "s", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    met = overlapping(spans, parts, ["line_no"], ("start", "end"), ("p_start", "p_end"))
    split = met.groupBy("line_no", "start", "end", F.col("s.cls").alias("cls")).agg(F.count("*").alias("n"), F.first("page_id").alias("page_id"), F.first(F.coalesce("s.normalized", "s.text")).alias("value"), F.collect_list("id").alias("ids")).filter("n > 1")
    hits = split.select("page_id", F.explode("ids").alias("id"), F.struct("cls", "value").alias("v"), "start")
    return hits.groupBy("page_id", "id").agg(F.max_by("v", "start").alias("v")).select("page_id", "id", F.col("v.cls").alias("cross_class"), F.col("v.value").alias("cross_value"))


def decide(regions: DataFrame, mode: str, registry: Registry | None = None) -> DataFrame:
    """``regions`` with the branch that each value takes, and the class and value to mint, if any.

    Branches, the first that fits: cross (part of a split value), masked (pixels that no element
    explains), visual, structural, detected, withheld (strict modes send no unclassified value), filled,
    empty, none.
    """
    registry = registry or STANDARD
    regions = regions.join(durable(cross_region(regions, mode, registry)), ["page_id", "id"], "left")
    prefix = F.when(F.coalesce("label", F.lit("")) == "", "").otherwise(F.concat("label", F.lit(": ")))
    regions = regions.withColumn("_said", F.concat(prefix, F.col("raw_value")))
    spans = F.filter(_redacted_spans("_said", mode, registry), lambda s: s["start"] >= F.length(prefix))
    filled = F.coalesce(F.col("raw_value") != "", F.lit(False))
    open_value = filled & F.col("structural_class").isNull()
    regions = regions.withColumn("_hit", F.when(F.col("cross_class").isNull() & F.col("visual_class").isNull() & open_value, F.get(spans, F.lit(0))))
    masked = ~F.coalesce("explained", F.lit(False)) & (F.col("source") == "vision") & F.col("visual_class").isNull()
    branch = (
        F.when(F.col("cross_class").isNotNull(), "cross").when(masked, "masked").when(F.col("visual_class").isNotNull(), "visual")
        .when(filled & F.col("structural_class").isNotNull(), F.when(redacts(mode, F.col("structural_class")), "structural").otherwise("filled"))
        .when(filled & F.col("_hit").isNotNull(), "detected").when(filled, "filled" if mode == "shield" else "withheld")
        .when(F.col("role").isin(*CONTROLS) | F.coalesce(F.col("input_type") == "file", F.lit(False)), "empty").otherwise("none")
    )
    regions = regions.withColumn("branch", branch)
    b = F.col("branch")
    cls = F.when(b == "cross", F.col("cross_class")).when(b == "visual", F.col("visual_class")).when(b == "structural", F.col("structural_class")).when(b == "detected", F.col("_hit.cls"))
    value = F.when(b == "cross", F.col("cross_value")).when(b == "visual", F.concat(F.lit("region:"), F.col("id"))).when(b == "structural", F.col("raw_value")).when(b == "detected", F.coalesce("_hit.normalized", "_hit.text"))
    size = F.length(F.when(b == "detected", F.col("raw_value")).otherwise(value))
    more = F.when(b == "cross", F.array(F.lit("pattern:cross-region"))).when((b == "masked") & ~F.array_contains("evidence", "fusion:no-dom-node"), F.array(F.lit("fusion:no-dom-node")))
    more = more.when(b == "detected", F.slice("_hit.evidence", 1, 3)).otherwise(F.array().cast("array<string>"))
    regions = regions.withColumn("mint_class", cls).withColumn("mint_value", value).withColumn("mint_length", size)
    return regions.withColumn("evidence", F.slice(F.concat(F.coalesce("evidence", F.array().cast("array<string>")), more), 1, MOST_EVIDENCE)).drop("_hit", "_said", "cross_class", "cross_value")


def sanitize(regions: DataFrame, mode: str, intents: DataFrame | None = None, registry: Registry | None = None, cap: int = CAP) -> dict[str, DataFrame]:
    """Sanitize pages of regions (schema REGION) and their tasks' intents (page_id, intent): the tables of what may leave.

    elements: one row per region with clean label, evidence and value; untrusted_text: the clean free
    texts; intents; vault: the pages' tokens; legend: classes used, whether a value is recoverable;
    summary: counts. A page is a session of its own.
    """
    registry = registry or STANDARD
    decided = durable(decide(durable(regions), mode, registry))  # regions are read twice, and pages are parsed for them
    texts = [
        decided.filter("branch <> 'cross' and trim(coalesce(raw_text, '')) <> ''").select("page_id", "pos", F.lit(TEXT).alias("channel"), "id", F.col("raw_text").alias("text")),
        decided.filter("coalesce(label, '') <> ''").select("page_id", "pos", F.lit(LABEL).alias("channel"), "id", F.col("label").alias("text")),
    ]
    if intents is not None:
        texts.append(intents.select("page_id", F.lit(LAST).alias("pos"), F.lit(TEXT).alias("channel"), F.lit(None).cast("string").alias("id"), F.col("intent").alias("text")))
    texts = reduce(DataFrame.unionByName, texts)
    seen = texts.withColumn("_spans", _redacted_spans("text", mode, registry))
    cuts = each_span(seen, "page_id", "pos", "channel", spans="_spans").select(
        "page_id", "pos", "channel", F.col("s.cls").alias("cls"), F.coalesce("s.normalized", "s.text").alias("value"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit(False).alias("shown")
    )
    cuts = durable(cuts)
    values = decided.filter("mint_class is not null").select(
        "page_id", "pos", F.lit(VALUE).alias("channel"), F.col("mint_class").alias("cls"), F.col("mint_value").alias("value"), F.lit(0).alias("start"), F.lit(0).alias("end"), (F.col("branch") != "visual").alias("shown")
    )
    attempts = cuts.unionByName(values).withColumn("seq", F.struct("pos", "channel", "start"))
    vault = mint(attempts.select("page_id", "cls", "value", "seq"), "page_id", cap)
    tokens = attempts.join(vault.select("page_id", "cls", "value", "token", "overflow"), ["page_id", "cls", "value"])
    own = tokens.filter(f"channel <> {VALUE}").groupBy("page_id", "pos", "channel").agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("cuts"))
    clean = texts.join(own, ["page_id", "pos", "channel"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<start:int,end:int,token:string>>")))
    clean = clean.withColumn("clean", replaced(F.col("text"), F.col("cuts"))).drop("cuts", "text")

    minted = tokens.filter(f"channel = {VALUE}").select("page_id", "pos", "token", "overflow")
    labels = clean.filter(f"channel = {LABEL}").select("page_id", "pos", F.substring("clean", 1, MOST_LABEL).alias("_label"))
    rows = decided.join(minted, ["page_id", "pos"], "left").join(labels, ["page_id", "pos"], "left")
    b, cls = F.col("branch"), F.col("mint_class")
    placed = b.isin("cross", "structural", "detected") & ~F.coalesce("overflow", F.lit(False))
    kind = F.when(placed, "placeholder").when(b.isin("cross", "structural", "detected", "visual", "withheld"), "redacted").when(b == "masked", "unexplained_masked").when(b.isin("filled", "empty"), b)
    bucket = F.when(placed & (cls == "AMOUNT"), magnitude_bucket(F.col("mint_value")))
    value = F.struct(
        kind.alias("kind"), F.when(b == "filled", F.substring("raw_value", 1, MOST_FILLED)).alias("text"), F.when(~F.coalesce("overflow", F.lit(True)), F.col("token")).alias("token"),
        F.when(placed & ~is_invariant(cls) & bucket.isNull(), F.col("mint_length")).alias("length"), F.when(placed & is_invariant(cls), length_bucket(F.col("mint_length"))).alias("length_bucket"),
        bucket.alias("magnitude_bucket"), F.when(bucket.isNotNull(), "INR").alias("currency"), F.when(placed, is_invariant(cls)).alias("masked"),
    )
    elements = rows.select("page_id", "pos", "id", "role", F.coalesce("_label", "label").alias("label"), "box", "evidence", "confidence", "source", "risk", "branch", F.when(kind.isNotNull(), value).alias("value"))
    used = tokens.groupBy("page_id", "cls").agg(F.coalesce(F.bool_or(F.col("shown") & ~F.col("overflow")), F.lit(False)).alias("recoverable"))
    legend = used.select("page_id", legend_key(F.col("cls")).alias("legend_key"), "recoverable")
    noted = decided.groupBy("page_id").agg(F.count("mint_class").alias("by_value"), F.count_if(b == "masked").alias("unexplained_masked"))
    over = tokens.groupBy("page_id").agg(F.count_if("overflow").alias("vault_overflows"))
    summary = noted.join(over, "page_id", "left").select("page_id", (F.col("by_value") + F.col("unexplained_masked")).alias("regions_redacted"), "unexplained_masked", F.coalesce("vault_overflows", F.lit(0)).alias("vault_overflows"))
    return {
        "elements": elements,
        "untrusted_text": clean.filter(f"channel = {TEXT} and id is not null").select("page_id", "pos", F.col("id").alias("src"), F.substring("clean", 1, MOST_TEXT).alias("text")),
        "intents": clean.filter(f"channel = {TEXT} and id is null").select("page_id", F.col("clean").alias("intent")),
        "vault": vault, "legend": legend, "summary": summary,
    }

"""Finding again what was seen: targets of steps, lost answers and reviewed uploads in a newer snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkveil.operators.prompts import normalized_label

TOLERANCE = 48.0
LOOSE = 40


def reground(targets: DataFrame, current: DataFrame) -> DataFrame:
    """``targets`` with problem: why the element of that id is no longer the one that was seen; null if it is.

    Both have page_id, id, role, label, box, disabled and readonly, current also visible. The first rule
    that fails is told. Labels are compared loosely, as counters in them change; a null state was not seen.
    """
    now = current.select("page_id", "id", *[F.col(c).alias(f"_{c}") for c in ("role", "label", "box", "visible", "disabled", "readonly")], F.lit(True).alias("_there"))
    rows = targets.join(now, ["page_id", "id"], "left")
    b, n = F.col("box"), F.col("_box")
    moved = F.hypot(n["x"] - b["x"], n["y"] - b["y"])
    label, fresh = F.col("label"), F.coalesce("_label", F.lit(""))
    same = (fresh != "") & (fresh.contains(F.substring(label, 1, LOOSE)) | label.contains(F.substring(fresh, 1, LOOSE)))
    differs = lambda c: F.coalesce(F.col(c) != F.coalesce(f"_{c}", F.lit(False)), F.lit(False))
    problem = (
        F.when(F.col("_there").isNull(), "element no longer in the document").when(F.col("_role") != F.col("role"), "element role changed since capture")
        .when(moved > TOLERANCE, F.concat(F.lit("element moved "), F.floor(moved + 0.5).cast("string"), F.lit("px since capture")))
        .when((F.abs(n["w"] - b["w"]) > TOLERANCE) | (F.abs(n["h"] - b["h"]) > TOLERANCE), "element size changed since capture")
        .when(F.coalesce(label != "", F.lit(False)) & ~same, "element label changed since capture").when(~F.coalesce("_visible", F.lit(False)), "element is no longer visible")
        .when(differs("disabled"), "element disabled state changed since capture").when(differs("readonly"), "element readonly state changed since capture")
    )
    return rows.withColumn("problem", problem).drop("_role", "_label", "_box", "_visible", "_disabled", "_readonly", "_there")


def lost_answers(entered: DataFrame, current: DataFrame) -> DataFrame:
    """The first entered field of each page whose answer the page has lost: page_id, field, region and attempts.

    entered: page_id, seq, id, label, ordinal, attempts. current: page_id, pos, id, label, filled, invalid,
    disabled, readonly. The field is found by id and label, else by its ordinal among fields of that
    label. Fields that are filled and valid are not lost; invalid ones only after two attempts.
    """
    seen = current.withColumn("_norm", normalized_label(F.col("label"))).withColumn("_nth", F.row_number().over(W.partitionBy("page_id", "_norm").orderBy("pos")) - 1)
    asked = entered.withColumn("_norm", normalized_label(F.col("label"))).filter("_norm <> ''").select("page_id", "seq", F.col("id").alias("field"), "_norm", "ordinal", "attempts")
    state = F.struct("id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("filled", "invalid", "disabled", "readonly")])
    exact = seen.select("page_id", "_norm", F.col("id").alias("field"), state.alias("_exact"))
    nth = seen.select("page_id", "_norm", F.col("_nth").alias("ordinal"), state.alias("_by_place"))
    rows = asked.join(exact, ["page_id", "_norm", "field"], "left").join(nth, ["page_id", "_norm", "ordinal"], "left").withColumn("r", F.coalesce("_exact", "_by_place"))
    lost = rows.filter("r is not null and not r.disabled and not r.readonly and not (r.filled and not r.invalid) and not (r.invalid and attempts < 2)")
    return lost.groupBy("page_id").agg(F.min_by(F.struct("field", F.col("r.id").alias("region"), "attempts"), "seq").alias("x")).select("page_id", "x.*")


def upload_targets(reviewed: DataFrame, current: DataFrame) -> DataFrame:
    """``reviewed`` (page_id, id, label) with found: the file field to fill, by id and label, else by a label that
    only one file field of ``current`` (page_id, id, label, input_type) has; null where that is not sure."""
    files = current.filter("input_type = 'file'").withColumn("_norm", normalized_label(F.col("label")))
    rows = reviewed.withColumn("_norm", normalized_label(F.col("label")))
    exact = files.select("page_id", "id", "_norm", F.col("id").alias("_exact"))
    alone = files.groupBy("page_id", "_norm").agg(F.count("*").alias("_n"), F.min("id").alias("_only")).filter("_n = 1 and _norm <> ''").drop("_n")
    met = rows.join(exact, ["page_id", "id", "_norm"], "left").join(alone, ["page_id", "_norm"], "left")
    return met.withColumn("found", F.coalesce("_exact", "_only")).drop("_exact", "_only", "_norm")


# fixed values: calls that reach the network
NETWORK = (r"\bfetch\s*\(", r"\bXMLHttpRequest\b", r"\bnew\s+WebSocket\b", r"\bnavigator\.sendBeacon\b")


def network_calls(files: DataFrame, allowed: DataFrame) -> DataFrame:
    """Source files (path, content) that call the network outside comments and are not in ``allowed`` (path): path, line, call."""
    bare = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), r"(?m)^\s*//.*$", "")
    rows = files.join(allowed.select("path").distinct(), "path", "left_anti").filter(~F.col("path").endswith(".test.ts")).select("path", bare.alias("text"))
    found = F.explode(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.regexp_extract("text", f"({p})", 1).alias("call"), (F.size(F.split(F.regexp_extract("text", f"(?s)^(.*?){p}", 1), "\n", -1))).alias("line"))) for p in NETWORK]))
    return rows.select("path", found.alias("x")).filter("x is not null").select("path", "x.line", "x.call")

"""Scores of detections and redactions against labelled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.geometry import iou
from sparkveil.functions.scalars import safe_div
from sparkveil.operators.areas import union_areas
from sparkveil.operators.choices import one_to_one

MATCH_IOU = 0.5


def match(truth: DataFrame, predictions: DataFrame, key: str = "capture_id", least: float = MATCH_IOU, by_class: bool = True) -> DataFrame:
    """(key, g, p, iou): greedy matches of ``truth`` (key, g, cls, box) and ``predictions`` (key, p, cls, box) within each key.

    Candidates come from an equi-join on key and class; the largest overlap is taken first, then the least g and p.
    """
    on = [key, "cls"] if by_class else [key]
    left = truth.select(*on, "g", F.col("box").alias("_a"))
    right = predictions.select(*on, "p", F.col("box").alias("_b"))
    met = left.join(right, on).withColumn("iou", iou(F.col("_a"), F.col("_b"))).filter(F.col("iou") >= least)
    return one_to_one(met.select(key, "g", "p", "iou"), key, [-F.col("iou"), F.col("g"), F.col("p")])


def false_alarms(truth: DataFrame, predictions: DataFrame, matched: DataFrame, key: str = "capture_id", least: float = MATCH_IOU) -> DataFrame:
    """(key, g): declared negatives that an unmatched prediction covers, whatever class it claims. Each prediction
    takes the first negative not taken yet."""
    free = predictions.join(matched.select(key, "p"), [key, "p"], "left_anti").select(key, "p", F.col("box").alias("_b"))
    negatives = truth.filter("not must_redact").select(key, "g", F.col("box").alias("_a"))
    met = free.join(negatives, key).filter(iou(F.col("_a"), F.col("_b")) >= least)
    return one_to_one(met.select(key, "g", "p"), key, [F.col("p"), F.col("g")]).select(key, "g")


def _rates(df: DataFrame) -> DataFrame:
    p, r = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def score_classes(truth: DataFrame, predictions: DataFrame, matched: DataFrame, key: str = "capture_id") -> DataFrame:
    """Support, hits and rates of each class that has positives."""
    positives = truth.filter("must_redact")
    got = positives.join(matched.select(key, "g", F.lit(1).alias("hit")), [key, "g"], "left")
    per = got.groupBy("cls").agg(F.count("*").alias("support"), F.count("hit").alias("tp"))
    missed = predictions.join(matched.select(key, "p"), [key, "p"], "left_anti").groupBy("cls").agg(F.count("*").alias("fp"))
    rows = per.join(missed, "cls", "left").withColumn("fp", F.coalesce("fp", F.lit(0))).withColumn("fn", F.col("support") - F.col("tp"))
    return _rates(rows)


def score_all(truth: DataFrame, predictions: DataFrame, matched: DataFrame, key: str = "capture_id") -> DataFrame:
    """One row: micro counts and rates over all classes, leak rate of invariant and high severity, and false alarms."""
    positives = truth.filter("must_redact").join(matched.select(key, "g", F.lit(1).alias("hit")), [key, "g"], "left")
    grave = F.col("severity").isin("invariant", "high")
    a = positives.agg(F.count("hit").alias("tp"), (F.count("*") - F.count("hit")).alias("fn"), F.count_if(grave).alias("grave"), F.count_if(grave & F.col("hit").isNotNull()).alias("grave_hit"))
    b = predictions.agg(F.count("*").alias("n"))
    alarms = false_alarms(truth, predictions, matched, key).agg(F.count("*").alias("false_alarms"))
    # three one-row aggregates side by side
    rows = a.join(b).join(alarms).withColumn("fp", F.col("n") - F.col("tp"))
    leak = F.when(F.col("grave") == 0, 0.0).otherwise(1 - F.col("grave_hit") / F.nullif(F.col("grave"), F.lit(0)))
    return _rates(rows).withColumn("leak_rate", leak).drop("n", "grave", "grave_hit")


def leaks(truth: DataFrame, matched: DataFrame, key: str = "capture_id") -> DataFrame:
    """Positives of invariant or high severity that nothing matched."""
    return truth.filter("must_redact and severity in ('invariant', 'high')").join(matched.select(key, "g"), [key, "g"], "left_anti")


def score_redaction(truth: DataFrame, masks: DataFrame, key: str = "page_id", overlap: bool = True) -> DataFrame:
    """Coverage, over-masking and mean overlap of ``masks`` (key, p, box) over ``truth`` (key, g, box), for each key.

    Without ``overlap`` there is no mean overlap, and masks are not matched with truth.
    """
    kinds = lambda df, *names: df.select(key, F.explode(F.array(*map(F.lit, names))).alias("_kind"), "box")
    covered = union_areas(kinds(truth, "t", "u").unionByName(kinds(masks, "m", "u")), [key, "_kind"])
    part = lambda k: F.coalesce(F.max(F.when(F.col("_kind") == k, F.col("area"))), F.lit(0.0)).alias(k)
    met = covered.groupBy(key).agg(part("t"), part("m"), part("u")).withColumn("i", F.col("t") + F.col("m") - F.col("u"))
    coverage = F.when(F.col("t") == 0, 1.0).otherwise(F.col("i") / F.nullif(F.col("t"), F.lit(0.0)))
    over = F.when(F.col("m") == 0, 0.0).otherwise((F.col("m") - F.col("i")) / F.nullif(F.col("m"), F.lit(0.0)))
    scores = met.select(key, coverage.alias("coverage"), over.alias("over_mask"))
    if not overlap:
        return scores
    pairs = match(truth, masks, key, 0.01, by_class=False).groupBy(key).agg(F.avg("iou").alias("mean_iou"))
    return scores.join(pairs, key, "left").withColumn("mean_iou", F.coalesce("mean_iou", F.lit(0.0)))

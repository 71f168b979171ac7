"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import durable, join_by_weight, workers


def uniform(seed: int, *columns: str) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of an MD5 of the seed and the columns."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return (F.conv(F.substring(F.md5(said.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def poisson_cdf(mean: float) -> tuple[int, np.ndarray]:
    """The least count that matters, and the cumulated Poisson probabilities of it and of those above, for any mean.

    Counts 12 standard deviations below the mean have less chance together than the least hashed number,
    and what lies above the last (see ``bound``) less than doubles can tell from 1.
    """
    first, last = max(0, math.floor(mean - 12 * math.sqrt(mean))), bound(mean) - 1
    with np.errstate(divide="ignore"):
        # by ratios of neighbours, in logarithms: no term under- or overflows
        grown = np.concatenate([[0.0], np.cumsum(np.log(mean / np.arange(first + 1, last + 1, dtype=np.float64)))])
    terms = np.exp(grown - grown.max())
    return first, np.cumsum(terms) / terms.sum()


def source_rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0) -> tuple[DataFrame, int]:
    """Each source's key, rows and mean repetition rate; and the number of all rows.

    ``weights`` gives target weights (a source not named has 0); without it the weight of a source is
    its rows to the ``power``. The rate is epochs * all rows * (weight / all weights) / the source's
    rows; a rate may be of any size. ``epochs`` is the mean rate of all rows; one over 700 is refused.
    """
    if epochs > 700:
        raise ValueError("the mean repetition rate of all rows, epochs, exceeds 700")
    key = source_key(source)
    counts = docs.groupBy(key.alias("_sv_key")).agg(F.count("*").alias("_sv_n"))
    if weights is None:
        weight = F.pow(F.col("_sv_n").cast("double"), F.lit(float(power)))
        counts = durable(counts.withColumn("_sv_w", weight))
    else:
        table = docs.sparkSession.createDataFrame([("s" + k, float(v)) for k, v in weights.items()], "_sv_key string, _sv_w double")
        counts = durable(counts.join(F.broadcast(table), "_sv_key", "left").fillna(0.0, ["_sv_w"]))  # the caller's own dictionary
    total, mass = counts.agg(F.sum("_sv_n"), F.sum("_sv_w")).head()
    total, mass = total or 0, mass or 0.0
    rate = F.lit(float(epochs) * total) * (F.col("_sv_w") / F.lit(mass or 1.0)) / F.col("_sv_n")
    rates = counts.select("_sv_key", "_sv_n", rate.alias("_sv_rate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                got = [poisson_cdf(r) for r in part.column("_sv_rate").to_pylist()]
                arrays = [pa.array([f for f, _ in got], pa.int64()), pa.array([c for _, c in got], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, "_sv_least", "_sv_cdf"])

    return workers(rates).mapInArrow(run, "_sv_key string, _sv_n long, _sv_rate double, _sv_least long, _sv_cdf array<double>"), total


def source_key(source: str) -> Column:
    """The source as text that is never null: a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def mix(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: int = 8) -> DataFrame:
    """Every document repeated by a Poisson count with its source's mean rate, in a random global order.

    The count inverts the distribution at a number hashed from the seed and doc_id, so it is the same on
    any cluster and rows alike in doc_id get the same count. Adds repetition (from 1 on; an existing
    column is replaced). Rows of count 0 go. Null texts and sources, and empty texts, are rows like others.
    """
    docs = docs.drop("repetition")
    rates, total = source_rates(docs, source, weights, power, epochs)
    rates = durable(rates)
    rows = join_by_weight(docs.withColumn("_sv_key", source_key(source)), rates, ["_sv_key"], "_sv_n", max(1, total), "inner")
    u = uniform(seed, "doc_id")
    rows = rows.withColumn("_sv_u", u)
    rows = rows.withColumn("_sv_count", (F.col("_sv_least") + F.size(F.filter("_sv_cdf", lambda c: c < F.col("_sv_u")))).cast("int")).filter("_sv_count > 0")
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_sv_count"))).alias("repetition"))
    order = F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("repetition"))
    return rows.withColumn("_sv_order", order).repartition("_sv_order").sortWithinPartitions(F.xxhash64("_sv_order"), "_sv_order").drop("_sv_order")


def bound(mean: float) -> int:
    """The largest count that ``mix`` can give at a mean rate."""
    return math.ceil(mean + 12 * math.sqrt(mean) + 30) + 1

"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkveil.sources.durable import durable

#: Values that one task sorts at most, and buckets that a pass counts.
SMALL, BUCKETS = 100_000, 1024


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], small: int | None = None) -> DataFrame:
    """``keys``, n and, for each name of ``wanted``, the value at rank ceil(p * n / 100) of the group's order, from 1.

    Each pass counts the values inside an interval by buckets and goes on inside the bucket that holds the rank, from its least to
    its greatest value; once no more than ``small`` values are left, or all are equal, these are sorted. Counts are summed before they
    are shuffled, so one group may hold all rows; what is broadcast are intervals of groups with more than ``small`` values, of which there
    can't be many. Nulls and NaN do not count; a group without values has nulls.
    """
    small = SMALL if small is None else small
    v = F.col("_v")
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    rows = rows.select(*[F.col(k).alias(n) for k, n in named.items()], F.when(~F.isnan(F.col(value).cast("double")), F.col(value)).alias("_v"))
    same_keys = F.lit(True)
    for n in named.values():
        same_keys = same_keys & F.col(n).eqNullSafe(F.col(f"_s{n}"))
    groups = durable(rows.groupBy(*named.values()).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in wanted.items()]))
    seek = groups.filter("n > 0").withColumn("w", ranks)
    rank = F.greatest(F.ceil(F.col("w.p") * F.col("n") / 100), F.lit(1)).cast("long")
    seek = seek.select(*named.values(), F.col("w.name").alias("name"), rank.alias("rank"), "lo", "hi", F.col("n").alias("inside"), F.lit(False).alias("narrowed"))

    def inside(rows: DataFrame, open_: DataFrame) -> DataFrame:
        held = open_.select(*[F.col(n).alias(f"_s{n}") for n in named.values()], "name", "rank", "lo", "hi")
        return rows.join(held, same_keys & v.between(F.col("lo"), F.col("hi")))

    done: DataFrame | None = None
    while True:
        seek = durable(seek)
        found = seek.filter((F.col("lo") == F.col("hi")) | (F.col("inside") <= small))
        done = found if done is None else done.unionByName(found)
        open_ = seek.filter((F.col("lo") < F.col("hi")) & (F.col("inside") > small))
        if open_.isEmpty():
            break
        share = (v.cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double"))
        bucket = F.when(v <= F.col("lo"), 0).when(v >= F.col("hi"), BUCKETS - 1).otherwise(1 + F.least(F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * (BUCKETS - 2)), F.lit(BUCKETS - 3)))
        held = inside(rows, F.broadcast(open_)).withColumn("b", bucket)
        counted = held.groupBy(*named.values(), "name", "rank", "b").agg(F.count("*").alias("m"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        w = W.partitionBy(*named.values(), "name").orderBy("b")  # BUCKETS rows at most
        counted = counted.withColumn("upto", F.sum("m").over(w))
        hit = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank"))
        seek = counted.filter(hit).select(*named.values(), "name", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"), "lo", "hi", F.col("m").alias("inside"), F.lit(True).alias("narrowed"))
    done = durable(done)
    # a large group's rows stay where they are and meet its intervals as a broadcast; those of small groups are shuffled by group
    large = groups.filter(F.col("n") > small).select(*[F.col(n).alias(f"_s{n}") for n in named.values()])
    few = rows.join(F.broadcast(large), same_keys, "left_anti")
    left = done.filter(F.col("lo") < F.col("hi"))
    found = inside(few, left.filter(~F.col("narrowed"))).unionByName(inside(rows, F.broadcast(left.filter("narrowed"))))
    values = found.groupBy(*named.values(), "name", "rank").agg(F.array_sort(F.collect_list("_v")).alias("vs"))
    values = values.select(*named.values(), "name", F.element_at("vs", F.col("rank").cast("int")).alias("found")).unionByName(done.filter(F.col("lo") == F.col("hi")).select(*named.values(), "name", F.col("lo").alias("found")))
    pick: list[Column] = [F.max(F.when(F.col("name") == name, F.col("found"))).alias(name) for name in wanted]
    picked = values.groupBy(*[F.col(n).alias(f"_s{n}") for n in named.values()]).agg(*pick)
    return groups.join(picked, same_keys, "left").select(*[F.col(n).alias(k) for k, n in named.items()], *wanted, "n")

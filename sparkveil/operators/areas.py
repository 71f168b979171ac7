"""Areas that boxes cover together, by plane sweep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkveil.sources.durable import durable
from sparkveil.sources.shipping import ship

#: Boxes of a key above which it is cut into strips along x, up to STRIPS of them, at quantiles of the left edges.
LARGE, STRIPS = 4096, 64
#: Boxes above which one sweep uses a segment tree; fewer are swept side by side with those of other keys.
TREE = 256


def _swept(x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Areas of ``n`` groups of boxes at once: the heights covered between each two neighbouring x of a group, times the widths.

    A box covers the neighbouring stretches between its edges; sorted by their lower edge, the boxes of a stretch add what lies
    above all before. The work is the number of (box, stretch) pairs.
    """
    edges = np.concatenate([x1, x2])
    of = np.concatenate([group, group])
    order = np.lexsort((edges, of))
    rank = np.empty(len(edges), np.int64)
    rank[order] = np.arange(len(edges))
    sorted_, of = edges[order], of[order]
    width = np.zeros(len(edges))
    width[:-1] = np.where(of[1:] == of[:-1], sorted_[1:] - sorted_[:-1], 0)
    first, last = rank[: len(x1)], rank[len(x1) :]
    spans = np.maximum(last - first, 0)
    pair = np.repeat(np.arange(len(x1)), spans)
    stretch = np.arange(spans.sum()) + np.repeat(first - np.cumsum(spans) + spans, spans)
    wide = width[stretch] > 0
    pair, stretch = pair[wide], stretch[wide]
    order = np.lexsort((y1[pair], stretch))
    pair, stretch = pair[order], stretch[order]
    tops, level = np.unique(y2, return_inverse=True)
    reach = np.maximum.accumulate(stretch * len(tops) + level[pair])  # the highest so far, anew for each stretch
    begins = np.concatenate([[True], stretch[1:] != stretch[:-1]]) if len(pair) else np.zeros(0, bool)
    before = np.full(len(pair), -np.inf)
    before[1:] = np.where(begins[1:], -np.inf, tops[reach[:-1] % len(tops)]) if len(pair) else before[1:]
    added = np.maximum(y2[pair] - np.maximum(y1[pair], before), 0)
    return np.bincount(group[pair], added * width[stretch], n)


def _tree_area(x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> float:
    """The area that many boxes cover: edges in order of x, and a tree over the distinct y that keeps the covered height."""
    ys = np.unique(np.concatenate([y1, y2]))
    size = 1
    while size < len(ys) - 1:
        size *= 2
    lows, highs = np.searchsorted(ys, y1).tolist(), np.searchsorted(ys, y2).tolist()
    height = np.zeros(2 * size)
    height[size : size + len(ys) - 1] = np.diff(ys)
    for k in range(size - 1, 0, -1):
        height[k] = height[2 * k] + height[2 * k + 1]
    height = height.tolist()
    count, covered = [0] * (2 * size), [0.0] * (2 * size)
    at = np.concatenate([x1, x2])
    order = np.argsort(at, kind="stable")
    n, area, last = len(x1), 0.0, float(at[order[0]])
    for e, x in zip(order.tolist(), at[order].tolist(), strict=True):
        area += covered[1] * (x - last)
        last = x
        box, step = (e, 1) if e < n else (e - n, -1)
        a, b = lows[box] + size, highs[box] + size
        touched = (a, b - 1)
        while a < b:
            for k in ([a] if a & 1 else []) + ([b - 1] if b & 1 else []):
                count[k] += step
                covered[k] = height[k] if count[k] else (covered[2 * k] + covered[2 * k + 1] if k < size else 0.0)
            a, b = (a + 1) >> 1, b >> 1
        for k in touched:
            k >>= 1
            while k:
                covered[k] = height[k] if count[k] else covered[2 * k] + covered[2 * k + 1]
                k >>= 1
    return area


def areas(x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """The area that the boxes of each of ``n`` groups cover; ``group`` ascends."""
    sizes = np.bincount(group, minlength=n)
    small = sizes[group] <= TREE
    out = _swept(x1[small], x2[small], y1[small], y2[small], group[small], n) if small.any() else np.zeros(n)
    ends = np.cumsum(sizes)
    for g in np.flatnonzero(sizes > TREE):
        own = slice(ends[g] - sizes[g], ends[g])
        out[g] = _tree_area(x1[own], x2[own], y1[own], y2[own])
    return out


def _in_strips(rows: DataFrame, keys: list[str], large: DataFrame) -> DataFrame:
    """``rows`` with the strip of each, the boxes of ``large`` keys cut at quantiles of their left edges."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    cuts = F.array_sort(F.array_distinct(F.percentile_approx("_x1", [i / STRIPS for i in range(1, STRIPS)], 1000)))
    large = rows.join(large, same).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(cuts.alias("_cuts"))
    rows = rows.join(large, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    whole = F.lit(float("-inf")), F.lit(float("inf"))
    bounds = F.concat(F.array(whole[0]), F.coalesce("_cuts", F.array().cast("array<double>")), F.array(whole[1]))
    strips = F.filter(F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda i: F.struct(i.alias("i"), F.get(bounds, i).alias("lo"), F.get(bounds, i + 1).alias("hi"))), lambda s: (s["lo"] <= F.col("_x1")) & (F.col("_x1") < s["hi"]) | (s["lo"] < F.col("_x2")) & (F.col("_x1") < s["lo"]))
    cut = rows.filter("_cuts is not null").withColumn("_s", F.explode(strips)).select(*keys, F.col("_s.i").alias("_strip"), F.greatest("_x1", "_s.lo").alias("_x1"), F.least("_x2", "_s.hi").alias("_x2"), "_y1", "_y2")
    rows = cut.unionByName(rows.filter("_cuts is null").select(*keys, F.lit(0).alias("_strip"), "_x1", "_x2", "_y1", "_y2"))
    return rows


def union_areas(boxes: DataFrame, keys: list[str], box: str = "box") -> DataFrame:
    """``keys`` and area: what the boxes (STRUCT<x, y, w, h>) of each key cover together. Keys without a box of positive size have 0.

    Keys with more than LARGE boxes are cut into strips along x, in which boxes are swept apart and areas add up. Rows are streamed in
    order of key and strip; a task holds the boxes of one strip and a batch.
    """
    ship(boxes.sparkSession)
    b = F.col(box)
    edges = [b["x"].cast("double").alias("_x1"), (b["x"] + b["w"]).cast("double").alias("_x2"), b["y"].cast("double").alias("_y1"), (b["y"] + b["h"]).cast("double").alias("_y2")]
    rows = durable(boxes.select(*keys, *edges))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    large = durable(rows.groupBy(*named).agg(F.count("*").alias("_n")).filter(F.col("_n") > LARGE))
    rows = rows.withColumn("_strip", F.lit(0)) if large.isEmpty() else _in_strips(rows, keys, large)
    dealt = rows.repartition(*keys, "_strip").sortWithinPartitions(*keys, "_strip")
    schema = StructType([*(rows.schema[k] for k in keys), StructField("area", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def said(part: pa.Table, new: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(new)
            x1, x2, y1, y2 = (part.column(c).to_numpy() for c in ("_x1", "_x2", "_y1", "_y2"))
            real = (x2 > x1) & (y2 > y1)  # NaN and null are not
            group = np.cumsum(new) - 1
            found = areas(x1[real], x2[real], y1[real], y2[real], group[real], len(first))
            columns = [part.column(k).take(pa.array(first)).combine_chunks() for k in keys]
            return pa.RecordBatch.from_arrays([*columns, pa.array(found)], schema.names)

        def begins(part: pa.Table) -> np.ndarray:
            new = np.ones(part.num_rows, bool)
            if part.num_rows > 1:
                new[1:] = False
                for k in (*keys, "_strip"):
                    c = part.column(k).combine_chunks()
                    left, right = c[:-1], c[1:]
                    differ = pc.or_(pc.fill_null(pc.not_equal(left, right), False), pc.not_equal(pc.is_null(left), pc.is_null(right)))
                    new[1:] |= differ.to_numpy(zero_copy_only=False)
            return new

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            new = begins(held)
            last = int(np.flatnonzero(new)[-1]) if held.num_rows else 0
            if last:
                yield said(held.slice(0, last), new[:last])
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield said(held, begins(held))

    return dealt.mapInArrow(run, schema).groupBy(*keys).agg(F.sum("area").alias("area"))

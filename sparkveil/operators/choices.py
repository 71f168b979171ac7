"""Greedy choices: the best first, and nothing that a choice before it rules out.

Whether something is chosen depends on all that is better, so a key is walked in order of merit by one task, past a state of what is
taken. Keys with more than LARGE candidates first go through rounds that decide many at once: a candidate that is better than all it
competes with is chosen by any greedy walk, so each round takes all such ones and drops what they rule out. What is left when a key is no
longer large is walked. The result is that of one walk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.geometry import iou
from sparkveil.sources.durable import durable
from sparkveil.sources.shipping import ship

#: Candidates of a key above which rounds decide first.
LARGE = 50_000


def _large(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("_large")).agg(F.count("*").alias("_n")).filter(F.col("_n") > LARGE).select("_large")


def _in_rounds(rows: DataFrame, key: str, chosen_of: Callable[[DataFrame], DataFrame], left_of: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """What rounds choose of large keys, and the rows that are still to be walked."""
    rows = durable(rows)
    chosen, walked = None, None
    while not (large := _large(rows, key)).isEmpty():
        same = F.col(key).eqNullSafe(F.col("_large"))
        large = durable(large)
        rest = rows.join(large, same, "left_anti")
        walked = rest if walked is None else walked.unionByName(rest)
        rows = rows.join(large, same, "left_semi")
        best = durable(chosen_of(rows))
        chosen = best if chosen is None else chosen.unionByName(best)
        rows = durable(left_of(rows, best))
    return chosen, rows if walked is None else walked.unionByName(rows)


def _walk(rows: DataFrame, key: str, order: list[Column], inputs: list[str], start: Callable[[], object], keep: Callable[[object, list[list]], list[int]]) -> DataFrame:
    """The rows that ``keep(state, columns)`` picks of each stretch of one key; the key's state is ``start()`` at first."""
    ship(rows.sparkSession)
    dealt = rows.repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            keys = batch.column(key).to_pylist()
            columns = [batch.column(c).to_pylist() for c in inputs]
            picked, at = [], 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if keys[at] != now or state is None:
                    now, state = keys[at], start()
                picked += [at + i for i in keep(state, [c[at:to] for c in columns])]
                at = to
            if picked:
                yield batch.take(pa.array(picked))

    return dealt.mapInArrow(run, rows.schema)


# ---------------------------------------------------------------- pairs


def one_to_one(pairs: DataFrame, key: str, merit: list[Column]) -> DataFrame:
    """Of ``pairs`` (key, g, p, ...) those that a walk in order of ``merit`` takes, as each g and each p of a key may be taken once.

    ``merit`` must order a key's pairs without ties.
    """
    by = F.struct(*[m.alias(f"m{i}") for i, m in enumerate(merit)])

    def chosen(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_by", by)
        best = {c: rows.groupBy(F.col(key).alias(f"_k{c}"), F.col(c).alias(f"_{c}")).agg(F.min("_by").alias(f"_b{c}")) for c in ("g", "p")}
        for c in ("g", "p"):
            rows = rows.join(best[c], F.col(key).eqNullSafe(F.col(f"_k{c}")) & (F.col(c) == F.col(f"_{c}")) & (F.col("_by") == F.col(f"_b{c}"))).drop(f"_k{c}", f"_{c}", f"_b{c}")
        return rows.drop("_by")

    def left(rows: DataFrame, best: DataFrame) -> DataFrame:
        for c in ("g", "p"):
            taken = best.select(F.col(key).alias("_k"), F.col(c).alias("_c"))
            rows = rows.join(taken, F.col(key).eqNullSafe(F.col("_k")) & (F.col(c) == F.col("_c")), "left_anti")
        return rows

    def keep(state: tuple[set, set], columns: list[list]) -> list[int]:
        picked, (used_g, used_p) = [], state
        for i, (g, p) in enumerate(zip(*columns, strict=True)):
            if g not in used_g and p not in used_p:
                used_g.add(g)
                used_p.add(p)
                picked.append(i)
        return picked

    first, rest = _in_rounds(pairs, key, chosen, left)
    walked = _walk(rest, key, merit, ["g", "p"], lambda: (set(), set()), keep)
    return walked if first is None else first.unionByName(walked)


# ---------------------------------------------------------------- boxes


def _numbers(boxes: list[dict]) -> np.ndarray:
    return np.array([(b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"]) for b in boxes], np.float64).reshape(-1, 4)


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each box of ``a`` with each of ``b``."""
    inter = np.maximum(np.minimum(a[:, None, 2], b[:, 2]) - np.maximum(a[:, None, 0], b[:, 0]), 0) * np.maximum(np.minimum(a[:, None, 3], b[:, 3]) - np.maximum(a[:, None, 1], b[:, 1]), 0)
    sizes = [(x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1]) for x in (a, b)]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(inter > 0, inter / (sizes[0][:, None] + sizes[1] - inter), 0.0)


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over the lesser area of each box of ``a`` with each of ``b``."""
    inter = np.maximum(np.minimum(a[:, None, 2], b[:, 2]) - np.maximum(a[:, None, 0], b[:, 0]), 0) * np.maximum(np.minimum(a[:, None, 3], b[:, 3]) - np.maximum(a[:, None, 1], b[:, 1]), 0)
    sizes = [(x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1]) for x in (a, b)]
    least = np.minimum(sizes[0][:, None], sizes[1])
    return np.where(inter > 0, inter / np.where(least > 0, least, 1), 0.0)


def _apart(likeness: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float) -> Callable[[list, list[list]], list[int]]:
    def keep(state: list[np.ndarray], columns: list[list]) -> list[int]:
        picked = []
        boxes = _numbers(columns[0])
        for at in range(0, len(boxes), 1024):
            part = boxes[at : at + 1024]
            free = np.ones(len(part), bool)
            for held in state:
                free[free] = ~(likeness(part[free], held) > threshold).any(axis=1)
            own = np.flatnonzero(free)
            new = []
            while len(own):
                new.append(own[0])
                own = own[1:][~(likeness(part[own[1:]], part[own[:1]])[:, 0] > threshold)]
            picked += [at + int(i) for i in new]
            if new:
                if state and len(state[-1]) < 1024:
                    state[-1] = np.concatenate([state[-1], part[new]])
                else:
                    state.append(part[new])
        return picked

    return keep


def apart(boxes: DataFrame, key: str, merit: list[Column], threshold: float, box: str = "box") -> DataFrame:
    """Of ``boxes`` those that a walk in order of ``merit`` keeps: none that overlaps a kept one of its key by more than ``threshold``.

    Overlap is intersection over union. In rounds a box competes with those in the cells around its own; cells are as large as
    the key's largest side, so that boxes farther away can't overlap. Each round takes the boxes that are best of nine cells.
    """
    by = F.struct(*[m.alias(f"m{i}") for i, m in enumerate(merit)])
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    kept_columns = boxes.columns

    def celled(rows: DataFrame) -> DataFrame:
        side = rows.groupBy(F.col(key).alias("_key")).agg(F.greatest(F.max(f"{box}.w"), F.max(f"{box}.h"), F.lit(1e-9)).alias("_side"))
        rows = rows.join(side, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
        return rows.select(*kept_columns, *[F.floor(F.col(f"{box}.{c}") / F.col("_side")).alias(f"_{c}") for c in "xy"], by.alias("_by"))

    def chosen(rows: DataFrame) -> DataFrame:
        held = celled(rows)
        best = held.groupBy(key, "_x", "_y").agg(F.min("_by").alias("_best"))
        near = best.withColumn("_c", around).groupBy(F.col(key).alias("_key"), (F.col("_x") + F.col("_c.i")).alias("_nx"), (F.col("_y") + F.col("_c.j")).alias("_ny")).agg(F.min("_best").alias("_best"))
        met = held.join(near, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_x") == F.col("_nx")) & (F.col("_y") == F.col("_ny")) & (F.col("_by") == F.col("_best")))
        return met.select(*kept_columns, "_x", "_y")

    def left(rows: DataFrame, best: DataFrame) -> DataFrame:
        near = best.withColumn("_c", around).select(F.col(key).alias("_key"), (F.col("_x") + F.col("_c.i")).alias("_nx"), (F.col("_y") + F.col("_c.j")).alias("_ny"), F.col(box).alias("_near"), F.struct(*[m.alias(f"m{i}") for i, m in enumerate(merit)]).alias("_theirs"))
        meets = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_x") == F.col("_nx")) & (F.col("_y") == F.col("_ny"))
        return celled(rows).join(near, meets & ((iou(F.col(box), F.col("_near")) > threshold) | (F.col("_by") == F.col("_theirs"))), "left_anti").select(*kept_columns)

    first, rest = _in_rounds(boxes, key, chosen, left)
    walked = _walk(rest, key, merit, [box], list, _apart(_overlap, threshold))
    return walked if first is None else first.select(*kept_columns).unionByName(walked)


def not_inside(boxes: DataFrame, key: str, merit: list[Column], threshold: float, box: str = "box") -> DataFrame:
    """As ``apart``, by intersection over the lesser area; a key is walked whole, past what is kept of it."""
    return _walk(boxes, key, merit, [box], list, _apart(_within, threshold))

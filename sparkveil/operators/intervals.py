"""Joins of intervals by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a bin where none is given.
BIN = 256


def _binned(rows: DataFrame, start: str, end: str, width: int, to: str) -> DataFrame:
    first, last = (F.floor(c / width).cast("long") for c in (F.col(start), F.greatest(F.col(end) - 1, F.col(start))))
    return rows.withColumn(f"{to}_first", first).withColumn(to, F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = BIN) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal ``keys`` (null keys match none) whose half-open intervals have a place in common.

    Each side goes to the bins that its interval touches, so that rows meet on (keys, bin) and a long line is spread over its
    bins; a pair that shares several bins is told in the first of them only. Intervals without length have no place. Names of the
    two sides' other columns must differ.
    """
    a, b = _binned(left, *left_span, width, "_bin_l"), _binned(right, *right_span, width, "_bin_r")
    same: Column = F.col("_bin_l") == F.col("_bin_r")
    renamed = b.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    for k in keys:
        same = same & (F.col(k) == F.col(f"_key_{k}"))
    (s1, e1), (s2, e2) = left_span, right_span
    meets = (F.col(s1) < F.col(e2)) & (F.col(s2) < F.col(e1)) & (F.col(s1) < F.col(e1)) & (F.col(s2) < F.col(e2))
    once = F.col("_bin_l") == F.greatest("_bin_l_first", "_bin_r_first")
    return a.join(renamed, same & meets & once).drop("_bin_l", "_bin_r", "_bin_l_first", "_bin_r_first", *[f"_key_{k}" for k in keys])

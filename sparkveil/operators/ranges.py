"""Scans in the order of sessions of any size.

A session may hold most of all rows, so rows are dealt by range and not by session. Each range is scanned by itself, and what a
session carries over a border goes to the next range as one row: as many rows as there are borders, at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sparkveil.sources.durable import durable_columns
from sparkveil.sources.shipping import ship

#: The range of a row, and its place in the order of all rows.
PART, AT = "_sv_part", "_sv_at"


def dealt(rows: DataFrame, session: str | list[str], order: list[str]) -> DataFrame:
    """``rows`` in ranges of (session, order), with PART and AT; written once, so that both stay what they are."""
    keys = [session] if isinstance(session, str) else session
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return durable_columns(ranged.select("*", F.spark_partition_id().alias(PART), F.monotonically_increasing_id().alias(AT)))


def _same(keys: list[str]) -> Column:
    same = F.col(PART) == F.col("_c_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_c_key{i}"))
    return same


def _carried(rows: DataFrame, keys: list[str], totals: dict[str, Column], over: Callable[[Column], Column]) -> DataFrame:
    """What each session's earlier ranges hand to a range: a row for each border that a session crosses."""
    ends = rows.groupBy(*keys, PART).agg(*[c.alias(n) for n, c in totals.items()])
    w = W.partitionBy(*keys).orderBy(PART)
    ends = ends.withColumns({f"_c_{n}": over(F.col(n)) for n in totals}).withColumn("_c_goes_on", F.lag(PART).over(w).isNotNull()).filter("_c_goes_on")
    return ends.select(F.col(PART).alias("_c_part"), *[F.col(k).alias(f"_c_key{i}") for i, k in enumerate(keys)], *[f"_c_{n}" for n in totals])


def running(rows: DataFrame, session: str | list[str], sums: dict[str, Column] | None = None, highest: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` (as ``dealt``) with the session's running sums, and running maxima, up to each row; nulls add nothing."""
    keys = [session] if isinstance(session, str) else session
    here = W.partitionBy(PART, *keys).orderBy(AT).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    for amounts, fold, join in ((sums or {}, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), (highest or {}, F.max, F.greatest)):
        if amounts:
            rows = rows.withColumns({f"_own_{n}": c for n, c in amounts.items()})
            carried = _carried(rows, keys, {n: fold(f"_own_{n}") for n in amounts}, lambda c, fold=fold: fold(c).over(before))
            rows = rows.withColumns({f"_own_{n}": fold(f"_own_{n}").over(here) for n in amounts})
            rows = rows.join(F.broadcast(carried), _same(keys), "left")
            rows = rows.withColumns({n: join(F.col(f"_own_{n}"), F.col(f"_c_{n}")) for n in amounts}).drop(*carried.columns, *[f"_own_{n}" for n in amounts])
    return rows


def previous(rows: DataFrame, session: str | list[str], columns: dict[str, str]) -> DataFrame:
    """``rows`` (as ``dealt``) with each of ``columns`` (new name: column) as it was in the session's row before; null in its first."""
    keys = [session] if isinstance(session, str) else session
    here = W.partitionBy(PART, *keys).orderBy(AT)
    held = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    w = W.partitionBy(*keys).orderBy(PART)
    carried = _carried(rows, keys, {"last": F.max_by(held, AT)}, lambda c: F.lag(c).over(w))
    rows = rows.withColumn("_own_last", F.lag(held).over(here)).join(F.broadcast(carried), _same(keys), "left")
    last = F.coalesce("_own_last", "_c_last")
    return rows.withColumns({n: last[n] for n in columns}).drop("_own_last", *carried.columns)


def islands(rows: DataFrame, session: str, at: str, gap: int) -> DataFrame:
    """``rows`` (as ``dealt``) with island: one number for each run of a session's rows in which none comes ``gap`` or more after the last."""
    rows = previous(rows, session, {"_before": at})
    begins = F.col("_before").isNull() | (F.col(at) - F.col("_before") >= gap)
    return running(rows, session, highest={"island": F.when(begins, F.col(AT))}).drop("_before")


def in_order(rows: DataFrame, key: str, order: list[str], inputs: list[str], out: str, step: Callable[..., tuple]) -> DataFrame:
    """``rows`` with the columns ``out`` (DDL) that ``step(state, *inputs)`` makes of the state of the row's ``key``, which it changes.

    What happens depends on all of the key's rows before, so one task walks them; they are streamed, and memory holds a batch
    and a state. Cut long keys at ``islands`` first, where the state starts anew.
    """
    ship(rows.sparkSession)
    made = StructType.fromDDL(out)
    types = to_arrow_schema(made).types
    walked = rows.repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), {}
        for batch in batches:
            results = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *inputs)), strict=True):
                if k != now:
                    now, state = k, {}
                results.append(step(state, *values))
            columns = [pa.array(c, t) for c, t in zip(zip(*results, strict=True) if results else [()] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *made.names])

    return walked.mapInArrow(run, StructType([*rows.schema.fields, *made.fields]))

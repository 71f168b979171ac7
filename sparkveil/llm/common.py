"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.sources.durable import shared_folder
from sparkveil.sources.shipping import ship

#: A key that holds at least this fraction of all rows is hot; fewer than 1/HOT keys can be.
HOT = 1e-3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch between the JVM and a Python worker; Spark's own bounds, 10,000 rows and 64 MB, stand in each
#: of an executor's tasks several times.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def workers(df: DataFrame) -> DataFrame:
    """``df``, after this package was sent to its session's Python workers and its session's Arrow batches were bounded."""
    spark = df.sparkSession
    ship(spark)
    for key, most, was in (("maxRecordsPerBatch", BATCH_ROWS, "10000"), ("maxBytesPerBatch", BATCH_BYTES, "67108864b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == was:  # one that the user has set stays
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df


#: With this setting Spark removes a query's shuffle files when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: computed once, and safe if executors are lost.

    The shuffle files of the writing go when it has ended: the written table stands in their place.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # holds for plans made while it is set
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in no more parts than a shuffle makes. A union has the parts of all its sides, and whoever reads it as many tasks,
    of each of which the driver keeps a record."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def join_by_weight(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """Join ``rows`` to ``lookup`` (unique by ``keys``) without dealing a hot key to one task.

    ``weight`` is a column of ``lookup``: how many of the ``total`` rows have that key. Keys with at
    least ``HOT`` of all rows number at most 1/HOT, whatever the data, so that part of ``lookup`` is
    broadcast; the rest goes through an ordinary join in which no key exceeds that fraction. Keys must
    not be null. ``lookup`` is read more than once: make it durable first.
    """
    floor = max(2, total * HOT)
    hot = lookup.filter(F.col(weight) >= floor)
    cold = lookup.filter(F.col(weight) < floor)
    flag = "_sv_hot"  # what a hot key has, so that one broadcast serves both sides
    own = [c for c in lookup.columns if c not in keys]
    marked = rows.join(F.broadcast(hot.select(*keys, F.struct(*own).alias(flag))), keys, "left")
    hit = marked.filter(F.col(flag).isNotNull()).select("*", *(F.col(flag)[c].alias(c) for c in own)).drop(flag)
    rest = marked.filter(F.col(flag).isNull()).drop(flag).join(cold, keys, how)
    return hit.unionByName(rest)


def crc_fold(column: str = "doc_id") -> Column:
    """The fold of a row: crc32 of its id as text, modulo 5; fold 0 is held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose ``column`` holds about ``most_bytes`` at most, one row at least."""
    for batch in batches:
        texts = batch.column(column)
        if not isinstance(texts, pa.StringArray):
            texts = texts.cast(pa.string())
        sizes = texts.nbytes
        if sizes <= most_bytes or batch.num_rows <= 1:
            if batch.num_rows:
                yield batch
            continue
        start = held = 0
        for i in range(batch.num_rows):
            size = len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)

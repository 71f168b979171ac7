"""Packets that leave only after their receipts are kept, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.operators.gate import receipts


def _mark(spark: SparkSession, folder: str, name: str, batch: int) -> None:
    spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").json(f"{folder}/{name}/batch={batch}")


def _marked(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The batches with a mark; -1, of the start, is none."""
    return spark.read.schema("at timestamp, batch long").option("basePath", f"{folder}/{name}").json(f"{folder}/{name}").filter("batch >= 0").select("batch").distinct()


def start(packets: DataFrame, folder: str, checkpoint: str):
    """Start a stream of gated packets (with outcome) into ``folder``, which all executors share; it ends when all input there is now is done.

    A batch goes through two phases: its receipts are written and marked as kept, then what may be sent is written and the batch is
    marked as sent. A run that was stopped between any two steps repeats the batch under its number: what it had written is replaced,
    what was marked as sent is left alone. So each receipt is there once, and no packet without one.
    """
    spark = packets.sparkSession
    for name in ("kept", "sent"):
        _mark(spark, folder, name, -1)

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        if not _marked(own, folder, "sent").filter(F.col("batch") == number).isEmpty():
            return
        held = batch.persist()
        try:
            receipts(held).write.mode("overwrite").parquet(f"{folder}/receipts/batch={number}")
            _mark(own, folder, "kept", number)
            held.filter("outcome = 'sent'").write.mode("overwrite").parquet(f"{folder}/packets/batch={number}")
            _mark(own, folder, "sent", number)
        finally:
            held.unpersist()

    return packets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _committed(spark: SparkSession, folder: str, name: str, mark: str) -> DataFrame:
    batches = [r.batch for r in _marked(spark, folder, mark).collect()]  # a number for each batch there was
    if not batches:
        raise FileNotFoundError(f"no batch of {folder} is marked as {mark} yet")
    return spark.read.option("basePath", f"{folder}/{name}").parquet(*[f"{folder}/{name}/batch={b}" for b in sorted(batches)])


def kept_receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts of all batches whose receipts are whole."""
    return _committed(spark, folder, "receipts", "kept")


def sent_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Packets of all batches that are whole; their receipts are kept."""
    return _committed(spark, folder, "packets", "sent")

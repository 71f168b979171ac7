"""Steps that several tables of one result are made from, and the folder they are in."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local session takes a temporary one; on a cluster it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparkveil-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir``: computed and planned once, and safe if executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_columns(df: DataFrame) -> DataFrame:
    """``df`` written to the same folder by columns: later steps read only those that they need. For wide rows that are read more than once."""
    if '"void"' in df.schema.json() or len({c.lower() for c in df.columns}) < len(df.columns):
        return durable(df)  # what Parquet can't hold
    folder = f"{shared_folder(df.sparkSession)}/columns-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

"""Makes this package importable in Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the session's executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkveil_shipped", False):
        return
    name = os.path.basename(_PACKAGE)
    path = os.path.join(tempfile.mkdtemp(prefix="sparkveil-src-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(_PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, _PACKAGE)))
    sc.addPyFile(path)
    sc._sparkveil_shipped = True

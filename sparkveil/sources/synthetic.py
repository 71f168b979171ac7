"""Deterministic inputs from the driver's tables, stated as SQL that Spark and DuckDB both run.

Identifiers come from key columns; check digits are left to each engine, so that a query and its oracle
compute them independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over tasks: where a row of a small table costs far more than its bytes tell, as a whole page or packet is made of it."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str, costly: bool = False) -> DataFrame:
    """The result of ``sql`` over tables named in braces; these are ``spread`` if their rows are costly."""
    return spark.sql(sql, **{t: spread(table(spark, sf_dir, t)) if costly else table(spark, sf_dir, t) for t in tables})


#: One line for each order and number: the tables have some twice.
LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"
#: Boxes of page elements, one page an order; a detection is one of them shifted, or missing.
DOM = f"""SELECT l_orderkey AS page_id, l_linenumber AS pos, concat('e', CAST(l_linenumber AS STRING)) AS id,
    CASE l_partkey % 4 WHEN 0 THEN 'textbox' WHEN 1 THEN 'button' WHEN 2 THEN 'text' ELSE 'image' END AS role,
    CAST(40 + (l_partkey % 5) * 110 AS DOUBLE) AS x, CAST(100 + 40 * l_linenumber AS DOUBLE) AS y,
    CAST(100 + l_partkey % 200 AS DOUBLE) AS w, CAST(20 + l_suppkey % 20 AS DOUBLE) AS h, l_suppkey % 11 <> 0 AS visible FROM {LINES}"""
DETECTIONS = f"""SELECT l_orderkey AS page_id, l_linenumber AS idx,
    CASE l_partkey % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'text' ELSE 'media' END AS kind, 0.9 AS score,
    CAST(40 + (l_partkey % 5) * 110 + CAST(l_quantity AS BIGINT) % 70 AS DOUBLE) AS x, CAST(100 + 40 * l_linenumber + l_partkey % 12 AS DOUBLE) AS y,
    CAST(100 + l_partkey % 200 AS DOUBLE) AS w, CAST(20 + l_suppkey % 20 AS DOUBLE) AS h FROM {LINES} WHERE l_linenumber % 6 <> 0"""
#: Labelled boxes and predictions of captures.
TRUTH = f"""SELECT l_orderkey AS capture_id, l_linenumber AS g, CASE l_partkey % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'AADHAAR' ELSE 'PIN_CODE' END AS cls,
    CASE l_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'invariant' ELSE 'medium' END AS severity, l_suppkey % 5 <> 0 AS must_redact,
    CAST(40 AS DOUBLE) AS x, CAST(100 + 15 * l_linenumber AS DOUBLE) AS y, CAST(100 + l_partkey % 50 AS DOUBLE) AS w, CAST(30 AS DOUBLE) AS h FROM {LINES}"""
PREDICTIONS = f"""SELECT l_orderkey AS capture_id, l_linenumber AS p, CASE l_partkey % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'AADHAAR' ELSE 'PIN_CODE' END AS cls,
    CAST(40 + l_suppkey % 9 AS DOUBLE) AS x, CAST(100 + 15 * l_linenumber + CAST(l_quantity AS BIGINT) % 9 AS DOUBLE) AS y, CAST(100 + l_partkey % 50 AS DOUBLE) AS w, CAST(30 AS DOUBLE) AS h
    FROM {LINES} WHERE CAST(l_quantity AS BIGINT) % 7 <> 0"""

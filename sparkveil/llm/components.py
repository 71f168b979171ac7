"""Connected components of an undirected graph, by iterated joins with durable steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import durable


#: Parts of the nodes that point to one head.
SALTS = 64


def pointed(edges: DataFrame, rounds: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(node, head) for each node of ``edges`` (a, b long): a lesser node that it is connected to, or itself.

    Nodes with one head are connected; connected ones may have several heads. Each node points to its least
    neighbour, and each round follows the pointers twice as far, so chains of 2^rounds links get one head. A
    node's pointer is one row however many links it has. Each value of the columns ``by``, not null and kept in the
    result, is a graph of its own: the steps are as many as for one.
    """
    own = edges.filter("a <> b").select(*by, F.greatest("a", "b").alias("node"), F.least("a", "b").alias("head"))
    heads = own.groupBy(*by, "node").agg(F.min("head").alias("head"))
    for _ in range(rounds):
        heads = durable(heads)
        # many nodes point to one head: what that one points to is joined to the distinct heads, and goes to each salt
        further = heads.select(*by, F.col("head").alias("node")).distinct().join(heads.withColumnRenamed("head", "next"), [*by, "node"]).withColumnRenamed("node", "head")
        further = further.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = heads.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        heads = salted.join(further, [*by, "head", "salt"], "left").select(*by, "node", F.coalesce("next", "head").alias("head"))
    heads = durable(heads)
    roots = own.select(*by, F.col("head").alias("node")).distinct().join(heads.select(*by, "node"), [*by, "node"], "left_anti")
    return durable(heads.unionByName(roots.select(*by, "node", F.col("node").alias("head"))))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b long): the least node reachable.

    Alternates the large-star and small-star steps of map-reduce components: every step links nodes to
    their least neighbour and aggregates before it shuffles, so a hub costs rows in proportion to its
    links. The number of steps grows with the logarithm of the nodes; each one is written to the
    checkpoint folder. Nothing but a count reaches the driver.
    """
    own = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours go to the least of the neighbourhood
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: lesser neighbours and the node itself go to the least of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        own = durable(small.filter("a <> b").distinct())
        state = own.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == before:
            break
        before = state
    roots = own.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return own.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

"""Line dedup by distinct-site spread, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import durable, join_by_weight

#: Sketches of 2^12 registers: a standard error of 1.04 / 2^6.
LG_K = 12
ERROR = 1.04 / 2 ** (LG_K / 2)


def _lines(docs: DataFrame, text: str, site: str, need: Callable[[Column], Column] | None = None) -> DataFrame:
    """A row for each non-blank line: whose it is, where, its two hashes, its site, and what ``need`` tells of it."""
    rows = docs.select(
        F.col("doc_id").alias("_sv_doc"),
        F.xxhash64(F.col(text)).alias("_sv_text"),
        F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n")).alias("_sv_site"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("_sv_pos", "_sv_line"),
    )
    line = F.trim(F.regexp_replace("_sv_line", r"[\t\r\x0B\f]", " "))
    more = [] if need is None else [need(F.col("_sv_line")).alias("_sv_need")]
    return rows.withColumn("_sv_line", line).filter(F.col("_sv_line") != "").select("_sv_doc", "_sv_text", "_sv_site", "_sv_pos", *_hashes(F.col("_sv_line")), *more)


def _hashes(line: Column) -> list[Column]:
    """128 bits of hash: two 64-bit hashes from different seeds."""
    return [F.xxhash64(line).alias("_sv_h1"), F.xxhash64(F.lit(1), line).alias("_sv_h2")]


def spread_lines(docs: DataFrame, min_sites: int, text: str = "text", site: str = "source", band: float = 3.0, long_sites: int | None = None, long_chars: int = 40) -> DataFrame:
    """Lines on at least ``min_sites`` distinct sites: hashes, occurrences, and the first place (by doc_id, then position).

    For lines of ``long_chars`` or more code points ``long_sites`` stands in place of ``min_sites``, if given. Sites of a line are counted by HyperLogLog sketches, merged by the aggregation. A line whose
    estimate is within ``band`` standard errors (and one site) of what it needs is counted exactly.
    """
    keys = ["_sv_h1", "_sv_h2"]
    every = _lines(docs, text, site, lambda line: F.when(F.length(line) >= long_chars, long_sites or min_sites).otherwise(min_sites))
    need = F.col("_sv_need")
    low, high = need * (1 - band * ERROR) - 1, need * (1 + band * ERROR) + 1
    sketched = every.groupBy(*keys).agg(F.hll_sketch_agg("_sv_site", LG_K).alias("sketch"), F.count("*").alias("_sv_n"), F.min(F.struct("_sv_doc", "_sv_pos")).alias("_sv_first"), F.min("_sv_need").alias("_sv_need"))
    sketched = sketched.filter(F.col("_sv_n") >= need).withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch")
    sketched = durable(sketched.filter(F.col("sites") >= low))
    near = sketched.filter(F.col("sites") <= high)
    # a near line has about as many rows here as the sites it needs, however often it occurs
    pairs = every.select(*keys, "_sv_site").distinct()
    exact = pairs.join(near.select(*keys, "_sv_need"), keys).groupBy(*keys).agg(F.count("*").alias("_sv_exact"), F.min("_sv_need").alias("_sv_need")).filter(F.col("_sv_exact") >= need).select(*keys)
    return sketched.filter(F.col("sites") > high).unionByName(near.join(exact, keys, "left_semi")).select(*keys, "_sv_n", "_sv_first")


def drop_spread_lines(docs: DataFrame, min_sites: int = 10, text: str = "text", site: str = "source", keep_first: bool = True, long_sites: int | None = None, long_chars: int = 40) -> DataFrame:
    """``docs`` with the lines that spread over ``min_sites`` or more sites removed from ``text``.

    Lines of ``long_chars`` or more code points go from ``long_sites`` on, if that is given. Lines are compared trimmed of blanks; blank lines stay. With ``keep_first`` a removed line stays
    where it occurs first (least doc_id, a null one before all, then position), so that nothing
    vanishes from the corpus. Adds n_lines and n_removed (replacing columns of that name); all other
    columns and all rows stay, those left with an empty text too. A null text stays null with 0 lines, and a null
    site counts as one site. Rows alike in doc_id and text are treated alike.
    """
    docs = docs.drop("n_lines", "n_removed")
    keys = ["_sv_h1", "_sv_h2"]
    spread = durable(spread_lines(docs, min_sites, text, site, long_sites=long_sites, long_chars=long_chars))
    every = _lines(docs, text, site).select("_sv_doc", "_sv_text", "_sv_pos", *keys)
    total = max(1, spread.agg(F.sum("_sv_n")).head()[0] or 0)
    hits = join_by_weight(every, spread, keys, "_sv_n", total, "inner")
    if keep_first:
        hits = hits.filter(~(F.col("_sv_doc").eqNullSafe(F.col("_sv_first._sv_doc")) & (F.col("_sv_pos") == F.col("_sv_first._sv_pos"))))
    gone = hits.groupBy("_sv_doc", "_sv_text").agg(F.collect_set("_sv_pos").alias("_sv_gone"))
    rows = docs.withColumn("_sv_key", F.xxhash64(F.col(text)))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_sv_doc")) & (F.col("_sv_key") == F.col("_sv_text")), "left")
    parts = F.split(F.col(text), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_sv_gone"))
    rebuilt = F.when(F.col("_sv_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    removed = F.coalesce(F.size("_sv_gone"), F.lit(0))
    return joined.select(
        *[(rebuilt.alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("int").alias("n_lines"),
        F.when(F.col("_sv_gone").isNull(), 0).otherwise(removed).cast("int").alias("n_removed"),
    )

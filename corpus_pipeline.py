"""A training corpus from raw documents, in five stages, each by one operator of ``sparkveil.llm``.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as
the next stage's input; all but the last return the columns of documents, whatever these are called besides
doc_id, text, lang, source and n_chars. Empty tables give empty tables. No stage reads a part of a text only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm import classifiers, joins, lines, mixing, tokens
from sparkveil.llm.common import durable, shared_folder, table
from sparkveil.llm.queries import VOCABULARY

#: Score from which a document counts as good; those below go.
QUALITY_CUT = 0.3
#: Distinct sources from which a line counts as boilerplate: one of fewer than LONG_LINE characters, such as
#: occurs by chance in many texts, and a longer one, which hardly does. Lines of a few copied documents are on
#: up to 4 sources and are left to the near stage.
LINE_SITES, LONG_LINE_SITES, LONG_LINE = 10, 5, 40
#: Shingle words and percent of likeness that join near duplicates.
SHINGLE_WORDS, LIKENESS = 5, 80


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. The labels are those of ``sf_dir``.

    Null and empty texts get the score of no evidence, which the share of good labels decides: all stay or all go.
    Repeated rows, and rows of one doc_id or of none, are judged each by its own text.
    """
    scored = classifiers.score_quality(docs, classifiers.train_quality(docs, table(spark, sf_dir, "labels")), cut=QUALITY_CUT)
    return scored.filter("predicted = 1").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-source boilerplate lines. Those of which nothing is left go; others stay as they are.

    Where there are fewer than LONG_LINE_SITES sources, a long line has to be on all of them, two at least.
    A null or empty text has no line and stays; a null source is a source. Rows alike in doc_id and text lose the same lines.
    """
    sources = docs.select("source").distinct().limit(LONG_LINE_SITES).count()
    cleaned = lines.drop_spread_lines(docs, LINE_SITES, long_sites=max(2, sources), long_chars=LONG_LINE)
    stays = (F.col("n_removed") == 0) | F.coalesce(F.trim("text") != "", F.lit(False))
    cleaned = cleaned.filter(stays)
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", size).select(*docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: with the least doc_id, nulls last.

    Repeated rows, and different texts under one doc_id or without any, are rows of their own here, too.
    Of rows alike in doc_id and text the least by their other columns stays. Texts without words (null and empty ones, too) all stay.
    """
    groups = joins.jaccard_components(docs, SHINGLE_WORDS, LIKENESS).filter("n_shingles > 0")
    named = groups.groupBy(F.col("doc_id").alias("_sv_id"), F.col("text_hash").alias("_sv_same")).agg(F.max("winner").alias("_sv_wins"), F.count("*").alias("_sv_rows"))
    told = durable(named.filter("not _sv_wins or _sv_rows > 1"))  # other rows stay
    keyed = docs.withColumn("_sv_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("_sv_id")) & (F.col("_sv_hash") == F.col("_sv_same"))
    once = keyed.join(told, same, "left_anti").select(*docs.columns)
    repeated = keyed.join(told.filter("_sv_wins"), same, "left_semi")
    least = repeated.groupBy("doc_id", "_sv_hash").agg(F.min(F.struct(*docs.columns)).alias("_sv_row"))
    return once.unionByName(least.select("_sv_row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh as the square root of their rows, in random order.

    Rows alike in doc_id, and all rows without one, are repeated alike; a null source is a source. Texts are not looked at.
    """
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the bytes that they decode to.

    A null or empty text has no ids. Every row gives a row.
    """
    return tokens.encode(docs, VOCABULARY, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality", drop_bad),
    ("lines", drop_lines),
    ("near", drop_near),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Compression, sketches and tokenizers can't be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again.

    A stage's table is removed when the next one's is written: lost executors never need one further back.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)

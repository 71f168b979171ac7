"""Document fingerprints: threshold-scaled sketches of shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import slices, workers
from sparkveil.llm.shingles import Shingler, overlap


class Scaled:
    """Sketches that keep every shingle hash below 1/``scale`` of the hash space, and nothing else.

    Sketches of the same scale merge by union, and the share of common hashes estimates containment and
    likeness however unequal the documents are. Shingles are ``size`` words; texts are framed by size - 1
    empty words on both sides, so one of w words has up to w + size - 1 of them. At scale 2 a text of one word has an empty
    sketch with a chance of 1/8, one of ten words of 1/4096; the error of an estimate from n shingles is about sqrt(scale / 4n).
    """

    def __init__(self, scale: int = 2, size: int = 3):
        self.shingles = Shingler(size, framed=True)
        self.top = np.uint64(2**64 // scale - 1)

    def sketch(self, text: str | None) -> np.ndarray:
        h = self.shingles.hashes(text)
        return h[: int(np.searchsorted(h, self.top, "right"))]

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The sketch of both texts' shingles together."""
        return np.union1d(a, b)

    def containment(self, a: np.ndarray, b: np.ndarray) -> float:
        """The part of ``a`` that ``b`` holds; 1 if ``a`` is empty."""
        return overlap(a, b) / len(a) if len(a) else 1.0

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """Jaccard of the sketches; two empty ones are alike, an empty and another are not."""
        common = overlap(a, b)
        union = len(a) + len(b) - common
        return common / union if union else 1.0


def text_of(sketch: np.ndarray) -> str:
    """The fingerprint as text: ascending hashes in hexadecimal, 16 digits each."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def sketch_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), scale: int = 2, size: int = 3) -> DataFrame:
    """``keep`` and the fingerprint of every whole text. Null counts as empty (an empty fingerprint)."""
    source = docs.select(*keep, F.col(text).alias("_sv_text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scaled(scale, size)
        for b in slices(batches, "_sv_text", 1 << 20):
            made = pa.array([text_of(s.sketch(t.as_py())) for t in b.columns[-1]], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], [*b.schema.names[:-1], "fingerprint"])

    return workers(source).mapInArrow(run, head + "fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first code points of ``following`` (or all)."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def edit_likeness(docs: DataFrame, scale: int = 2, size: int = 3, parts: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they and the next document's are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    contained (the estimated part of the document's shingles that the edited text holds). The next
    document is the next by doc_id (null ids first, equal ids by a hash of the text, then the text), after the last the first; a
    single document is its own next. Null counts as empty. Other columns of ``docs`` are not read.

    Texts are dealt once, to ranges of doc_id; a range's last row finds its next in a copy of the first
    row of the following range. Null ids, and an id that holds more than a range's rows, are cut into ranges of the
    hash. Rows are streamed in order, so memory holds two texts.
    """
    spark = workers(docs).sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).head()
    cuts = rows.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], min(0.005, 0.25 / parts)) if parts > 1 and n > nulls else []
    ends, times = np.unique(np.array(cuts, np.float64), return_counts=True)  # an id that is a cut several times has that many ranges
    shared = spark.sparkContext.broadcast((ends, times, max(1, -(-parts * nulls // max(1, n)))))  # two numbers for each range

    @F.pandas_udf("long")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        ends, times, of_null = shared.value
        number, null = ids.fillna(0).to_numpy(np.float64), ids.isna().to_numpy()
        at = np.searchsorted(ends, number, "left")
        inside = np.minimum(at, max(0, len(ends) - 1))
        hot = (at < len(ends)) & (ends[inside] == number) & (times[inside] > 1) if len(ends) else np.zeros(len(at), bool)
        ranges = np.where(null, of_null, times[inside] if len(ends) else 1)
        sub = np.minimum(ranges - 1, ((hashes.to_numpy() / 2.0**64 + 0.5) * ranges).astype(np.int64))
        return pd.Series(np.where(null, -(2**20) + sub, (at << 20) + np.where(hot, 1 + sub, 0)))

    placed = rows.select(place("doc_id", "h").alias("part"), "doc_id", "h", "text")
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("o"), F.col("doc_id").alias("d"), "h")).alias("first")
    firsts = sorted((r["part"], r["first"]["d"], r["first"]["h"]) for r in placed.select("part", "doc_id", "h").groupBy("part").agg(least).collect())
    # the first row of each range goes to the range before it, too; there is one for each range
    goes = spark.createDataFrame([(d, h, firsts[i - 1][0]) for i, (_, d, h) in enumerate(firsts)], "_sv_id long, _sv_h long, _sv_to long")
    extra = placed.join(F.broadcast(goes), F.col("doc_id").eqNullSafe(F.col("_sv_id")) & (F.col("h") == F.col("_sv_h")), "inner")
    # of several rows with that id and hash the first by text is the range's first row
    extra = extra.groupBy("doc_id", "h", "_sv_to").agg(F.min("text").alias("text"))
    placed = placed.withColumn("halo", F.lit(False)).unionByName(extra.select(F.col("_sv_to").alias("part"), "doc_id", "h", "text", F.lit(True).alias("halo")))
    dealt = placed.repartition("part").sortWithinPartitions("part", "halo", F.col("doc_id").asc_nulls_first(), "h", "text").select("part", "doc_id", "text", "halo")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scaled(scale, size)
        held = None  # part, doc_id, text, sketch of the row before
        out: list[tuple] = []

        def row(doc: int | None, text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
            new = edited(text, following)
            other = s.sketch(new)
            return (doc, len(text), hashlib.sha256(new.encode()).hexdigest(), text_of(own), text_of(other), s.likeness(own, other), s.likeness(own, theirs), s.containment(own, other))

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            names = [f.split()[0] for f in schema.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return made

        for b in slices(batches, "text", 1 << 20):
            for p, d, t, h in zip(*(c for c in b.columns), strict=True):
                p, d, t, h = p.as_py(), d.as_py(), t.as_py(), h.as_py()
                own = s.sketch(t)
                if held is not None and held[0] == p:
                    out.append(row(held[1], held[2], held[3], t, own))
                held = None if h else (p, d, t, own)
                if len(out) >= 500 or sum(len(x[3]) for x in out[-20:]) > 1 << 20:
                    yield batch()
        if out:
            yield batch()

    return workers(dealt).mapInArrow(run, schema)

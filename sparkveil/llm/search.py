"""Ranked lexical search of all documents for a table of items, by sort-based accumulation.

A task goes through its range of the documents. For each block of them it concatenates the arrays of (item, document, impact) that the
block's matched terms give, sorts the packed keys by radix, sums each run with ``reduceat`` and offers the sums to one heap for each item.
Only the heaps leave the task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from sparkveil.llm.common import durable, slices, workers

#: Items, and distinct terms over all of them, that one pass over the documents serves; more items take more passes.
BLOCK_ITEMS, BLOCK_TERMS = 1 << 15, 1 << 19
#: Entries of (item, document, impact) that are sorted at once, where one document has no more.
ENTRIES = 1 << 21
#: Parts of an item's candidates that are ranked on their own before they meet.
SALTS = 256
#: Bytes of a text whose words are held as objects at once.
PIECE = 1 << 18
#: Not ASCII, or an ASCII digit or letter (A-Z lower-cased); all other bytes part terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in UTF-8 and in order, in lists of about PIECE bytes."""
    raw = (text or "").encode().translate(_TERM_BYTES)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def radix_order(keys: np.ndarray, digits: int) -> np.ndarray:
    """The stable order of unsigned ``keys`` by their lowest ``digits`` digits of 16 bits, least digit first."""
    order = None
    for k in range(digits):
        digit = (keys >> np.uint64(16 * k)).astype(np.uint16)
        step = np.argsort(digit if order is None else digit[order], kind="stable")  # numpy sorts 16 bits by radix
        order = step if order is None else order[step]
    return order if order is not None else np.arange(len(keys))


class _Blocks:
    """Items in blocks: for each its vocabulary, and which items hold a term."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[int] = []
        self.pairs: list[tuple[int, int]] = []

    def add(self, item: int, own: set[bytes]) -> None:
        at = len(self.items)
        self.items.append(item)
        self.pairs += [(self.vocabulary.setdefault(t, len(self.vocabulary)), at) for t in sorted(own)]

    def full(self) -> bool:
        return len(self.items) >= BLOCK_ITEMS or len(self.pairs) >= BLOCK_TERMS

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """The items of each term, one after another, and where a term's begin."""
        pairs = np.array(sorted(self.pairs), np.int64).reshape(-1, 2)
        return pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.vocabulary) + 1))


def _blocks(items: DataFrame) -> Iterator[_Blocks]:
    """``items`` (item long, text), one block after another: the driver never holds more than one."""
    block = _Blocks()
    for row in items.toLocalIterator():
        own = {t for part in terms(row.text) for t in part}
        if own:
            block.add(row.item, own)
            if block.full():
                yield block
                block = _Blocks()
    if block.items:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (numbers in ``vocabulary`` and how often), for each row of ``docs`` (doc_id, text) with terms."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a block's: bounded by BLOCK_TERMS and one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        for batch in slices(batches, "text", 2 << 20):
            lengths, rows, own, counts = [], [], [], []
            for k, text in enumerate(batch.column("text")):
                n, met = 0, []
                for part in terms(text.as_py()):
                    n += len(part)
                    met.append(np.array([i for i in map(get, part) if i is not None], np.int32))
                if n:
                    ids, tf = np.unique(np.concatenate(met), return_counts=True)
                    rows.append(k)
                    lengths.append(n)
                    own.append(ids)
                    counts.append(tf)
            if rows:
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(own).astype(np.int32)), pa.ListArray.from_arrays(ends, np.concatenate(counts).astype(np.int64))],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return workers(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<long>")


class Heaps:
    """The best ``k`` (score, doc_id) of each item: higher scores first, then lesser ids, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.floor = np.zeros(items, np.int64)

    def offer(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, ids: list) -> None:
        """Sums sorted by item; ``doc`` are places in ``ids``. Scores of 0 never enter."""
        near = score >= np.maximum(self.floor[item], 1)
        item, doc, score = item[near], doc[near], score[near]
        begins = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else []
        for a, b in zip(begins, [*begins[1:], len(item)], strict=True):
            own, best = np.arange(a, b), score[a:b]
            if b - a > self.k:
                own = own[best >= np.partition(best, b - a - self.k)[b - a - self.k]]  # all that tie with the last stay
            heap = self.heaps[item[a]]
            for at in own:
                i = ids[doc[at]]
                entry = (int(score[at]), i is not None, 0 if i is None else -i)
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[item[a]] = heap[0][0]


def accumulate(found: DataFrame, lists: tuple[np.ndarray, np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The best ``k`` of each task for each item: at (its place in the block), doc_id, score."""
    held = found.sparkSession.sparkContext.broadcast((*lists, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, begins, w = held.value
        spread = np.diff(begins)
        heaps = Heaps(int(members.max()) + 1, k)

        def take(ids: list, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
            times = spread[term]
            ends = np.cumsum(times)
            item = members[np.repeat(begins[term] - ends + times, times) + np.arange(ends[-1] if len(ends) else 0)]
            keys = (item.astype(np.uint64) << np.uint64(16)) | np.repeat(doc, times).astype(np.uint64)
            order = radix_order(keys, 2)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], np.int64)
            if len(first):
                sums = np.add.reduceat(np.repeat(impact, times)[order], first)
                heaps.offer((keys[first] >> np.uint64(16)).astype(np.int64), (keys[first] & np.uint64(0xFFFF)).astype(np.int64), sums, ids)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            term = batch.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            m = 50 + (50 * batch.column("n").to_numpy(zero_copy_only=False) * n_docs) // n_terms
            doc = np.repeat(np.arange(len(ids)), np.diff(np.concatenate([[0], ends])))
            impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            grown = np.concatenate([[0], np.cumsum(spread[term])])[np.concatenate([[0], ends])]  # entries up to each document
            at = 0
            while at < len(ids):
                to = min(max(at + 1, int(np.searchsorted(grown, grown[at] + ENTRIES, "right")) - 1), len(ids), at + (1 << 16))
                a, b = (0 if at == 0 else ends[at - 1]), ends[to - 1]
                take(ids[at:to], doc[a:b] - at, term[a:b], impact[a:b])
                at = to
        rows = [(i, -d if there else None, s) for i, heap in enumerate(heaps.heaps) for s, there, d in heap]
        if rows:
            at, doc_id, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], ["at", "doc_id", "score"])

    return workers(found).mapInArrow(run, "at long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents for each item: item_id, rank (from 1), doc_id, score.

    ``docs`` has doc_id (long) and text, ``items`` item_id and text. Terms are runs of digits, ASCII letters (A-Z lower-cased) and all
    characters beyond ASCII. A term that df of the N documents with terms hold weighs floor(1000 ln((2N + 2) / (2df + 1))); a
    document of n of all L terms gives weight * (10^9 tf div (1000 tf + 20 m)) with m = 50 + (50 n N div L), in 64-bit integers.

    Every document is scored for every item that shares a term with it; nothing is pruned before the heaps, and ties go to the lesser
    doc_id, a null id last. Each row of ``items`` is an item of its own, and each row of ``docs`` a document, repeated ones too. Null
    texts and texts without terms are no documents; items without terms have no rows, nor has an empty table. Other columns are not
    read. Items go through in blocks of BLOCK_ITEMS items or BLOCK_TERMS terms, each block over all documents.
    """
    numbered = durable(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark, parts = docs.sparkSession, []
    for block in _blocks(numbered.select("item", "text")):
        found = durable(postings(docs, block.vocabulary))
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).head()
        if not n_docs:
            break
        weights = np.full(len(block.vocabulary), 0, np.int64)
        for term, df in found.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a block's vocabulary at most
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        best = accumulate(found, block.lists(), weights, n_docs, n_terms, k)
        names = spark.createDataFrame([Row(at=at, item=item) for at, item in enumerate(block.items)], "at long, item long")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        salted = best.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
        for keys in (["at", "salt"], ["at"]):
            salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
        parts.append(salted.join(names, "at").select("item", "rank", "doc_id", "score"))
    if not parts:
        return numbered.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, parts).join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")

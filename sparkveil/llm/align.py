"""Alignment of two tokenizers over the same bytes, and how often tokens of one end where tokens of the other do."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import durable, slices, workers
from sparkveil.llm.tokens import codec, pieces

#: An id pair with at least this fraction of all links is frequent; fewer than 1/FREQUENT pairs can be.
FREQUENT = 1 / (1 << 17)
#: Distinct pairs that a task counts before it hands on what it has.
HELD_PAIRS = 1 << 20


class ByteTokens:
    """Ids of a byte-level BPE file, faster than its library where that is proven to give the same ids.

    The rank library gets the file's vocabulary as ranks. On each character up to ``last``, between letters, digits, blanks and marks,
    it was compared with the file's own library; texts with any other character, or one that differs, go to the latter.
    """

    def __init__(self, path: str, pattern: str, strange: str):
        import tiktoken

        self.codec = codec(path)
        added = set(self.codec.library.get_added_tokens_decoder())
        ranks = {raw: i for i, raw in enumerate(self.codec.bytes_of) if i not in added}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile(strange)
        self.bytes_of = self.codec.bytes_of

    def encode(self, texts: list[str]) -> list[list[int]]:
        slow = [i for i, t in enumerate(texts) if self.odd.search(t)]
        found = dict(zip(slow, self.codec.encode([texts[i] for i in slow]), strict=True))
        return [found[i] if i in found else [x for p in pieces(t) for x in self.fast.encode_ordinary(p)] for i, t in enumerate(texts)]


@lru_cache(maxsize=4)
def strange_characters(path: str, pattern: str, last: int = 0xFFFF) -> str:
    """A regex class of the characters on which the two libraries were not seen to give the same ids."""
    own = ByteTokens(path, pattern, "(?!)")
    chars = [chr(c) for c in range(last + 1) if not 0xD800 <= c < 0xE000]
    probes = [" a{0}b1{0}2 {0} {0}{0}'{0}! {0}!\n{0}\n".format(c) for c in chars]
    same = [c for c, p, q in zip(chars, own.encode(probes), own.codec.encode(probes), strict=True) if p == q]
    ranges: list[list[int]] = []
    for c in map(ord, same):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[^" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in ranges) + "]"


class PieceTokens:
    """Ids of a sentencepiece model, and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Aligner:
    """Both tokenizers, and the digits of their ids with each mark that can follow."""

    def __init__(self, a_path: str, b_path: str, pattern: str, strange: str):
        self.a, self.b = ByteTokens(a_path, pattern, strange), PieceTokens(b_path)
        self.sizes = [np.array([len(x) for x in t.bytes_of], np.int64) for t in (self.a, self.b)]
        self.width = len(self.b.bytes_of)
        self.a_words = [f"{i}{mark}" for mark in ",|" for i in range(len(self.a.bytes_of))]
        self.b_words = [f"{i}{mark}" for mark in (",", ";", "") for i in range(self.width)]
        self.words = self.a_words + self.b_words

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of each text; none where either does not spell the text with a space before it."""
        full = [i for i, t in enumerate(texts) if t]
        a, b = [[] for _ in texts], [[] for _ in texts]
        for i, own_a, own_b in zip(full, self.a.encode([" " + texts[i] for i in full]), self.b.encode([texts[i] for i in full]), strict=True):
            whole = (" " + texts[i]).encode()
            if b"".join(map(self.a.bytes_of.__getitem__, own_a)) == whole and b"".join(map(self.b.bytes_of.__getitem__, own_b)) == whole:
                a[i], b[i] = own_a, own_b
        return a, b

    def align(self, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each A token, and each B token, ends a group, and the links as (place in A, place in B).

        Both lists spell the same bytes, so that one call may hold many texts one after another. B's intervals are a static index:
        two bisections stab it for each A token and give the B tokens that overlap it, ``low`` up to ``high``. A gap between two A
        tokens is spanned if both overlap one B token; what no B token spans is a group's end.
        """
        a_ends, b_ends = np.cumsum(self.sizes[0][a_ids]), np.cumsum(self.sizes[1][b_ids])
        low = np.searchsorted(b_ends, a_ends - self.sizes[0][a_ids], "right")
        high = np.searchsorted(b_ends - self.sizes[1][b_ids], a_ends, "left")
        cut = np.concatenate([high[:-1] <= low[1:], [True]]) if len(a_ids) else np.zeros(0, bool)
        last = high[cut] - 1
        b_cut = np.zeros(len(b_ids), bool)
        b_cut[last] = True
        links = np.flatnonzero(a_ends == b_ends[high - 1]) if len(a_ids) else np.zeros(0, np.int64)
        return cut, b_cut, np.stack([links, high[links] - 1], 1)

    def order(self, a_ids: np.ndarray, b_ids: np.ndarray, cut: np.ndarray, b_cut: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
        """Places in ``words`` that spell the groups of all texts; ``text_ends`` marks B tokens that are a text's last."""
        a_group, b_group = np.cumsum(cut) - cut, np.cumsum(b_cut) - b_cut
        a_at = np.arange(len(a_ids)) + np.searchsorted(b_group, a_group, "left")
        b_at = np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, "right")
        out = np.empty(len(a_ids) + len(b_ids), np.int64)
        out[a_at] = a_ids + np.where(cut, len(self.a.bytes_of), 0)
        mark = np.where(text_ends, 2, b_cut.astype(np.int64))
        out[b_at] = len(self.a_words) + b_ids + mark * self.width
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str, pattern: str, strange: str) -> Aligner:
    return Aligner(a_path, b_path, pattern, strange)


def _pack(pairs: np.ndarray) -> bytes:
    """Sorted pairs and their counts, as deltas."""
    own, counts = np.unique(pairs, return_counts=True)
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(own, prepend=0), counts]).astype(np.int64).tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)
    return np.cumsum(flat[: len(flat) // 2]), flat[len(flat) // 2 :]


def group(docs: DataFrame, a_path: str, b_path: str, pattern: str, groups: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links, with ``groups`` their text.

    ``links`` packs the distinct id pairs that end together, as A id * (size of B) + B id, with how often.
    """
    strange = strange_characters(a_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path, pattern, strange)
        for batch in slices(batches, "text", 1 << 20):
            a_lists, b_lists = own.tokens(batch.column("text").to_pylist())
            a_ids, b_ids = (np.fromiter((i for x in lists for i in x), np.int64, sum(map(len, lists))) for lists in (a_lists, b_lists))
            a_to, b_to = (np.cumsum([len(x) for x in lists]) for lists in (a_lists, b_lists))
            cut, b_cut, links = own.align(a_ids, b_ids)
            text_ends = np.zeros(len(b_ids), bool)
            text_ends[b_to[b_to > 0] - 1] = True
            order = own.order(a_ids, b_ids, cut, b_cut, text_ends)
            n_groups = np.concatenate([[0], np.cumsum(cut)])[np.concatenate([[0], a_to])]
            link_to = np.searchsorted(links[:, 0], a_to, "left")
            pairs = a_ids[links[:, 0]] * own.width + b_ids[links[:, 1]]
            shas, said, blobs = [], [], []
            for k in range(batch.num_rows):
                a, b = (a_to[k - 1] + b_to[k - 1] if k else 0), a_to[k] + b_to[k]
                text = "".join(map(own.words.__getitem__, order[a:b].tolist()))
                shas.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
                said.append(text)
                blobs.append(_pack(pairs[link_to[k - 1] if k else 0 : link_to[k]]))
            counts = [np.diff(x, prepend=0) for x in (a_to, b_to)] + [np.diff(n_groups), np.diff(link_to, prepend=0)]
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(blobs, pa.binary())]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
            if groups:
                arrays.append(pa.array(said, pa.string()))
                names.append("groups")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary" + ", groups string" * groups
    return workers(docs.select("doc_id", "text")).mapInArrow(run, schema)


def count_pairs(grouped: DataFrame) -> DataFrame:
    """pair, n: how many links of all rows hold each id pair. Tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def said() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

        for batch in batches:
            parts = [_unpack(x.as_py()) for x in batch.column("links")]
            if not parts:
                continue
            keys, at = np.unique(np.concatenate([keys, *(p for p, _ in parts)]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, *(n for _, n in parts)]), len(keys)).astype(np.int64)
            if len(keys) >= HELD_PAIRS:
                yield said()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield said()

    return workers(grouped.select("links")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _frequent(rows: DataFrame, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """What frequent pairs add to each row (row, n_best, count_sum), and the other pairs (row, pair, times)."""
    held = rows.sparkSession.sparkContext.broadcast((keys, counts, best))  # fewer than 1/FREQUENT pairs

    def met(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        pairs, times = _unpack(blob)
        at = np.searchsorted(held.value[0], pairs)
        at[at == len(held.value[0])] = 0
        return pairs, times, at, held.value[0][at] == pairs if len(held.value[0]) else np.zeros(len(pairs), bool)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("links"):
                _, times, at, hit = met(x.as_py())
                times, at = times[hit], at[hit]
                out.append((int(times[held.value[2][at]].sum()), int((times * held.value[1][at]).sum())))
            n_best, count_sum = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], ["row", "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in zip(batch.column("row").to_pylist(), batch.column("links"), strict=True):
                pairs, times, _, hit = met(x.as_py())
                if not hit.all():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full((~hit).sum(), row)), pa.array(pairs[~hit]), pa.array(times[~hit])], ["row", "pair", "times"])

    source = workers(rows.select("row", "links"))
    return source.mapInArrow(sums, "row long, n_best long, count_sum long"), source.mapInArrow(rest, "row long, pair long, times long")


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path`` is a byte-level BPE file that gets a space and the text, ``b_path`` a sentencepiece model that puts the space itself.
    Byte offsets where tokens of both end cut the text into groups. A link is a pair of tokens, one of each, that end together; the
    count of its id pair is how many links of all rows hold that pair. n_best counts the links whose pair is the most counted of
    its B id, ties included, count_sum adds the counts of all links.

    Null and empty texts, and texts that either tokenizer does not spell (a normalised character, say), have zeros and an empty
    groups_sha256. Repeated rows are rows of their own and count; an empty table gives an empty one. Other columns are not read.

    Counts of frequent pairs are broadcast, at most 1/FREQUENT of them whatever the data; the rest are joined.
    """
    rows = durable(group(docs, a_path, b_path, pattern).withColumn("row", F.monotonically_increasing_id()))
    counts = durable(count_pairs(rows).withColumn("b", F.col("pair") % F.lit(len(PieceTokens(b_path).bytes_of))))
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each B id
    known = durable(counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    total = known.agg(F.sum("n")).head()[0] or 0
    floor = max(2, total * FREQUENT)
    top = known.filter(F.col("n") >= floor).orderBy("pair").toPandas()
    sums, rest = _frequent(rows, top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool))
    rare = rest.join(known.filter(F.col("n") < floor), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"))
    out = rows.drop("links").join(sums, "row").join(rare, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )

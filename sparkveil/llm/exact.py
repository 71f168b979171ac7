"""Exact dedup through a minimal perfect hash over the digests of earlier rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import durable, join_by_weight, workers

#: Digests that one bucket of the index holds on average; buckets are of even size, as digests are.
BUCKET = 5_000


class PerfectHash:
    """A minimal perfect hash over distinct 32-byte digests, by levels of bit arrays.

    At each level the digests left hash into as many bits as they are; those alone on their bit stay,
    the others go on. A digest's slot is the rank of its bit among all set bits. Slots hold the whole
    digest and its winner's locator, so that a lookup compares bytes and no other digest is accepted.
    """

    def __init__(self, digests: np.ndarray, winners: np.ndarray):
        """digests: n x 4 of uint64, distinct; winners: n rows of anything."""
        self.levels: list[np.ndarray] = []
        n = len(digests)
        slot = np.full(n, -1, np.int64)
        left, offset = np.arange(n), 0
        while len(left):
            size = len(left)
            at = self._place(digests[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            rank = np.cumsum(alone) - 1
            mine = alone[at]
            slot[left[mine]] = offset + rank[at[mine]]
            offset += int(alone.sum())
            left = left[~mine]
        self.digests = np.empty_like(digests)
        self.winners = np.empty_like(winners)
        self.digests[slot], self.winners[slot] = digests, winners
        self._rest()

    def _rest(self) -> None:
        self.ranks = [np.cumsum(b) - 1 for b in self.levels]
        self.offsets = np.concatenate([[0], np.cumsum([int(b.sum()) for b in self.levels])]).astype(np.int64)

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = digests[:, 1] + np.uint64(level + 1) * (digests[:, 2] | np.uint64(1))
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            return (h % np.uint64(size)).astype(np.int64)

    def dump(self) -> tuple[bytes, bytes, bytes, bytes]:
        sizes = np.array([len(b) for b in self.levels], np.int64)
        bits = np.packbits(np.concatenate(self.levels)) if self.levels else np.array([], np.uint8)
        return sizes.tobytes(), bits.tobytes(), self.digests.tobytes(), self.winners.tobytes()

    @classmethod
    def load(cls, sizes: bytes, bits: bytes, digests: bytes, winners: bytes) -> PerfectHash:
        own = cls.__new__(cls)
        ends = np.cumsum(np.frombuffer(sizes, np.int64))
        flat = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)[: ends[-1] if len(ends) else 0]
        own.levels = np.split(flat, ends[:-1]) if len(ends) else []
        own.digests = np.frombuffer(digests, np.uint64).reshape(-1, 4)
        own.winners = np.frombuffer(winners, np.int64).reshape(len(own.digests), -1)
        own._rest()
        return own

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where the bytes in the slot differ or there is none."""
        out = np.full(len(digests), -1, np.int64)
        left = np.arange(len(digests))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(digests[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = self.offsets[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        found = out >= 0
        same = (self.digests[out[found]] == digests[found]).all(axis=1) if found.any() else np.array([], bool)
        out[np.flatnonzero(found)[~same]] = -1
        return out


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d) for d in digests), np.uint64).reshape(-1, 4)


def normalised(text: Column) -> Column:
    """Null counts as empty; a run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


_INDEX = "bucket long, sizes binary, bits binary, digests binary, winners binary"


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """An index row for each bucket of ``groups`` (bucket, digest binary, w_null, w_id, w_row long, n long), distinct by digest."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        winners = rows[["w_null", "w_id", "w_row", "n"]].to_numpy(np.int64)
        return pd.DataFrame([(rows["bucket"].iloc[0], *PerfectHash(_words(rows["digest"]), winners).dump())], columns=["bucket", "sizes", "bits", "digests", "winners"])

    return workers(groups).groupBy("bucket").applyInPandas(build, _INDEX)


def look_up(groups: DataFrame, index: DataFrame) -> DataFrame:
    """``groups`` with the found winner: h_null, h_id, h_row, h_n are null for a digest that is not in the index."""

    def find(new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = new[["digest", "w_null", "w_id", "w_row", "n"]].copy()
        for c in ("h_null", "h_id", "h_row", "h_n"):
            out[c] = pd.Series([None] * len(out), dtype="Int64", index=out.index)
        if len(held) and len(new):
            h = PerfectHash.load(*(bytes(held[c].iloc[0]) for c in ("sizes", "bits", "digests", "winners")))
            slots = h.find(_words(new["digest"]))
            hit = np.flatnonzero(slots >= 0)
            for k, c in enumerate(("h_null", "h_id", "h_row", "h_n")):
                out.iloc[hit, out.columns.get_loc(c)] = h.winners[slots[hit], k]
        return out

    schema = "digest binary, w_null long, w_id long, w_row long, n long, h_null long, h_id long, h_row long, h_n long"
    return workers(groups).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, schema)


def exact_dedup(docs: DataFrame, text: str = "text", history: float = 0.5) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and in_history of its text.

    The documents with the least ids, a fraction ``history`` of all, are the history: their distinct
    digests go into minimal perfect hashes (one for each bucket of digests) with the winner of each.
    The digests of the other rows are looked up there, byte for byte; those not found group by
    themselves. As history has the lesser ids, its winner wins. Digests are aggregated before any of
    this, so a text that a third of all rows share is one row.

    Null and empty texts are equal. Of rows with the same text the least doc_id stays, a null id after
    all others; of rows alike in both, exactly one. keep_id is null only where all ids of a text are.
    Other columns of ``docs`` are not read.
    """
    digest = F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256))
    rows = durable(docs.select("doc_id", digest.alias("digest")).withColumn("_sv_row", F.monotonically_increasing_id()))
    split = rows.stat.approxQuantile("doc_id", [history], 0.001) if rows.filter("doc_id is not null").take(1) else []
    split = split[0] if split else 0.0
    old = F.col("doc_id").isNotNull() & (F.col("doc_id") <= F.lit(split))
    first = F.min(F.struct(F.col("doc_id").isNull().cast("long").alias("w_null"), F.coalesce("doc_id", F.lit(0)).alias("w_id"), F.col("_sv_row").alias("w_row"))).alias("w")
    groups = rows.groupBy("digest", old.alias("old")).agg(first, F.count("*").alias("n"))
    groups = durable(groups.select("digest", "old", "w.*", "n"))
    largest = max([r["count"] for r in groups.groupBy("old").count().collect()] or [0])
    buckets = max(1, -(-largest // BUCKET))
    bucket = F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(buckets)).alias("bucket")
    keyed = groups.select(bucket, "*")
    index = durable(build_index(keyed.filter("old").drop("old"), buckets))
    met = look_up(keyed.filter("not old").drop("old"), index)
    new = met.select(
        "digest",
        *[F.coalesce(f"h_{c}", f"w_{c}").alias(f"w_{c}") for c in ("null", "id", "row")],
        (F.col("n") + F.coalesce("h_n", F.lit(0))).alias("n"),
        F.col("h_id").isNotNull().alias("in_history"),
    )
    new = durable(new)
    earlier = groups.filter("old").join(new.filter("in_history").select("digest", F.col("n").alias("m")), "digest", "left")
    earlier = earlier.select("digest", "w_null", "w_id", "w_row", F.coalesce("m", "n").alias("n"), F.lit(True).alias("in_history"))
    final = durable(earlier.unionByName(new.filter("not in_history")))
    total = max(1, final.agg(F.sum("n")).head()[0] or 0)
    met = join_by_weight(rows, final, ["digest"], "n", total, "inner")
    return met.select(
        "doc_id",
        F.when(F.col("w_null") == 0, F.col("w_id")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("_sv_row") == F.col("w_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "in_history",
    )

"""N-gram Jaccard join through a token-group matrix.

Documents become sets of hashed word shingles; equal sets become one. The join then has two halves:

1. Grouping. Sets with an equal least hash (of several hash functions) are compared to one pivot for each
   such hash and size band. Sets that links found there connect to one and the same set make a cluster that needs
   no further comparison inside; looser likeness makes families. A large cluster, and what else a family has, are
   cut into groups of bounded size and of like set sizes; every other set is a group by itself.
2. The matrix. For each group it stores the union of its members' early tokens (the rarest, at least one of
   which any link needs), with how many members have each and the sizes of these. A set's overlap with a
   group's union is counted by tokens, before any member is read. With the most that the later tokens can
   add, by the sizes, it bounds the overlap with any member. Only groups whose bound reaches what a link
   needs are opened: their members of other clusters are read and compared.

No link between different clusters is lost: the grouping only saves work, and the early tokens, the places of
tokens among them, and the bound are necessary conditions of a link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import durable, gathered, join_by_weight, workers
from sparkveil.llm.components import connected, pointed
from sparkveil.llm.shingles import Shingler, mix, overlap

#: Hash functions of the grouping.
PERMUTATIONS = 4
#: A token that batches of sets report this often, counting repeats inside a batch only, is common.
COMMON = 8
#: Tokens of such a batch.
BATCH_TOKENS = 1_000_000
#: Common tokens at most; if there are more, it takes more reports to be one.
MOST_COMMON = 4_000_000
#: Sets of one token in one batch from which they pass the deal of tokens by.
CROWD = 40
#: Sets of one group on average; also the size from which a cluster has groups of its own.
GROUP = 128
#: Comparisons with one pivot or group that a task makes on average.
SHARE = 250
#: Percent of likeness that makes a family.
FAMILY = 50
#: Sets of one group differ in size by this factor at most, so that sizes bound what their later tokens can add.
BAND = 1.05
#: Bits of the filter that keeps texts nobody asks for out of a shuffle: 10 for each asked, 32 MB at most. Over 25 million
#: asked ones it lets more and more others pass: then each text is compressed and dealt once, and results stay the same.
FILTER_BITS = 2**28


#: Bytes of a hash that stand for a token among the early ones. By 48 bits tokens are candidates only; links are decided by all 64.
KEPT = 6


def pack(hashes: np.ndarray) -> bytes:
    """The upper bytes of hashes, which keep their order."""
    return (hashes >> np.uint64(64 - 8 * KEPT)).view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _inside(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys a filter of ``_filter_bits`` lets pass."""
    mask, words = np.uint64(len(words) * 64 - 1), words.view(np.uint64)
    out = np.ones(len(keys), bool)
    for at in (keys & mask, (keys >> np.uint64(26)) & mask):
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _common_tokens(docs: DataFrame, size: int) -> np.ndarray:
    """A filter of the tokens that are frequent in the corpus; it lets few others pass.

    Every document is read; batches report the tokens that they hold twice or more, equal sets counted
    once, and reports add up. Of a token in d of n documents about d^2 * batch / n are reported, so passages
    that many documents share stand out, while nearly all tokens never leave their batch. The filter only sets the order
    of tokens: any will do for right results, as long as it is one for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(size)
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        n = 0

        def report() -> pa.RecordBatch:
            token = np.concatenate(held) if held else np.empty(0, np.uint64)
            held.clear()
            token.sort()
            token, count = np.unique(token[1:][token[1:] == token[:-1]], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64), pa.int64()), pa.array(count + 1, pa.int64())], ["key", "n"])

        for b in batches:
            for t in b.column("text"):
                h = s.hashes(t.as_py())
                if not len(h):
                    continue
                digest = h[:: max(1, len(h) // 4)].tobytes()
                if digest in seen:
                    continue
                seen.add(digest)
                held.append(h >> np.uint64(64 - 8 * KEPT))
                n += len(h)
                if n >= BATCH_TOKENS:
                    yield report()
                    seen, n = set(), 0
        yield report()

    reports = workers(docs.select("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = durable(reports.filter(F.col("n") >= COMMON))
    if counts.count() > MOST_COMMON:
        least = counts.approxQuantile("n", [1 - MOST_COMMON / counts.count()], 0.001)[0]
        counts = counts.filter(F.col("n") > least)
    return _filter_bits(counts.select("key"))


def _signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc, text_hash, n, d1, d2 (digest of the set), least (the hash functions' least values), prefix (packed tokens).

    Tokens are ordered by hash, common ones after all others. A set at Jaccard ``percent`` or more of
    another shares with it at least one of the first n - needed + 1 tokens.
    """
    shared = workers(docs).sparkSession.sparkContext.broadcast(_common_tokens(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(size)
        odd = [np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)) for k in range(PERMUTATIONS)]
        for b in batches:
            out: list[tuple] = []
            for t in b.column("text"):
                h = s.hashes(t.as_py())
                if not len(h):
                    out.append((0, 0, 0, [], b""))
                    continue
                whole = mix(h ^ np.uint64(0x517CC1B7))
                with np.errstate(over="ignore"):
                    digest = np.array([np.bitwise_xor.reduce(whole), (whole * whole).sum(dtype=np.uint64)]).view(np.int64)
                least = np.array([mix(h ^ o).min() for o in odd]).view(np.int64)
                p = len(h) - -(-len(h) * percent // 100) + 1
                common = _inside(shared.value, h >> np.uint64(64 - 8 * KEPT))
                out.append((len(h), int(digest[0]), int(digest[1]), least, pack(np.concatenate([h[~common], h[common]])[:p])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            made = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *made], ["doc", "text_hash", "n", "d1", "d2", "least", "prefix"])

    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return workers(source).mapInArrow(run, "doc long, text_hash long, n long, d1 long, d2 long, least array<long>, prefix binary")


def _filter_bits(keys: DataFrame) -> np.ndarray:
    """A Bloom filter over a column ``key`` of hashes, by two ranges of their bits; at most FILTER_BITS large.

    Where that is too small for all keys it only lets more pass: it saves work and decides nothing.
    """
    bits = 1 << max(16, min(FILTER_BITS.bit_length() - 1, (10 * keys.count()).bit_length()))
    places = keys.select(F.explode(F.array(F.pmod("key", F.lit(bits)), F.pmod(F.call_function("shiftrightunsigned", F.col("key"), F.lit(26)), F.lit(bits)))).alias("at"))
    word = F.expr("at div 64")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
    rows = places.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bit")).toPandas()
    words = np.zeros(bits // 64, np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64)
    return words


def _with_texts(rows: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (rep and others) with the text of each rep, compressed.

    Texts are read again, and compressed ones are dealt: sets of hashes would take several times the room.
    """
    rows = durable(gathered(rows))  # read twice, and each of its rows has come through several joins
    wanted = durable(sets.select("rep", "doc", "text_hash").join(rows.select("rep").distinct(), "rep", "left_semi"))
    key = F.xxhash64("doc", "text_hash")
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(wanted.select(key.alias("key"))))
    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), "text").withColumn("key", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            part = b.filter(pa.array(_inside(shared.value, b.column("key").to_numpy().view(np.uint64))))
            made = pa.array([press.compress(t.as_py().encode()) for t in part.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("text_hash"), made], ["doc", "text_hash", "packed"])

    found = workers(keyed).mapInArrow(run, "doc long, text_hash long, packed binary")
    # rows alike in id and text give one and the same set
    found = wanted.join(found.dropDuplicates(["doc", "text_hash"]), wanted["doc"].eqNullSafe(found["doc"]) & (wanted["text_hash"] == found["text_hash"])).select("rep", "packed")
    return rows.join(found, "rep")


class _Sets:
    """Sets of compressed texts."""

    def __init__(self, size: int):
        import zstandard

        self.shingler, self.press = Shingler(size), zstandard.ZstdDecompressor()

    def __call__(self, packed: bytes) -> np.ndarray:
        return self.shingler.hashes(self.press.decompress(packed).decode())


def _salt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (rep and ``key``) with a salt that gives each value of (key, salt) about SHARE rows."""
    rows = durable(rows)
    sizes = durable(rows.groupBy(key).agg(F.count("*").alias("w")))
    total = max(1, sizes.agg(F.sum("w")).head()[0] or 0)
    met = join_by_weight(rows, sizes, [key], "w", total, "inner")
    return met.withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("w") / SHARE))).drop("w")


def _pivot_links(sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, close): pairs at FAMILY percent or more of sets that have an equal least hash; close: they link."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)))
    entries = sets.select("rep", "n", F.posexplode("least").alias("k", "v")).select("rep", "n", F.xxhash64("k", "v", band).alias("key"))
    pivots = durable(entries.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("w")).filter("w > 1"))
    total = max(1, pivots.agg(F.sum("w")).head()[0] or 0)
    met = join_by_weight(entries, pivots, ["key"], "w", total, "inner").filter("rep <> pivot")
    # sets that agree in one least hash only are seldom alike; the matrix finds those that are
    met = met.groupBy("rep", "pivot").agg(F.count("*").alias("agree")).filter("agree > 1").drop("agree")
    met = durable(gathered(_salt(met, "pivot")))
    heads = met.select("pivot", "salt").distinct()
    rows = met.select("pivot", "salt", F.lit(False).alias("head"), "rep").unionByName(heads.select("pivot", "salt", F.lit(True).alias("head"), F.col("pivot").alias("rep")))
    rows = _with_texts(rows, sets, docs).select("pivot", "salt", "head", "rep", "packed")
    dealt = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("head").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets_of = None, _Sets(size)  # the pivot; memory holds its set and one other
        for b in batches:
            out: list[tuple] = []
            for pivot, salt, head, rep, raw in zip(*b.columns, strict=True):
                own = sets_of(raw.as_py())
                if head.as_py():
                    held = (pivot.as_py(), salt.as_py(), own)
                elif held and held[:2] == (pivot.as_py(), salt.as_py()):
                    common = overlap(own, held[2])
                    if linked(common, len(own), len(held[2]), FAMILY):
                        out.append((rep.as_py(), held[0], linked(common, len(own), len(held[2]), percent)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "close"])

    return workers(dealt).mapInArrow(run, "a long, b long, close boolean")


def _sized(rows: DataFrame, key: str, to: str) -> DataFrame:
    """``rows`` with the number of rows that have the same ``key``."""
    sizes = durable(rows.groupBy(key).agg(F.count("*").alias(to)))
    total = max(1, sizes.agg(F.sum(to)).head()[0] or 0)
    return join_by_weight(rows, sizes, [key], to, total, "inner")


def _grouped(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``sets`` with its cluster, its group, and the group's place in the order of who asks whom.

    Smaller clusters ask the groups of larger ones. Groups of a large cluster hold no one else (own);
    the others mix the small clusters of a family, and members of one group ask each other.
    """
    # families by all links and clusters by close ones, in one go; a family's nodes hold those of its clusters
    both = links.withColumn("strict", F.explode(F.when(F.col("close"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    heads = pointed(both.select("strict", "a", "b"), by=["strict"])
    heads = heads.groupBy(F.col("node").alias("rep")).agg(*(F.max(F.when(F.col("strict") == strict, F.col("head"))).alias(name) for name, strict in (("family", False), ("cluster", True))))
    rows = sets.select("rep", "n").join(heads, "rep", "left")
    rows = durable(gathered(rows.withColumn("alone", F.col("family").isNull()).withColumn("cluster", F.coalesce("cluster", "rep"))))
    single = rows.filter("alone").select(*rows.columns, F.lit(1).cast("long").alias("m"))
    several = _sized(rows.filter("not alone"), "cluster", "m").select(*single.columns)
    own = F.col("m") >= GROUP
    pool = F.when(own, F.xxhash64(F.lit("cluster"), "cluster")).otherwise(F.xxhash64(F.lit("family"), "family"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND))
    pooled = _sized(durable(gathered(several.withColumn("own", own).withColumn("pool", F.xxhash64(pool, band)))), "pool", "w")
    chunk = F.pmod(F.xxhash64(F.lit(5), "rep"), F.ceil(F.col("w") / GROUP))
    pooled = pooled.withColumn("grp", F.xxhash64("pool", chunk)).drop("pool", "w")
    single = single.withColumn("own", F.lit(False)).withColumn("grp", F.xxhash64(F.lit("alone"), "rep"))
    rows = pooled.unionByName(single.select(*pooled.columns))
    m, x = F.when(F.col("own"), F.col("m")).otherwise(F.lit(0)), F.when(F.col("own"), F.col("cluster")).otherwise(F.col("grp"))
    return durable(gathered(rows.select("rep", "n", "cluster", "grp", "own", "alone", F.struct(m.cast("long").alias("m"), x.alias("x")).alias("turn"))))


#: Rows of the token stream: a token of a set, a mark that a token has a crowd of sets, and a set that passes the deal by.
_TOKEN, _MARK, _LATE = 0, 1, 2


def _runs(keys: np.ndarray) -> np.ndarray:
    """For each element of a sorted array the number of its run."""
    return np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _spread(run: np.ndarray, grp: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """For each run the number of its groups; a mixed group with two sets or more counts twice."""
    order = np.lexsort((grp, run))
    r, g, m = run[order], grp[order], mixed[order]
    head = np.concatenate([[True], (r[1:] != r[:-1]) | (g[1:] != g[:-1])])
    again = np.concatenate([[False], ~head[1:] & head[:-1]]) & m  # the second set of a mixed group
    return np.bincount(r[head | again], minlength=int(run[-1]) + 1 if len(run) else 0)


def _shared_tokens(made: DataFrame, rows: DataFrame) -> DataFrame:
    """(token, rep, place): the prefix tokens that two groups have, or two sets of a mixed group, and more.

    Tokens are dealt by hash. Where one batch of sets already has a token in a crowd of sets, its rows go
    past the deal and one mark takes their place, so that no task gets a large part of all rows however
    frequent a token is.
    """
    early = made.select(F.col("row").alias("rep"), "prefix").join(rows.select("rep", F.when(F.col("alone"), 0).otherwise(F.col("grp")).alias("grp"), F.expr("not own and not alone").alias("mixed")), "rep")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                lists = part.column("prefix")
                raw = [np.frombuffer(x, np.uint8) for x in lists.to_pylist()]
                sizes = np.array([len(x) // KEPT for x in raw], np.int64)
                wide = np.zeros((int(sizes.sum()), 8), np.uint8)
                if len(wide):
                    wide[:, :KEPT] = np.concatenate(raw).reshape(-1, KEPT)
                token = wide.view(np.int64).ravel()
                i = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                rep, grp, mixed = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("rep", "grp", "mixed"))
                order = np.argsort(token, kind="stable")
                token, i, rep, grp, mixed = (x[order] for x in (token, i, rep, grp, mixed))
                run = _runs(token)
                common = _spread(run, np.where(grp == 0, rep, grp), mixed) > CROWD
                late = common[run] if len(run) else np.empty(0, bool)
                marks = np.unique(token[late])
                # one row: key, rep, grp (0 for a set alone in its group) and place * 8 + mixed * 4 + kind
                kind = np.where(late, _LATE, _TOKEN)
                key = np.where(late, rep, token)
                grp = np.where(late, token, grp)
                meta = i * 8 + mixed * 4 + kind
                columns = [(key, marks), (rep, 0 * marks), (grp, 0 * marks), (meta, 0 * marks + _MARK)]
                arrays = [pa.array(np.concatenate(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "rep", "grp", "meta"])

    dealt = workers(early).mapInArrow(deal, "key long, rep long, grp long, meta int")
    kind = F.pmod("meta", F.lit(4))
    dealt = dealt.repartition("key").sortWithinPartitions(kind == _LATE, "key", kind.desc())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["token", "rep", "place"], [pa.int64(), pa.int64(), pa.int32()]
        held: list[np.ndarray] | None = None
        known = None  # a token that is shared for certain: its rows pass at once

        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[1:4], kinds, strict=True)], names)

        def judge(c: list[np.ndarray]) -> pa.RecordBatch:
            run = _runs(c[1])
            mark = c[0] == _MARK
            tokens = ~mark
            w = np.zeros(int(run[-1]) + 1, np.int64)
            if tokens.any():
                got = _spread(run[tokens], c[4][tokens], c[5][tokens])
                w[: len(got)] = got
            w[run[mark]] = 2
            stay = tokens & (w[run] > 1)
            return out([x[stay] for x in c])

        for b in batches:
            key, rep, grp, meta = (x.to_numpy() for x in b.columns)
            c = [meta % 4, key, rep, meta // 8, np.where(grp == 0, rep, grp), meta // 4 % 2 == 1]
            past = c[0] == _LATE
            c[1] = np.where(past, grp, key)
            if past.any():
                yield out([x[past] for x in c])
                c = [x[~past] for x in c]
            if held is not None:
                c = [np.concatenate(x) for x in zip(held, c, strict=True)]
            if not len(c[1]):
                continue
            if known is not None and c[1][0] == known:
                n = int((c[1] == known).sum())
                same = [x[:n] for x in c]
                yield out([x[same[0] == _TOKEN] for x in same])
                c = [x[n:] for x in c]
            last = np.flatnonzero(c[1][:-1] != c[1][1:])
            cut = int(last[-1]) + 1 if len(last) else 0  # the last token may go on in the next batch
            if cut:
                yield judge([x[:cut] for x in c])
            held = [x[cut:] for x in c]
            if len(held[1]) > 50_000 and (_spread(np.zeros(len(held[1]), np.int64), held[4], held[5])[0] > 1 or (held[0] == _MARK).any()):
                known = held[1][0]
                yield out([x[held[0] == _TOKEN] for x in held])
                held = None
        if held is not None and len(held[1]):
            yield judge(held)

    return workers(dealt).mapInArrow(meet, "token long, rep long, place int")


def group_matrix(made: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The early tokens of sets as entries (token, rep and its group), and the matrix: a row for each group and token of its union.

    The matrix tells how many members have the token, the least and greatest of their sizes, and its
    earliest place. Tokens of one group only are left out, except where two members of a mixed group have them.
    """
    entries = durable(_shared_tokens(made, rows).join(rows.select("rep", "n", "grp", "own", "turn"), "rep"))
    union = entries.groupBy("token", F.col("grp").alias("to")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("place").alias("first"), F.first("turn").alias("their"), F.first("own").alias("pure"), F.count("*").alias("sets"))
    return entries, durable(union)


def bounded_pairs(entries: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """(rep, grp, tokens, opens): sets that share early tokens with a group's union, and whether the bound lets the group be opened.

    A link of sets of n and m tokens needs percent * (n + m) / (100 + percent) common ones. Those that are not
    early in both are all later ones of the set whose early tokens end first in the order, and its later
    ones are under percent / 100 of its size. So c shared early tokens admit a link only if
    100 * (100 + percent) * c + percent * (100 + percent) * max(n, m) >= 100 * percent * (n + m) for a size m that
    the group has; the difference is least at the least or the greatest m. Besides, the first shared token must leave enough after it.
    """
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    reach = F.least(n - F.col("place"), hi - F.col("first")) * (100 + percent) >= (n + lo) * percent
    fits = (hi * 100 >= n * percent) & (n * 100 >= lo * percent)
    asks = (F.col("turn") < F.col("their")) | ((F.col("grp") == F.col("to")) & ~F.col("pure") & (F.col("sets") > 1))
    met = entries.join(matrix, "token").filter(fits & asks)
    met = met.groupBy("rep", "to").agg(F.first("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("tokens"), F.bool_or(reach).alias("reaches"))
    least, most = F.greatest(F.floor(n * percent / 100), F.col("lo")), F.least(F.ceil(n * 100 / percent), F.col("hi"))

    def admits(m: Column) -> Column:
        return 100 * (100 + percent) * F.col("tokens") + percent * (100 + percent) * F.greatest(n, m) >= 100 * percent * (n + m)

    return met.select("rep", F.col("to").alias("grp"), "tokens", (F.col("reaches") & (admits(least) | admits(most))).alias("opens"))


def _open_groups(sets: DataFrame, rows: DataFrame, pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of the qualifying ``pairs`` (rep, grp) between sets of different clusters, as pairs (a, b) of these clusters.

    Tasks stream the asking sets past a group's members; memory holds one group of bounded size.
    """
    pairs = durable(gathered(_salt(pairs, "grp")))
    members = rows.select("rep", "grp").join(pairs.select("grp", "salt").distinct(), "grp")
    asked = members.select("grp", "salt", F.lit(True).alias("member"), "rep").unionByName(pairs.select("grp", "salt", F.lit(False).alias("member"), "rep"))
    asked = asked.join(rows.select("rep", "cluster"), "rep")
    asked = _with_texts(asked, sets, docs).select("grp", "salt", "member", "cluster", "packed")
    dealt = asked.repartition("grp", "salt").sortWithinPartitions("grp", "salt", F.col("member").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, sets_of = None, [], _Sets(size)
        for b in batches:
            out: list[tuple] = []
            for grp, salt, member, cluster, raw in zip(*b.columns, strict=True):
                here, own, whose = (grp.as_py(), salt.as_py()), sets_of(raw.as_py()), cluster.as_py()
                if here != at:
                    at, group = here, []
                if member.as_py():
                    group.append((whose, own))
                    continue
                done = {whose}  # clusters that need no further link
                for theirs, t in group:
                    if theirs not in done and min(len(own), len(t)) * 100 >= max(len(own), len(t)) * percent and linked(overlap(own, t), len(own), len(t), percent):
                        out.append((whose, theirs))
                        done.add(theirs)
            columns = list(zip(*out, strict=True)) if out else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b"])

    return workers(dealt).mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles (of its set), component_id, text_hash and winner.

    Two documents link when 100 * common >= percent * union of their sets of ``size``-word shingles;
    component_id is the least doc_id reachable by links, itself included. A document without words (a
    null or empty text too) links with nothing: its component is its own id. Rows are nodes of their
    own, whatever their ids: repeated rows are copies, and different texts under one id are different
    documents. Null ids take part; a component of such alone has a null id. Of each
    component, and of each document without words, one row is the winner: the one with the least doc_id,
    nulls last, and of those alike in it any one. Other columns of ``docs`` are not read.
    """
    own = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = durable(_signatures(own, size, percent).withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct("row", "doc", "text_hash", "least")).alias("x")
    distinct = durable(made.filter("n > 0").groupBy("n", "d1", "d2").agg(first, F.count("*").alias("copies"), F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("head")))
    sets = distinct.select(F.col("x.row").alias("rep"), "n", F.col("x.doc").alias("doc"), F.col("x.text_hash").alias("text_hash"), F.col("x.least").alias("least"))
    near = durable(_pivot_links(sets, own, size, percent))
    rows = _grouped(sets, near)
    opened = bounded_pairs(*group_matrix(made, rows), percent).filter("opens").select("rep", "grp")
    across = _open_groups(sets, rows, opened, own, size, percent)
    # from here on clusters are the nodes: links inside one say nothing new
    own_cluster = rows.select("rep", "cluster")
    close = near.filter("close").join(own_cluster.withColumnRenamed("rep", "a"), "a").select("cluster", "b").distinct()
    close = close.join(own_cluster.select(F.col("rep").alias("b"), F.col("cluster").alias("other")), "b").filter("cluster <> other").select(F.col("cluster").alias("a"), F.col("other").alias("b"))
    components = connected(across.unionByName(close)).withColumnRenamed("node", "cluster")
    named = distinct.select("n", "d1", "d2", "copies", "head", F.col("x.row").alias("rep")).join(own_cluster, "rep").join(components, "cluster", "left")
    named = durable(named.withColumn("component", F.coalesce("component", "cluster")).drop("cluster"))
    heads = named.groupBy("component").agg(F.min("head").alias("head"), F.count("*").alias("w"))
    heads = durable(heads)
    known = join_by_weight(named.drop("head"), heads, ["component"], "w", max(1, named.count()), "inner").select("n", "d1", "d2", "copies", F.col("head.doc").alias("component_id"), F.col("head.row").alias("head"))
    known = durable(gathered(known))
    full = made.filter("n > 0").select("doc", "text_hash", "n", "d1", "d2", "row")
    total = max(1, known.agg(F.sum("copies")).head()[0] or 0)
    out = join_by_weight(full, known, ["n", "d1", "d2"], "copies", total, "inner")
    empty = made.filter("n = 0").select("doc", "text_hash", "n", F.col("doc").alias("component_id"), F.lit(True).alias("winner"))
    both = out.select("doc", "text_hash", "n", "component_id", (F.col("row") == F.col("head")).alias("winner")).unionByName(empty)
    return both.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "text_hash", "winner")

"""Document classifiers trained here: toxicity by multiple-instance learning, quality by compression.

Both are fitted on the driver from a bounded sample of labelled rows (the smallest hashes of each class,
so the same rows at any partitioning) and applied to every whole text. Only the text enters a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import crc_fold, slices, workers


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int, seed: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts with their label, at most ``per_class`` of each class, and how many labelled rows each class has.

    Rows of fold 0 (see ``crc_fold``) and null labels take no part. An id with labels that disagree takes
    the larger. Texts of any length take part as long as those of a class have per_class * most_chars
    characters together, the bound on what reaches the driver; one that would exceed it is passed over.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (crc_fold() != 0))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = [own.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_class rows at most
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).withColumn("t", F.xxhash64("text"))
    found = rows.join(ids, "doc_id").select("y", order.alias("h"), "doc_id", "t", F.length("text").alias("size")).orderBy("h", "doc_id", "t").limit(2 * per_class).collect()
    room, chosen = [per_class * most_chars] * 2, []
    for r in found:  # lengths first: only texts that fit are fetched
        if r["size"] <= room[r["y"]]:
            room[r["y"]] -= r["size"]
            chosen.append(r)
    if not chosen:
        return [], sizes
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = F.broadcast(docs.sparkSession.createDataFrame(sorted({(r["doc_id"], r["t"]) for r in chosen}), f"doc_id {kind}, t long"))  # 2 * per_class rows at most
    texts = {(r["doc_id"], r["t"]): r["text"] for r in rows.join(keys, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).collect()}
    return [(texts[r["doc_id"], r["t"]], r["y"]) for r in chosen], sizes


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


# ---------------------------------------------------------------- toxicity

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?\n]+")
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """A word and its beginnings of 3 to 6 characters, so that inflected forms share weight."""
    return [word, *("^" + word[:k] for k in range(3, min(6, len(word)) + 1))]


@dataclass
class ToxicModel:
    """Weights of word features and the base of a sentence; a document is toxic if any sentence is."""

    base: float
    weights: dict[str, float]
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, w: str) -> float:
        s = self.cache.get(w)
        if s is None:
            s = sum(self.weights.get(f, 0.0) for f in word_features(w))
            if len(w) < 64:
                if len(self.cache) > 500_000:
                    self.cache.clear()
                self.cache[w] = s
        return s

    def sentence(self, text: str) -> float:
        """The logit of a sentence: the base and the weights of its distinct words."""
        return self.base + sum(map(self.word, set(_WORD.findall(text.lower()))))

    def score(self, text: str, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of the sentences' scores, and the sentences that score ``least`` or more."""
        clean, located = 0.0, []
        for m in _SENTENCE.finditer(text):
            z = self.sentence(m[0])
            clean -= math.log1p(math.exp(z)) if z < 30 else z
            if z > 0 or least < 0.5:
                p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
                if p >= least:
                    located.append((m.start(), m.end(), p))
        return -math.expm1(clean), located


#: Characters of the clean text that the fit joins from all clean texts of the sample, and what its score may be.
LONG_CHARS, LONG_SCORE = 10_000_000, 0.1


def fit_toxic(sample: list[tuple[str, int]], sizes: dict[int, int], most_features: int = 3000, steps: int = 250, rate: float = 0.1) -> ToxicModel:
    """Fit sentence weights from document labels by gradient descent on the noisy-or log-loss.

    Features are those whose presence in a document goes with the label (by the G statistic). Classes
    are weighted to their share of all labelled rows. The clean texts, joined and repeated to LONG_CHARS
    characters, are a further clean document while it scores over LONG_SCORE: else a text would count
    as toxic for its length alone. Without both classes the score is constant.
    """
    n_of = {y: sum(1 for _, z in sample if z == y) for y in (0, 1)}
    share = (sizes.get(1, 0) + 1) / (sizes.get(0, 0) + sizes.get(1, 0) + 2)
    if not n_of[0] or not n_of[1]:
        return ToxicModel(math.log(share / (1 - share)), {})
    counts: dict[str, list[int]] = {}
    for text, y in sample:
        for f in {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}:
            counts.setdefault(f, [0, 0])[y] += 1

    def gain(c: list[int]) -> float:
        g = 0.0
        for here, row in ((c, sum(c)), ([n_of[0] - c[0], n_of[1] - c[1]], len(sample) - sum(c))):
            for y in (0, 1):
                if here[y]:
                    g += 2 * here[y] * math.log(here[y] * len(sample) / (row * n_of[y]))
        return g

    kept = sorted(((gain(c), f) for f, c in counts.items() if sum(c) >= 4), key=lambda x: (-x[0], x[1]))
    names = [f for g, f in kept[:most_features] if g > 15]
    index = {f: i for i, f in enumerate(names)}
    rows, cols, owner = [], [], []
    for d, (text, _) in enumerate(sample):
        for m in _SENTENCE.finditer(text):
            for w in set(_WORD.findall(m[0].lower())):
                for f in word_features(w):
                    if f in index:
                        rows.append(len(owner))
                        cols.append(index[f])
            owner.append(d)
    rows, cols, owner = np.array(rows, np.int64), np.array(cols, np.int64), np.array(owner, np.int64)
    y = np.array([z for _, z in sample], float)
    cost = np.where(y == 1, share / n_of[1], (1 - share) / n_of[0])
    clean_chars = sum(len(t) for t, z in sample if z == 0)
    joined = np.where(y == 0, max(1.0, LONG_CHARS / max(1, clean_chars)), 0.0)  # how often each text is in the long one
    theta = np.concatenate([np.zeros(len(names)), [-6.0]])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.full(len(owner), theta[-1]) + np.bincount(rows, theta[cols], minlength=len(owner))
        p = sigmoid(z)
        clean = np.bincount(owner, np.logaddexp(0, z), minlength=len(y))  # -log of the chance of no toxic sentence
        # the slope of the loss by `clean`: 1 for clean documents, -q/(1-q) for toxic ones
        slope = cost * np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(clean, 500)), 1e-9), 1.0)
        if (long := joined @ clean) > -math.log1p(-LONG_SCORE):  # bounded, as ``long`` is large at first
            slope = slope + joined * (1 - share) / max(1.0, long)
        by_sentence = slope[owner] * p
        grad = np.concatenate([np.bincount(cols, by_sentence[rows], minlength=len(names)) + 2e-6 * theta[:-1], [by_sentence.sum() + 1e-5]])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
    return ToxicModel(float(theta[-1]), {f: float(w) for f, w in zip(names, theta, strict=False) if abs(w) > 1e-3})


def score_toxic(docs: DataFrame, model: ToxicModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score every whole text and locate its offending sentences.

    Returns ``keep``, score (0 to 1), predicted (1 from 0.5 on), n_sentences located, and starts and
    ends of these in code points. Null and empty texts have no sentence and score 0. Other columns of
    ``docs`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.base, model.weights))  # at most the fitted features
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_sv_text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicModel(*shared.value)
        for batch in slices(batches, "_sv_text", 8 << 20):
            got = [own.score(t.as_py()) for t in batch.column("_sv_text")]
            arrays = [
                pa.array([s for s, _ in got], pa.float64()),
                pa.array([int(s >= 0.5) for s, _ in got], pa.int32()),
                pa.array([len(at) for _, at in got], pa.int32()),
                pa.array([[a for a, _, _ in at] for _, at in got], pa.list_(pa.int32())),
                pa.array([[b for _, b, _ in at] for _, at in got], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], "score", "predicted", "n_sentences", "starts", "ends"])

    return workers(source).mapInArrow(run, head + "score double, predicted int, n_sentences int, starts array<int>, ends array<int>")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2500, most_chars: int = 32_000, seed: int = 2) -> DataFrame:
    """Train on ``labels.toxic`` outside fold 0 and score all documents; see ``score_toxic``."""
    sample, sizes = labelled_sample(docs, labels, "toxic", per_class, most_chars, seed)
    return score_toxic(docs, fit_toxic(sample, sizes))


# ---------------------------------------------------------------- quality


@dataclass
class QualityModel:
    """Two compression dictionaries and the calibration of the sizes they give: shares of good text at differences, linear between."""

    bad: bytes
    good: bytes
    knots: list[float]
    shares: list[float]
    chunk: int = 512
    level: int = 3

    def __post_init__(self):
        import zstandard as z

        self.presses = []
        for content in (self.bad, self.good):
            d = z.ZstdCompressionDict(content)  # with its entropy tables, if it was trained
            d.precompute_compress(level=self.level)
            self.presses.append(z.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> tuple[int, int, int]:
        """Bytes, compressed bytes by the bad and by the good dictionary. Each chunk starts afresh, so that
        the dictionaries count as much at the end of a long text as at its beginning."""
        raw = text.encode()
        bad, good = self.presses[0].compress, self.presses[1].compress
        b = g = 0
        for at in range(0, len(raw), self.chunk):
            piece = raw[at : at + self.chunk]
            b += len(bad(piece))
            g += len(good(piece))
        return len(raw), b, g

    def score(self, sizes: tuple[int, int, int]) -> float:
        return float(np.interp(difference(*sizes), self.knots, self.shares))


def difference(raw: int, bad: int, good: int) -> float:
    """The normalised compressed-size difference: how much more of the text's bytes the good dictionary saves, in per cent."""
    return 100 * (bad - good) / raw if raw else 0.0


def fit_quality(sample: list[tuple[str, int]], sizes: dict[int, int], dictionary_bytes: int = 65_536, chunk: int = 512) -> QualityModel:
    """Dictionaries from one half of each class, the calibration from the other.

    Every text of the sample is read whole: those of one half train a dictionary in pieces of ``chunk`` bytes,
    those of the other are compressed like any scored text. The calibration is the share of good text as it grows with
    the normalised size difference (isotonic regression), and of nothing else. Classes are weighted to their share of all labelled rows. Without both classes the score is constant.
    """
    import zstandard as z

    by = {y: [t for t, v in sample if v == y] for y in (0, 1)}
    share = (sizes.get(1, 0) + 1) / (sizes.get(0, 0) + sizes.get(1, 0) + 2)
    content = {}
    for y, texts in by.items():
        parts = [raw[at : at + chunk] for raw in map(str.encode, texts[0::2]) for at in range(0, len(raw), chunk)]
        try:
            content[y] = z.train_dictionary(dictionary_bytes, parts, k=50, d=8).as_bytes()
        except z.ZstdError:  # too little text to choose from: the text itself serves
            content[y] = b"".join(parts)[-dictionary_bytes:]
    model = QualityModel(content[0] or b" " * 16, content[1] or b" " * 16, [0.0], [share], chunk)
    held = [(difference(*model.sizes(t)), y) for y in (0, 1) for t in by[y][1::2]]
    if len({y for _, y in held}) < 2:
        return model
    n = {v: sum(1 for _, y in held if y == v) for v in (0, 1)}
    weight = {1: share / n[1], 0: (1 - share) / n[0]}
    pools: list[list[float]] = []  # weight of good text, of all, and of all times the difference; shares grow from one to the next
    for d, y in sorted(held):
        w = weight[y]
        pools.append([w * y, w, w * d])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    few = min(weight.values()) / 2  # half a row of either class: no share is 0 or 1
    model.knots = [d / w for _, w, d in pools]
    model.shares = [float(x) for x in np.maximum.accumulate([(good + few) / (w + 2 * few) for good, w, _ in pools])]
    return model


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", cut: float = 0.3) -> DataFrame:
    """``docs`` with raw_bytes, bad_bytes, good_bytes (compressed sizes), score and predicted (1 from ``cut`` on).

    Null and empty texts compress to nothing and get the score of no evidence. Columns of ``docs`` that
    have one of these names are replaced; all others are kept.
    """
    added = "raw_bytes long, bad_bytes long, good_bytes long, score double, predicted int"
    own = [c for c in docs.columns if c.lower() not in {a.split()[0] for a in added.split(", ")}]
    source = docs.select(*[F.col(f"`{c}`") for c in own])
    shared = docs.sparkSession.sparkContext.broadcast((model.bad, model.good, model.knots, model.shares, model.chunk, model.level))  # two dictionaries of fixed size
    at = own.index(text)
    from pyspark.sql.types import StructType

    schema = StructType(source.schema.fields + StructType.fromDDL(added).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = QualityModel(*shared.value)
        for batch in slices(batches, text, 4 << 20):
            sizes = [m.sizes(t.as_py() or "") for t in batch.column(at)]
            scores = [m.score(s) for s in sizes]
            arrays = [pa.array([s[k] for s in sizes], pa.int64()) for k in range(3)]
            arrays += [pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "raw_bytes", "bad_bytes", "good_bytes", "score", "predicted"])

    return workers(source).mapInArrow(run, schema)


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2500, most_chars: int = 32_000, seed: int = 10) -> QualityModel:
    """Train on ``labels.quality`` outside fold 0."""
    return fit_quality(*labelled_sample(docs, labels, "quality", per_class, most_chars, seed))

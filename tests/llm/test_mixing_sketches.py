import hashlib
import math
import random
import re

import numpy as np
import pytest

import xxhash

from sparkveil.llm import mixing, sketches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, repetition string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "clash") for i, t, s in rows], SCHEMA)


def brute_count(seed, doc_id, mean):
    import hashlib

    u = (int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    k, term = 0, math.exp(-mean)
    total = term
    while total < u and k < 1000:
        k += 1
        term *= mean / k
        total += term
    return k


def test_mix_against_brute_force(spark):
    rows = [(i, f"t{i}", "big" if i % 3 == 0 else f"s{i % 7}") for i in range(600)] + [(600, None, None), (601, "", None)]
    counts = {}
    for _, _, s in rows:
        counts[s] = counts.get(s, 0) + 1
    mass = sum(math.sqrt(n) for n in counts.values())
    got = {}
    for x in mixing.mix(docs(spark, rows)).collect():
        got.setdefault(x.doc_id, []).append(x.repetition)
    want = {i: brute_count(8, i, len(rows) * (math.sqrt(counts[s]) / mass) / counts[s]) for i, _, s in rows}
    assert {i: sorted(r) for i, r in got.items()} == {i: list(range(1, k + 1)) for i, k in want.items() if k}


def test_mix_meets_targets_and_shuffles(spark):
    rows = [(i, "x", "a" if i % 10 else "b") for i in range(4000)]
    got = mixing.mix(docs(spark, rows), weights={"a": 1.0, "b": 1.0}).collect()
    share = sum(x.source == "b" for x in got) / len(got)
    assert abs(share - 0.5) < 0.05 and abs(len(got) / 4000 - 1) < 0.06
    ids = [x.doc_id for x in got]
    assert abs(np.corrcoef(np.arange(len(ids)), ids)[0, 1]) < 0.1
    assert {x.source for x in mixing.mix(docs(spark, rows), weights={"a": 1.0}).collect()} == {"a"}


def test_mix_edges(spark):
    assert mixing.mix(docs(spark, [(1, "x", "a")]).filter("false")).count() == 0
    twice = mixing.mix(docs(spark, [(1, "x", "a"), (1, "x", "a")]), epochs=3.0).collect()
    n = sum(x.repetition == 1 for x in twice)
    assert n in (0, 2) and len(twice) % 2 == 0
    with pytest.raises(Exception, match="exceeds 700"):
        mixing.mix(docs(spark, [(1, "x", "a"), (2, "x", "b")]), epochs=2000.0).count()


@pytest.mark.parametrize("mean", [0.0, 0.3, 1.0, 45.0, 699.0, 1086.0, 50_000.0])
def test_poisson_cdf_against_logarithms(mean):
    least, cdf = mixing.poisson_cdf(mean)
    chance = [math.exp(-mean + j * math.log(mean) - math.lgamma(j + 1)) if mean else float(j == 0) for j in range(mixing.bound(mean))]
    assert least + len(cdf) == len(chance) and sum(chance[:least]) < 1e-16
    assert np.abs(np.cumsum(chance)[least:] - cdf).max() < 1e-9


def test_mix_of_rare_sources_with_rates_over_700(spark):
    n = 600_000  # one source, and one row each of a new and of a null source
    large = spark.range(n).selectExpr("id as doc_id", "'x' as text", "'en' as lang", "'large' as source", "0L as n_chars", "'clash' as repetition")
    got = mixing.mix(large.unionByName(docs(spark, [(n, "rare", "new"), (n + 1, "none", None)])))
    rate = (n + 2) / (math.sqrt(n) + 2)
    assert rate > 700
    kept = {}
    for x in got.filter(f"doc_id >= {n}").collect():
        kept.setdefault(x.doc_id, []).append(x.repetition)
    for i in (n, n + 1):
        u = (int(hashlib.md5(f"8:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        cdf = np.cumsum([math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) for j in range(2000)])
        assert sorted(kept[i]) == list(range(1, int((cdf < u).sum()) + 1))
    assert abs(got.filter(f"doc_id < {n}").count() / n - math.sqrt(n) / (math.sqrt(n) + 2)) < 0.01


def test_sketch_estimates_and_merges():
    r = random.Random(5)
    words = [str(r.random()) for _ in range(40_000)]
    s = sketches.Scaled(4, 3)
    big, small, other = " ".join(words), " ".join(words[100:3100]), " ".join(words[::-1][:3000])
    a, b = s.sketch(big), s.sketch(small)
    assert s.containment(b, a) > 0.99 and abs(s.containment(a, b) - 3000 / 40_000) < 0.02
    assert s.likeness(b, s.sketch(other)) < 0.01
    every = s.shingles.hashes(big)
    assert (a == every[every < 2**62]).all()  # all below the fixed fraction, and no others
    half, rest = s.sketch(" ".join(words[:20_000])), s.sketch(" ".join(words[20_000:]))
    merged = s.merge(half, rest)
    assert (merged == np.union1d(half, rest)).all() and len(np.setdiff1d(a, merged)) <= 2  # but for shingles over the seam
    assert s.likeness(s.sketch(""), s.sketch(None)) == 1.0 and s.likeness(s.sketch(""), b) == 0.0
    assert (sketches.from_text(sketches.text_of(b)) == b).all()


def framed(text, size=3):
    """Word shingles as tuples, by a plain reading of the definition."""
    words = ["", ""] + ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)] + ["", ""]
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) > 4 else set()


def brute_edits(rows):
    """(id, length, edited text, sketches by definition, true likenesses) of every row."""
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1]), x[1]))
    out = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        q = len(t) // 4
        new = t[: len(t) - q] + following[:q]
        a, b, c = framed(t), framed(new), framed(following)
        jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((i if i is not None else -1, len(t), hashlib.sha256(new.encode()).hexdigest(), len(a), len(b), jaccard(a, b), jaccard(a, c)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_edit_likeness_against_true_shingles(spark, parts):
    r = random.Random(parts)
    rows = [(i * 3, " ".join(r.choice(["ab", "Cd", "é", "😀", "É"]) + str(r.randrange(90)) for _ in range(r.randrange(0, 200)))) for i in range(120)]
    rows += [(50, None), (50, "same id"), (50, "same id"), (None, "no id"), (10_000, "w " * 20_000)]
    rows += [(60, f"hot id {k}") for k in range(80)] + [(None, f"null id {k}") for k in range(80)]
    r.shuffle(rows)
    frame = docs(spark, [(i, t, "s") for i, t in rows])
    exact = sketches.edit_likeness(frame, scale=1, parts=parts).collect()
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_chars, x.edited_sha256, len(x.fingerprint) // 16, len(x.edited_fingerprint) // 16, x.near_edited, x.near_next) for x in exact)
    want = brute_edits(rows)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want])  # at scale 1 sketches hold all shingles
    by = {(x.doc_id, x.edited_sha256): x for x in exact}
    sampled = [(x, by[x.doc_id, x.edited_sha256]) for x in sketches.edit_likeness(frame, parts=parts).collect()]
    long = [(x, y) for x, y in sampled if len(y.fingerprint) > 16 * 50]
    assert len(long) > 60 and np.mean([abs(x.near_edited - y.near_edited) for x, y in long]) < 0.06
    assert np.mean([len(x.fingerprint) / len(y.fingerprint) for x, y in long]) == pytest.approx(0.5, abs=0.05)


def test_edit_likeness_edges(spark):
    assert sketches.edit_likeness(docs(spark, [(1, "a", "s")]).filter("false")).count() == 0
    (x,) = sketches.edit_likeness(docs(spark, [(1, "a b c d e f g h", "s")])).collect()
    assert x.near_next == 1.0 and x.n_chars == 15
    assert sketches.sketch_documents(docs(spark, [(1, "a", "s")])).count() == 1


def test_fingerprints_read_no_column_of_a_clashing_name(spark):
    rows = [(1, "some words of a text", "x", 0.5), (2, "other words of a text", "x", 0.5)]
    plain = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    clash = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, near_next double")
    assert sorted(map(tuple, sketches.edit_likeness(clash).collect())) == sorted(map(tuple, sketches.edit_likeness(plain).collect()))

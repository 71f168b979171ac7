import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from sparkveil.llm import exact, joins, lines
from sparkveil.llm.components import connected
from sparkveil.llm.shingles import Shingler, overlap

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sites int"


def docs(spark, rows, schema=SCHEMA):
    full = [(i, t, "en", s, len(t or ""), 1) for i, t, s in rows]
    return spark.createDataFrame(full, schema)


def test_perfect_hash_is_minimal_and_rejects_strangers():
    r = np.random.default_rng(0)
    digests = r.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    h = exact.PerfectHash(digests, np.arange(5000, dtype=np.int64).reshape(-1, 1))
    h = exact.PerfectHash.load(*h.dump())
    slots = h.find(digests)
    assert sorted(slots) == list(range(5000))
    assert (h.winners[slots, 0] == np.arange(5000)).all()
    near = digests.copy()
    near[:, 0] ^= np.uint64(1)  # the same place, another digest
    assert (h.find(near) == -1).all()
    assert len(exact.PerfectHash(digests[:0], np.empty((0, 1), np.int64)).find(digests[:3])) == 3


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")): (min((x for x in groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")] if x is not None), default=None), len(groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")])) for i, t in rows}


def test_exact_dedup_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(4)))) for i in range(300)] + [(300, None), (301, "a\t b"), (302, "z" * 50_000), (303, "z" * 50_000)]
    r.shuffle(rows)
    got = exact.exact_dedup(docs(spark, [(i, t, "s") for i, t in rows])).collect()
    want = brute_exact(rows)
    texts = dict(rows)
    assert len(got) == len(rows)
    for g in got:
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", texts[g.doc_id] or "")
        assert (g.keep_id, g.group_size) == want[g.doc_id, plain]
        assert g.kept == (g.keep_id == g.doc_id)
        assert g.text_sha256 == hashlib.sha256(plain.encode()).hexdigest()


def test_exact_dedup_edges(spark):
    assert exact.exact_dedup(docs(spark, [(1, "a", "s")]).filter("false")).count() == 0
    got = exact.exact_dedup(docs(spark, [(5, "a", "s"), (5, "a", "s"), (None, "a", "s"), (None, "b", "s")])).collect()
    assert sorted((g.keep_id or -1, g.group_size, g.kept) for g in got) == [(-1, 1, True), (5, 3, False), (5, 3, False), (5, 3, True)]


def brute_lines(rows, k):
    sites, first = defaultdict(set), {}
    for i, t, s in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip():
                sites[line.strip()].add(s)
                first.setdefault(line.strip(), (i, p))
    out = {}
    for i, t, _ in rows:
        kept = [x for p, x in enumerate((t or "").split("\n")) if not x.strip() or len(sites[x.strip()]) < k or first[x.strip()] == (i, p)]
        out[i] = None if t is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("k", [2, 3, 10])
def test_line_dedup_against_brute_force(spark, k):
    r = random.Random(k)
    rows = [(i, "\n".join(r.choice(["menu", " menu ", "terms", "x", "", f"own {i}", f"pair {i // 4}"]) for _ in range(r.randrange(1, 8))), f"s{r.randrange(12)}") for i in range(200)]
    rows += [(200, None, "s1"), (201, "", None), (202, "menu\nlast", None), (203, "long\n" * 3000, "s3")]
    got = {x.doc_id: x for x in lines.drop_spread_lines(docs(spark, rows), k).collect()}
    want = brute_lines(rows, k)
    assert {i: x.text for i, x in got.items()} == want
    assert got[200].n_lines == 0 and got[203].sites == 1


def test_line_dedup_edges(spark):
    assert lines.drop_spread_lines(docs(spark, [(1, "a", "s")]).filter("false")).count() == 0
    same = docs(spark, [(1, "a\nb", f"s{k}") for k in range(4)])
    assert [x.text for x in lines.drop_spread_lines(same, 3).collect()] == ["a\nb"] * 4  # rows alike in id and text
    far = docs(spark, [(k, "a\nb", f"s{k}") for k in range(4)])
    assert sorted(x.text for x in lines.drop_spread_lines(far, 3, keep_first=False).collect()) == [""] * 4


def brute_components(rows, size, percent):
    s = Shingler(size)
    sets = [s.hashes(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a]) and len(sets[b]):
                c = overlap(sets[a], sets[b])
                if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                    parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(sets[a]), least[find(a)]) for a, (i, _) in enumerate(rows))


def test_jaccard_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(joins, "GROUP", 8)  # several groups to a family even in a small test
    monkeypatch.setattr(joins, "SHARE", 4)
    r = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    passage = [r.choice(words) for _ in range(20)]
    rows = []
    for k in range(12):
        base = [r.choice(words) for _ in range(r.randrange(20, 90))]
        for _ in range(r.randrange(1, 14)):
            copy = list(base)
            for _ in range(r.randrange(0, 5)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(" ".join(copy))
    for k in range(40):  # a passage that many otherwise different documents share
        rows.append(" ".join(passage + [r.choice(words) for _ in range(r.randrange(1, 30))]))
    rows += ["", "  \n ", "one", "One", "one two three", "ONE two\tthree", "é É é É", "É É é É"]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    made = docs(spark, [(i, t, "s") for i, t in rows])
    for size, percent in ((4, 85), (5, 80), (2, 50)):
        got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in joins.jaccard_components(made, size, percent).collect())
        assert got == brute_components(rows, size, percent)


def test_jaccard_edges(spark):
    assert joins.jaccard_components(docs(spark, [(1, "a", "s")]).filter("false")).count() == 0
    text = " ".join(f"w{k}" for k in range(40))
    got = joins.jaccard_components(docs(spark, [(3, text, "s"), (3, text, "s"), (None, text, "s"), (7, text + " end", "s"), (8, None, "s"), (None, None, "s")])).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0, x.n_shingles) for x in got) == [(0, 0, 0), (0, 3, 36), (3, 3, 36), (3, 3, 36), (7, 3, 37), (8, 8, 0)]


def test_jaccard_of_very_long_texts_and_clashing_names(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(50_000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:110_000])), (3, " ".join(words[:60_000])), (4, " ".join(words[::-1]))]
    frame = spark.createDataFrame([(i, t, 9, 9, 9, 9) for i, t in rows], "doc_id long, text string, component_id long, n_shingles int, rep long, grp long")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in joins.jaccard_components(frame, 5, 80).collect())
    assert got == brute_components(rows, 5, 80) and got[1][2] == 1 and got[2][2] == 3


def test_groups_are_bounded_out_before_they_are_opened(spark, monkeypatch):
    """The bound from stored unions refuses groups that share a few early tokens only, and none that has a link."""
    seen = []
    real = joins.bounded_pairs
    monkeypatch.setattr(joins, "bounded_pairs", lambda *a: seen.append(real(*a).cache()) or seen[-1])
    r = random.Random(2)
    rows = [(k, " ".join([f"u{k}x{j}" for j in range(100)] + [f"v{k // 2 if k < 30 else k}x{j}" for j in range(50)])) for k in range(40)]  # a third of the first is shared by two
    for k in range(30, 40):  # near copies
        words = rows[k][1].split()
        words[r.randrange(len(words))] = "other"
        rows.append((k + 100, " ".join(words)))
    frame = docs(spark, [(i, t, "s") for i, t in rows])
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in joins.jaccard_components(frame, 4, 85).collect())
    assert got == brute_components(rows, 4, 85)
    told = seen[0].groupBy("opens").count().collect()
    assert {x.opens: x["count"] for x in told}.get(False, 0) > 0


def test_shingles_fold_ascii_only():
    s = Shingler(2)
    assert (s.hashes("A b C") == s.hashes("a B\nc")).all()
    assert len(s.hashes("É x")) == 1 and s.hashes("É x")[0] != s.hashes("é x")[0]


def test_shingles_do_not_depend_on_pieces(monkeypatch):
    from sparkveil.llm import shingles

    text = "Ab cd\x0bEF\tgh  ij\n" * 50
    whole = Shingler(3).hashes(text)
    monkeypatch.setattr(shingles, "PIECE", 7)
    assert (Shingler(3).hashes(text) == whole).all()


def test_pointed_heads_are_connected(spark):
    from sparkveil.llm.components import pointed

    edges = [(k, k + 1) for k in range(9)] + [(50, k) for k in range(60, 90)]
    got = {x.node: x.head for x in pointed(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {k for e in edges for k in e} and all(got[k] == 50 for k in [50, *range(60, 90)])
    assert all(got[k] <= k and got[k] < 10 for k in range(10)) and got[4] == 0


def test_connected_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101), (101, 100)], "a long, b long")
    got = {x.node: x.component for x in connected(edges).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {100: 100, 101: 100}


def test_exact_dedup_reads_no_column_of_a_clashing_name(spark):
    rows = [(1, "a  b", 9, False, "x"), (0, "a b", 9, False, "x"), (2, None, 9, False, "x")]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, keep_id long, kept boolean, digest string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(0, 0, 2, True), (1, 0, 2, False), (2, 2, 1, True)]


def test_graphs_of_one_table_are_pointed_as_if_each_were_alone(spark):
    from sparkveil.llm.components import pointed

    edges = {True: [(1, 2), (2, 3), (5, 6), (7, 7)], False: [(1, 2), (2, 3), (3, 5), (5, 6), (6, 9)]}
    both = spark.createDataFrame([(k, a, b) for k in edges for a, b in edges[k]], "strict boolean, a long, b long")
    got = pointed(both, by=["strict"]).collect()
    for k in edges:
        alone = pointed(spark.createDataFrame(edges[k], "a long, b long")).collect()
        assert sorted((x.node, x.head) for x in got if x.strict == k) == sorted((x.node, x.head) for x in alone)


def test_near_duplicates_take_few_stages_and_tasks(spark):
    # the driver keeps a record of each: 190 stages and 239 tasks before, 150 and 197 since steps were joined
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 3}-{k}" for k in range(30 + i % 3))) for i in range(60)], "doc_id long, text string")
    spark.sparkContext.setJobGroup("near-tasks", "near")
    try:
        rows = joins.jaccard_components(docs, 5, 80).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("near-tasks") for s in tracker.getJobInfo(j).stageIds}
    ran = [x for x in map(tracker.getStageInfo, stages) if x is not None and x.numCompletedTasks]
    assert {x.doc_id: x.component_id for x in rows} == {i: i - i % 3 for i in range(60)}
    assert len(ran) < 170 and sum(x.numCompletedTasks for x in ran) < 220

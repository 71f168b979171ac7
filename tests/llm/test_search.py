import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkveil.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(docs, items, k):
    own = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        wanted, scores = set(TERM.findall((text or "").translate(LOWER))), []
        for i, c in own:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score long, item_id string").repartition(3),
        spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id long"),
    )


def corpus(seed):
    r = random.Random(seed)
    words = ["Ärger", "ärger", "x1", "THE", "the", "日本", "a_b", "ﬁ", "\x1c", "​", *(f"w{k}" for k in range(60))]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", "-", "\n", "'"]) for _ in range(n))
    docs = [(r.choice([None, r.randrange(90), k]), r.choice([None, "", " -- ", text(5), text(r.randrange(1, 60)), "the the the"])) for k in range(220)]
    items = [(k % 20, r.choice([None, "", text(3), text(25), "nothing here", "the"])) for k in range(25)]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_ranks_equal_brute_force(spark, monkeypatch, small):
    if small:  # several blocks of items, a few entries sorted at once
        for name, value in {"BLOCK_ITEMS": 7, "ENTRIES": 50, "SALTS": 3, "PIECE": 20}.items():
            monkeypatch.setattr(search, name, value)
    docs, items = corpus(3)
    got = search.rank(*tables(spark, docs, items), k=9)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(by_hand(docs, items, 9), key=key)


def test_empty_tables_and_items_without_terms(spark):
    docs, items = corpus(4)
    for d, i in (([], items), (docs, []), (docs, [(1, None), (2, "..")]), ([(1, None)], items)):
        assert search.rank(*tables(spark, d, i)).collect() == []


def test_long_texts_and_ties(spark):
    docs = [(9, "the cat"), (4, "the cat"), (None, "the cat"), (7, "dog " * 200_000 + "cat"), (4, "the cat")]
    got = [tuple(r)[1:3] for r in search.rank(*tables(spark, docs, [(1, "Cat")]), k=4).orderBy("rank").collect()]
    assert got == [(1, 4), (2, 4), (3, 9), (4, None)]


def test_radix_order_is_stable():
    keys = np.random.default_rng(1).integers(0, 1 << 30, 5000).astype(np.uint64) >> np.uint64(12)
    assert (search.radix_order(keys, 2) == np.argsort(keys, kind="stable")).all()

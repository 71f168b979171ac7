import hashlib
import random

import numpy as np
import pytest

from sparkveil.llm import suffixes

LAST = (1 << 63) - 1


def by_hand(rows, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each (doc_id, text)."""
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=False) if not g)).hexdigest()))
    return out


def corpus(seed: int):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß日") for _ in range(r.randrange(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = [prose(n) for n in (9, 12, 14, 30, 120)]
    rows = []
    for i in range(160):
        kind = i % 8
        if kind == 0:
            text = prose(60) + r.choice(passage) + prose(20)
        elif kind == 1:
            text = passage[3][:120] + r.choice("xyz") + passage[4]
        elif kind == 2 and i > 8:
            text = r.choice([t for _, t in rows if t] or ["x"])
        elif kind == 3:
            own = list(prose(80))
            own[r.randrange(len(own))] = "#"
            text = "".join(own) + passage[4]
        elif kind == 4:
            text = r.choice("ab") * r.randrange(40, 700)
        elif kind == 5:
            text = ("abc " * 200)[r.randrange(9) :]
        elif kind == 6:
            text = r.choice([None, "", "short", "x" * 49, "y" * 50, passage[1][:49]])
        else:
            text = prose(300) + passage[2] + prose(5) + passage[2]
        rows.append((r.choice([None, i, i, i, i % 50]), text))
    return rows


def answer(spark, rows, length, parts=3):
    docs = spark.createDataFrame([(k, *r, "clash", b"x") for k, r in enumerate(rows)], "row long, doc_id long, text string, ord string, digest binary")
    got = suffixes.drop_repeats(docs.repartition(parts), length).collect()
    return sorted((LAST if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got)


@pytest.mark.parametrize(("seed", "length", "small"), [(1, 50, False), (2, 50, True), (3, 31, True), (4, 10, False)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, seed, length, small):
    if small:  # many parts and groups, blocks of a few texts, most keys crowded
        for name, value in {"MOST": 30 if seed == 2 else 3, "FEW": 4, "BLOCK": 4000, "CHUNK": 900, "PART_KEYS": 300, "PART_PIECES": 100, "STEP": 2000, "RUN": 7}.items():
            monkeypatch.setattr(suffixes, name, value)
    rows = corpus(seed)
    assert answer(spark, rows, length) == sorted((LAST if i is None else i, *x) for (i, _), x in zip(rows, by_hand(rows, length), strict=True))


def test_the_bound_of_crowded_keys_rises_when_they_are_too_many(spark, monkeypatch):
    for name, value in {"MOST": 2, "CROWDED": 5, "PART_KEYS": 300}.items():
        monkeypatch.setattr(suffixes, name, value)
    rows = corpus(7)
    assert answer(spark, rows, 50) == sorted((LAST if i is None else i, *x) for (i, _), x in zip(rows, by_hand(rows, 50), strict=True))


def test_a_group_of_pieces_makes_no_row_for_each_of_its_texts(spark, monkeypatch):
    r = random.Random(3)
    passage = ["".join(r.choice("abcdefgh ") for _ in range(80)) for _ in range(30)]
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(30)).join(r.sample(passage, 12))) for i in range(60)]
    monkeypatch.setattr(suffixes, "PART_PIECES", 500)
    made, real = [], suffixes._spans

    def spans(dealt, length, groups, *more):
        out = real(dealt, length, groups, *more)
        made.append((groups, out.count()))
        return out

    monkeypatch.setattr(suffixes, "_spans", spans)
    assert answer(spark, rows, 50) == sorted((i, *x) for (i, _), x in zip(rows, by_hand(rows, 50), strict=True))
    groups, n = made[0]
    assert groups > 4
    assert n <= 2 * groups  # one bucket of texts


def test_a_long_text_and_its_parts(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefghij ") for _ in range(400_000))
    rows = [(5, long), (2, long[1000:90_000]), (9, "z" * 300_000), (7, "z" * 60), (1, None)]
    got = answer(spark, rows, 50)
    assert [g[:4] for g in got] == [(1, 0, 0, 0), (2, 89_000, 0, 0), (5, 400_000, 89_000, 1), (7, 60, 0, 0), (9, 300_000, 300_000, 1)]
    assert got[2][4] == hashlib.sha256((long[:1000] + long[90_000:]).encode()).hexdigest()


def test_empty_table_and_only_short_texts(spark):
    assert suffixes.drop_repeats(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    assert answer(spark, [(1, "a"), (2, "a")], 50, 1) == [(i, 1, 0, 0, hashlib.sha256(b"a").hexdigest()) for i in (1, 2)]


def test_suffix_arrays_are_sorted_and_whole():
    r = random.Random(2)
    for _ in range(150):
        texts, bounds = [], [0]
        for _ in range(r.randrange(1, 6)):
            texts.append(0)
            for _ in range(r.randrange(1, 5)):
                size = r.choice([2, 3, 4, 6])
                texts += [r.randrange(1, size) for _ in range(r.randrange(1, 25))] + [0]
            bounds.append(len(texts))
        got = suffixes.suffix_arrays(np.array(texts, np.int16), np.array(bounds))
        for a, b in zip(bounds, bounds[1:], strict=False):
            own = got[a:b].tolist()
            said = [texts[p : texts.index(0, p)] for p in own]
            assert sorted(own) == list(range(a, b))
            assert said == sorted(said)

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.operators import choices, media, percentiles, scoring

BOX = "struct<x:double,y:double,w:double,h:double>"


def overlap(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0.0


@pytest.mark.parametrize("large", [50_000, 120])
def test_suppression_in_rounds_equals_one_walk(spark, monkeypatch, large):
    monkeypatch.setattr(choices, "LARGE", large)
    r = random.Random(large)
    rows = [(r.choice([None, "a", "a", "a", "b"]), i, r.choice([0.75, 0.8, 0.9, r.random()]), (r.uniform(-200, 200), r.uniform(-200, 200), r.choice([20.0, r.uniform(0, 30)]), r.choice([20.0, r.uniform(0, 30)]))) for i in range(500)]
    got = sorted(x.ord for x in media.suppress(spark.createDataFrame(rows, f"frame string, ord long, score double, box {BOX}").repartition(3), least=0.3, threshold=0.4).collect())
    want, kept = [], {}
    for frame, i, score, box in sorted(rows, key=lambda x: (-x[2], x[1])):
        own = kept.setdefault(frame, [])
        if score >= 0.3 and all(overlap(box, k) <= 0.4 for k in own):
            own.append(box)
            want.append(i)
    assert got == sorted(want)


def test_a_frame_of_many_boxes(spark):
    n = 60_000  # above LARGE
    rows = spark.range(n).select(F.lit(1).alias("frame"), F.col("id").alias("ord"), F.rand(1).alias("score"), F.struct((F.rand(2) * 400).alias("x"), (F.rand(3) * 400).alias("y"), F.lit(20.0).alias("w"), F.lit(20.0).alias("h")).alias("box"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    kept = media.suppress(rows, least=0.0).collect()
    boxes = np.array([tuple(x.box) for x in kept])
    boxes = np.column_stack([boxes[:, :2], boxes[:, :2] + boxes[:, 2:]])
    over = choices._overlap(boxes, boxes)
    np.fill_diagonal(over, 0)
    assert over.max() <= 0.5  # none of the kept overlap, and each box is kept or overlaps a better kept one
    scores = np.array([x.score for x in kept])
    ids = {x.ord for x in kept}
    for r in random.Random(1).sample(rows.filter("score > 0").collect(), 300):
        b = np.array([[r.box.x, r.box.y, r.box.x + 20, r.box.y + 20]])
        assert r.ord in ids or ((choices._overlap(b, boxes)[0] > 0.5) & (scores >= r.score)).any()


@pytest.mark.parametrize("large", [50_000, 30])
def test_matches_in_rounds_equal_one_walk(spark, monkeypatch, large):
    monkeypatch.setattr(choices, "LARGE", large)
    r = random.Random(large)
    boxes = lambda n: [(r.choice([None, 1, 2]), i, r.choice("xy"), (float(r.randrange(60)), float(r.randrange(60)), 30.0, 30.0)) for i in range(n)]
    truth, said = boxes(60), boxes(60)
    frames = [spark.createDataFrame(b, f"capture_id long, {c} long, cls string, box {BOX}").repartition(3) for b, c in ((truth, "g"), (said, "p"))]
    got = sorted((x.capture_id, x.g, x.p) for x in scoring.match(*frames, least=0.2).collect())
    pairs = sorted((-overlap(a, b), g, p, k) for k, g, c, a in truth if k for m, p, d, b in said if k == m and c == d and overlap(a, b) >= 0.2)
    want, used = [], set()
    for _, g, p, k in pairs:
        if not {(k, "g", g), (k, "p", p)} & used:
            used |= {(k, "g", g), (k, "p", p)}
            want.append((k, g, p))
    assert got == sorted(want)


@pytest.mark.parametrize("small", [None, 20, 1])
def test_percentiles_of_hot_and_odd_groups(spark, small):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", None, "b"]), r.choice([None, float("nan"), 1.0, 1.0, -0.0, r.uniform(-5, 5), r.gauss(0, 1e6), float("inf"), float("-inf")])) for _ in range(900)] + [("empty", None), ("one", 4.0)]
    got = {x.grp: (x.p1, x.p50, x.p95, x.p100, x.n) for x in percentiles.nearest_ranks(spark.createDataFrame(rows, "grp string, v double"), ["grp"], "v", {"p1": 1, "p50": 50, "p95": 95, "p100": 100}, small).collect()}
    for grp in {g for g, _ in rows}:
        own = sorted(v for g, v in rows if g == grp and v is not None and not math.isnan(v))
        at = lambda p: own[max(math.ceil(p * len(own) / 100), 1) - 1] if own else None
        assert got[grp] == (at(1), at(50), at(95), at(100), len(own))

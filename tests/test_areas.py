import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.operators import areas

BOX = "struct<x:double,y:double,w:double,h:double>"


def pixels(boxes, side=200):
    page = np.zeros((side, side), bool)
    for x, y, w, h in boxes:
        page[int(y) : int(y + h), int(x) : int(x + w)] = True
    return float(page.sum())


def some(r, n, side=60):
    return [(float(r.randrange(side)), float(r.randrange(side)), float(r.randrange(0, 25)), float(r.randrange(0, 25))) for _ in range(n)]


@pytest.mark.parametrize(("tree", "large", "strips"), [(256, 4096, 64), (3, 4096, 64), (3, 20, 5)])
def test_areas_equal_pixels(spark, monkeypatch, tree, large, strips):
    for name, value in {"TREE": tree, "LARGE": large, "STRIPS": strips}.items():
        monkeypatch.setattr(areas, name, value)
    r = random.Random(tree)
    pages = {(r.choice([None, "a", "b"]), i): some(r, r.choice([1, 2, 5, 30, 90])) for i in range(60)}
    rows = [(k, i, b) for (k, i), boxes in pages.items() for b in boxes]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, f"kind string, page long, box {BOX}").repartition(3)
    got = {(x.kind, x.page): x.area for x in areas.union_areas(frame, ["kind", "page"]).collect()}
    assert got == {k: pixels(b) for k, b in pages.items()}


def test_odd_boxes_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, (0.0, 0.0, -5.0, 3.0)), (1, None), (2, (1.5, 1.0, 2.0, 0.5)), (2, (1.5, 1.0, 2.0, 0.5)), (3, (0.0, float("nan"), 1.0, 1.0))], f"page long, box {BOX}")
    assert {r.page: r.area for r in areas.union_areas(frame, ["page"]).collect()} == {1: 0.0, 2: 1.0, 3: 0.0}
    assert areas.union_areas(frame.limit(0), ["page"]).count() == 0


def test_a_page_of_many_boxes_takes_seconds(spark):
    n = 20_000
    frame = spark.range(n).select(F.lit(1).alias("page"), F.struct((F.rand(1) * 1000).alias("x"), (F.rand(2) * 1000).alias("y"), (F.rand(3) * 12).alias("w"), (F.rand(4) * 12).alias("h")).alias("box"))
    began = time.time()
    (row,) = areas.union_areas(frame, ["page"]).collect()
    assert time.time() - began < 60
    boxes = [r.box for r in frame.collect()]
    points = np.random.default_rng(5).uniform(0, 1012, (20_000, 2))
    low, high = np.array([(b.x, b.y) for b in boxes]), np.array([(b.x + b.w, b.y + b.h) for b in boxes])
    inside = np.zeros(len(points), bool)
    for a in range(0, n, 1000):
        inside |= ((points[:, None] >= low[a : a + 1000]) & (points[:, None] < high[a : a + 1000])).all(axis=2).any(axis=1)
    assert abs(row.area / 1012**2 - inside.mean()) < 0.015

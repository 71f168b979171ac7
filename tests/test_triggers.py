import random

from pyspark.sql import functions as F

from sparkveil.operators import recognizers


def test_triggers_hide_no_match(spark, monkeypatch):
    r = random.Random(8)
    parts = ["ABCPE1234F", "abcpe 1234 f", "27AAPFU0939F1ZV", "SBIN0001234", "a.b@mail.example.com", "user@okicici", "+91 98765 43210", "9876543210", "110001", "KA 01 AB 1234", "22 BH 1234 AA", "ka01ab1234", "01/02/1990", "1990-2-3", "₹ 1,200", "Rs.500", "INR 7", "dob", "pan", "x", "4111 1111 1111 1111", "BH", "@", "-", "0", "2019."]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "\n", "_", ","]) for _ in range(r.randrange(1, 5))) for _ in range(1500)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, told string")
    said = lambda: {x.i: x.s for x in frame.select("i", recognizers.Registry().analyze("told", 0.1).alias("s")).collect()}
    some = frame.filter(recognizers.may_have(frame["told"], "EMAIL", "CARD_NUMBER"))
    kept = {x.i for x in some.collect()}
    with_triggers = said()
    monkeypatch.setattr(recognizers, "_TRIGGERS", {})
    assert said() == with_triggers
    assert sum(map(len, with_triggers.values())) > 1000
    assert all(i in kept for i, spans in with_triggers.items() if any(s.cls in ("EMAIL", "CARD_NUMBER") for s in spans))


def test_harmless_texts_run_no_recognizer(spark):
    texts = ['{"packet_id":"packet-000000045352","elements":[{"id":"e2","confidence":0.97}]}', "order 000012345678, 0.97 of 12,345", "-" * 400 + " 12 at 5 @ 7"]
    risky = ["card 4111 1111 1111 1111", "dob 01/02/1990", "0 9 8 7 6 5 4 3 2 1 0 9 8 7", "Rs. 5", "22 BH 1234 AA", "5.1.2019"]
    calls = [t for n, t in recognizers._TRIGGERS.items() if n not in ("pincode", "bank-account")]
    any_of = lambda x: sum(map(int, spark.createDataFrame([(x,)], "t string").selectExpr(*[f"cast(t rlike r'{t}' as int) as c{i}" for i, t in enumerate(calls)]).head()))
    assert [any_of(t) for t in texts] == [0, 0, 0] and all(any_of(t) for t in risky if not t.startswith("0 9"))


def test_a_threshold_leaves_out_only_what_can_not_reach_it(spark):
    text = "dob 01/02/1990, pin 110001, account 12345678901, Rs. 5, mobile 9876543210, a.b@mail.example.com 4111 1111 1111 1111 1 2"
    rows = spark.createDataFrame([(text,)], "t string")
    for threshold in (0.3, 0.75, 0.8, 0.9):
        got = rows.select(recognizers.Registry().analyze("t", threshold).alias("s"), recognizers.resolve_overlaps(F.filter(recognizers.Registry().candidates(F.col("t")), lambda s: s["confidence"] >= threshold)).alias("w")).head()
        assert got.s == got.w


def test_spans_are_exploded_without_a_second_run(spark):
    rows = recognizers.detect(spark.createDataFrame([("a.b@mail.example.com",), ("none",), (None,)], "text string").repartition(3))
    got = recognizers.each_span(rows, "text")
    assert [r.s.cls for r in got.collect()] == ["EMAIL"]
    below = got._jdf.queryExecution().optimizedPlan().toString().split("Generate explode", 1)[1]
    assert "Filter " not in below

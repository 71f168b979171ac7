"""Steps whose work for each row was cut: they find what they found before."""

import json
import random
import re

from pyspark.sql import functions as F

from sparkveil.operators import gate, planner, prompts, recognizers, vault, wire
from sparkveil.sources.durable import durable_columns


def _packets(spark, r, ids):
    kinds = ["placeholder", "redacted", "filled", "empty", None]
    value = lambda: {"kind": r.choice(kinds), "token": r.choice(["PII:EMAIL#1", "PII:PAN#1", None])}
    element = lambda: {"id": r.choice(["e1", "e2", "e3", None]), "role": r.choice(["textbox", "combobox", "button"]), "state": {"invalid": r.choice([True, False, None]), "disabled": r.random() < 0.2, "filled": r.random() < 0.3}, "value": value(), "risk": r.choice([None, "navigation"])}
    rows = [(i, json.dumps([element() for _ in range(r.randrange(5))]), 1) for i in ids]
    read = spark.createDataFrame(rows, "packet_id string, e string, session int")
    return read.select("packet_id", F.from_json("e", f"array<{gate.ELEMENT}>").alias("elements"), "session")


def test_problems_within_a_row_are_those_of_the_guard(spark):
    r = random.Random(5)
    packets = _packets(spark, r, [f"packet-{i:06d}" for i in range(150)])
    step = lambda: {"action": r.choice(["type", "click", "select", "clear"]), "target": r.choice(["e1", "e2", "e9", None]), "value_kind": r.choice(["user_prompt", "placeholder", None]), "token": r.choice(["PII:EMAIL#1", "PII:PAN#1", None]), "requires_confirmation": r.random() < 0.5}
    plans = spark.createDataFrame([(i, f"packet-{i % 160:06d}", json.dumps([step() for _ in range(r.randrange(5))])) for i in range(400)], "plan_id int, packet_id string, s string")
    plans = plans.select("plan_id", "packet_id", F.col("packet_id").alias("answers"), F.from_json("s", f"array<{planner.STEP}>").alias("steps"))
    found = sorted((x.plan_id, x.step, x.problem) for x in planner.guard(plans, packets).collect())
    within = plans.join(packets, "packet_id", "left").select("plan_id", planner.problems_within(F.col("steps"), F.col("elements")).alias("p")).collect()
    assert found == sorted((x.plan_id, k, code) for x in within for k, codes in enumerate(x.p) for code in codes)
    assert len(found) > 500


def test_answers_about_one_packet_explode_no_elements(spark, monkeypatch):
    r = random.Random(6)
    packets = _packets(spark, r, ["packet-000001", "packet-000002", "packet-000002"])
    raw = lambda k: json.dumps({"schema": "plan/1.0", "packet_id": f"packet-{k:06d}", "reasoning_summary": "go", "steps": [{"action": "click", "target_element_id": "e77", "requires_confirmation": False}], "needs_more_context": False, "confidence": 0.5})
    answers = spark.createDataFrame([(k, f"packet-{k:06d}", raw(k)) for k in (1, 2, 3)], "plan_id int, packet_id string, raw string")
    said = {x.plan_id: (x.reasons, x.n_problems) for x in wire.guard_answers(answers, packets).collect()}
    assert said == {1: (["guard"], 1), 2: (["guard"], 1), 3: (["guard"], 1)}
    monkeypatch.setattr(planner, "guard", lambda *a: 1 / 0)
    assert wire.guard_answers(answers.filter("plan_id <> 2"), packets).count() == 2


def test_texts_that_are_left_where_they_are_read_have_no_spans(spark):
    r = random.Random(9)
    parts = ["ABCPE1234F", "27AAPFU0939F1ZV", "SBIN0ABCDEF", "a.b@mail.example.com", "user@okicici", "98765 43210", "110001", "KA 1 A 1234", "22BH1234AA", "5/1/2019", "₹5", "Rs. 7", "INR 9", "4‑1111111111111111", "2 3 4 1 2 3 4 1 2 3 4 6", "x1", "e1", "scp/1.0", "T0", "1 of", "0", "word"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "-", ","]) for _ in range(r.randrange(1, 3))) for _ in range(1200)]
    rough = re.compile(recognizers.STANDARD.rough)
    found = spark.createDataFrame([(t,) for t in texts], "said string").select("said", F.size(recognizers.Registry().analyze("said", 0.1)).alias("n")).collect()
    assert all(rough.search(x.said) for x in found if x.n) and sum(x.n > 0 for x in found) > 300
    assert not any(rough.search(t) for t in ("scp/1.0", "T0", "e1", "PII:EMAIL#1", "1 of many"))


def test_deep_json_is_walked_without_recursion(spark):
    deep = '{"a":[' * 700 + '"mail a.b@mail.example.com"' + "]}" * 700
    rows = spark.createDataFrame([(1, deep), (2, '{"x":["p@mail.example.com",{"y":"q@mail.example.com"}],"z":1}'), (3, "no json"), (4, None)], "request_id int, raw string")
    got = [(x.request_id, x.path[-7:], x.cls) for x in wire.rescan_json(rows).collect()]
    assert sorted(got) == [(1, "0].a[0]", "EMAIL"), (2, ".x[1].y", "EMAIL"), (2, "et.x[0]", "EMAIL")]


def test_a_scan_hands_on_only_what_is_kept(spark):
    payloads = spark.createDataFrame([(1, 10, "a secret-value here"), (1, 11, "none")], "session int, i int, payload string")
    held = spark.createDataFrame([(1, None, None, "secret-value")], "session int, cls string, token string, value string")
    got = vault.scan(payloads, held, kept=["i"])
    assert got.columns == ["i", "cls", "token"] and [x.i for x in got.collect()] == [10]


def test_columns_of_any_type_are_kept(spark):
    rows = spark.range(5).select("id", F.lit(None).alias("nothing"), F.create_map(F.lit("a"), F.struct("id")).alias("m"))
    assert durable_columns(rows).orderBy("id").collect() == rows.orderBy("id").collect()
    kept = durable_columns(rows.drop("nothing"))
    assert kept.orderBy("id").collect() == rows.drop("nothing").orderBy("id").collect()
    assert "parquet" in kept.select("id")._jdf.queryExecution().executedPlan().toString()


def test_names_of_a_form_are_compiled_once():
    prompts._named.cache_clear()
    fields = [{"id": "f1", "label": "Email address", "cls": "EMAIL"}, {"id": "f2", "label": "PIN code", "cls": "PIN_CODE"}]
    for i in range(20):
        got = prompts.explicit_answers(f"My EMAIL is c{i}@mail.example.com, pin code is 110001", fields, [])
        assert [(a["field_id"], a["value"]) for a in got] == [("f1", f"c{i}@mail.example.com"), ("f2", "110001")]
    assert prompts._named.cache_info().misses == 2

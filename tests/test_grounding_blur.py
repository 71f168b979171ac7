from sparkveil.operators import blur, grounding

BOX = "struct<x:double,y:double,w:double,h:double>"


def test_reground(spark):
    box = (0.0, 0.0, 100.0, 20.0)
    target = lambda i, **k: ("p", i, k.get("role", "button"), k.get("label", "Save"), k.get("box", box), k.get("disabled"), None)
    targets = spark.createDataFrame([target("a"), target("b"), target("c"), target("d"), target("e"), target("f", disabled=True), target("g"), target("h", label="Inbox")], f"page_id string, id string, role string, label string, box {BOX}, disabled boolean, readonly boolean")
    now = lambda i, **k: ("p", i, k.get("role", "button"), k.get("label", "Save"), k.get("box", box), k.get("visible", True), k.get("disabled", False), False)
    current = spark.createDataFrame([now("a"), now("c", role="link"), now("d", box=(30.0, 40.0, 100.0, 20.0)), now("e", visible=False), now("f"), now("g", label="Other"), now("h", label="Inbox (3)")], f"page_id string, id string, role string, label string, box {BOX}, visible boolean, disabled boolean, readonly boolean")
    got = {r.id: r.problem for r in grounding.reground(targets, current).collect()}
    assert got == {
        "a": None, "b": "element no longer in the document", "c": "element role changed since capture", "d": "element moved 50px since capture", "e": "element is no longer visible",
        "f": "element disabled state changed since capture", "g": "element label changed since capture", "h": None,
    }


def test_lost_answers_and_uploads(spark):
    entered = spark.createDataFrame([("p", 1, "e1", "Name", 0, 1), ("p", 2, "e2", "Name", 1, 1)], "page_id string, seq int, id string, label string, ordinal int, attempts int")
    current = spark.createDataFrame([("p", 1, "e1", "Name *", True, False, False, False), ("p", 2, "e9", "Name", None, None, None, None)], "page_id string, pos int, id string, label string, filled boolean, invalid boolean, disabled boolean, readonly boolean")
    assert [(r.field, r.region) for r in grounding.lost_answers(entered, current).collect()] == [("e2", "e9")]
    reviewed = spark.createDataFrame([("p", "f1", "Photo"), ("p", "f2", "Proof"), ("p", "f3", "Twice")], "page_id string, id string, label string")
    fields = spark.createDataFrame([("p", "f1", "Photo", "file"), ("p", "f7", "Proof", "file"), ("p", "f8", "Twice", "file"), ("p", "f9", "Twice", "file")], "page_id string, id string, label string, input_type string")
    assert {r.id: r.found for r in grounding.upload_targets(reviewed, fields).collect()} == {"f1": "f1", "f2": "f7", "f3": None}


def test_network_calls(spark):
    files = spark.createDataFrame([("a.ts", "let x;\n// fetch(1)\n/* new WebSocket */ fetch (2)"), ("b.ts", "fetch(1)"), ("c.test.ts", "fetch(1)"), ("d.ts", "prefetch(1)")], "path string, content string")
    got = grounding.network_calls(files, spark.createDataFrame([("b.ts",)], "path string")).collect()
    assert [(r.path, r.line) for r in got] == [("a.ts", 3)]


def test_blur_is_no_redaction(spark):
    secrets = spark.createDataFrame([(1, "4111111111111111", 6.0), (2, "9876543210123456", 6.0), (3, "9876543210123456", 0.0)], "id long, digits string, sigma double")
    got = {r.id: r for r in blur.attack(secrets).collect()}
    assert got[1].accuracy == 1.0 and got[2].accuracy == 1.0
    assert got[3].accuracy <= 0.3


def test_blur_is_read_in_stacks_over_many_tasks(spark):
    digits = [f"{k * 7919 % 10**8:08d}" for k in range(40)] + ["42", ""]
    secrets = spark.createDataFrame([(k, d, 14.0 if k % 2 else 0.0) for k, d in enumerate(digits)], "id long, digits string, sigma double").coalesce(1)
    got = blur.attack(secrets)
    assert got.rdd.getNumPartitions() > 1
    found = {r.id: r.recovered for r in got.collect()}
    assert all(found[k] == d if k % 2 else len(set(found[k])) == 1 and len(found[k]) == len(d) for k, d in enumerate(digits) if d)
    assert found[41] == "" and len(found) == 42

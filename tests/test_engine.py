import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.functions import checksums, geometry, scalars, taxonomy, validators
from sparkveil.operators import fusion, gate, media, perception, planner, policy, prompts, recognizers, scoring, vault
from sparkveil.streaming import stateful


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_checksums(spark):
    assert column(spark, ["2363", "999941057058", "784512369014", "x", ""], checksums.verhoeff_valid) == [True, True, False, False, False]
    assert column(spark, ["236", "99994105705"], checksums.verhoeff_digit) == [3, 8]
    assert column(spark, ["4111111111111111", "4111111111111112", "0"], checksums.luhn_valid) == [True, False, True]
    assert column(spark, ["27AAPFU0939F1Z"], checksums.gstin_check_char) == ["V"]


@pytest.mark.parametrize(
    "cls,good,bad",
    [
        ("AADHAAR", ["9999 4105 7058", "999941057058", "5209-8716-3499"], ["7845 1236 9014", "1999 4105 7058"]),
        ("CARD_NUMBER", ["4111 1111 1111 1111", "5555 5555 5555 4444", "4539-1488-0343-6467"], ["4111 1111 1111 1112", "1111 1111 1111 1117"]),
        ("PAN", ["ABCPE1234F", "ABCPE 1234 F", "aabcu9603r"], ["ABCXE1234F", "ABCPE123F"]),
        ("GSTIN", ["27AAPFU0939F1ZV", "27aapfu0939f1zv"], ["27AAPFU0939F1ZX", "39AAPFU0939F1ZV"]),
        ("IFSC", ["SBIN0005943", "sbin0005943"], ["SBIN1005943"]),
        ("PHONE_IN", ["+91 98765 43210", "09876543210", "98765-43210"], ["1800-000-000", "5876543210"]),
        ("PIN_CODE", ["380015"], ["980015", "38001"]),
        ("VEHICLE_REG", ["GJ 01 AB 1234", "22BH1234AB"], ["ZZ 01 AB 1234"]),
        ("EMAIL", ["Ramesh@gmail.com"], ["ramesh@okicici", "a" * 260 + "@b.co"]),
        ("UPI_VPA", ["ramesh@okicici", "x1@nobank"], ["r@okicici", "ramesh@"]),
        ("BANK_ACCOUNT", ["123456789012"], ["12345678"]),
    ],
)
def test_validators(spark, cls, good, bad):
    got = column(spark, good + bad, validators.VALIDATORS[cls])
    assert [g.valid for g in got] == [True] * len(good) + [False] * len(bad)
    assert all((g.normalized is None) != g.valid for g in got)


def test_spans_context_and_overlaps(spark):
    texts = ["PIN code: 380015", "Batch 380015", "A/C 123456789012", "Tracking 123456789012", "DOB: 12/05/1994", "Valid from 12/05/2020", "5 2 0 9 8 7 1 6 3 4 9 9", "7 8 4 5 1 2 3 6 9 0 1 4", "😀 ₹48,230.11 balance", None, "x 4111 1111 1111 1111, a.b@c.de"]
    got = column(spark, texts, recognizers.Registry().analyze)
    assert [[s.cls for s in spans] for spans in got] == [["PIN_CODE"], [], ["BANK_ACCOUNT"], [], ["DOB"], [], ["AADHAAR"], [], ["AMOUNT"], [], ["CARD_NUMBER", "EMAIL"]]
    amount = got[8][0]
    assert (amount.start, amount.end, round(amount.confidence, 9)) == (2, 12, 0.95)
    assert texts[10][got[10][1].start : got[10][1].end] == "a.b@c.de"
    loose = column(spark, ["Batch 380015", "on 12/05/2020"], lambda c: recognizers.Registry().analyze(c, 0.3))
    assert [[s.cls for s in x] for x in loose] == [["PIN_CODE"], ["DOB"]]


def test_registry_takes_more_recognizers(spark):
    more = recognizers.Registry().register(recognizers.Recognizer("code", "API_KEY", "key-[a-z]+", None, 0.9))
    got = column(spark, ["my key-abc"], more.analyze)
    assert [(s.cls, s.text) for s in got[0]] == [("API_KEY", "key-abc")]


def test_scalars(spark):
    assert column(spark, ["₹48,230.11", "Rs. 2,000", "zero", "0"], scalars.magnitude_bucket) == ["1e4_to_1e5", "1e-1_to_1e0", None, None]
    assert column(spark, ["max 5 MB", "up to 100 kb", None, "max 900 MB"], scalars.file_limit) == [5 * 1024 * 1024, 100 * 1024, 20 * 1024 * 1024, 20 * 1024 * 1024]
    assert column(spark, ["PII:EMAIL#3", "PII:X#1", "PII:PAN#?"], taxonomy.token_class) == ["EMAIL", None, None]
    assert column(spark, ["image/*,.pdf", "", "text/plain"], lambda a: scalars.file_accepted(F.lit("a.PDF"), F.lit("application/pdf"), a)) == [True, True, False]
    assert column(spark, [[4.0, 1.0, 3.0, 2.0]], lambda v: scalars.nearest_rank(v, 50), "array<double>") == [2.0]


def b(*xywh):
    return geometry.box(*[F.lit(float(v)) for v in xywh])


def test_geometry(spark):
    one = spark.range(1).select(
        geometry.iou(b(0, 0, 10, 10), b(5, 0, 10, 10)), geometry.iou(b(0, 0, 1, 1), b(5, 5, 1, 1)),
        geometry.clip(b(-5, 0, 10, 10), F.lit(100), F.lit(100)), geometry.clip(b(200, 0, 10, 10), F.lit(100), F.lit(100)), geometry.dilation(b(0, 0, 5, 30)),
    ).head()
    assert abs(one[0] - 1 / 3) < 1e-12 and one[1] == 0
    assert one[2].partial and one[2].box.w == 5 and one[3] is None and one[4] == 5


def test_vault_order_cap_and_leaks(spark):
    rows = [("s", "PAN", "p1", 1), ("s", "EMAIL", "a\"b.com", 2), ("s", "PAN", "p1", 3), ("s", "PAN", "p2", 4), ("s", "EMAIL", "late", 5), ("t", "PAN", "p2", 1)]
    v = vault.mint(spark.createDataFrame(rows, "session string, cls string, value string, seq int"), cap=3)
    got = {(r.session, r.cls, r.value): r.token for r in v.collect()}
    assert got == {("s", "PAN", "p1"): "PII:PAN#1", ("s", "EMAIL", 'a"b.com'): "PII:EMAIL#1", ("s", "PAN", "p2"): "PII:PAN#2", ("s", "EMAIL", "late"): "PII:EMAIL#?", ("t", "PAN", "p2"): "PII:PAN#1"}
    payloads = spark.createDataFrame([("s", 'x a\\"b.com'), ("t", "p2 late"), ("s", "p1 is short")], "session string, payload string")
    assert [r.token for r in vault.leaks(payloads, v).collect()] == ["PII:EMAIL#1"]


def ttl_fold(rows, ttl, cap):
    live, n, out = {}, {}, {}
    for cls, value, at, seq in sorted(rows, key=lambda x: (x[2], x[3])):
        live = {k: x for k, x in live.items() if x[0] >= at - ttl}
        if (cls, value) not in live:
            if len(live) >= cap:
                out[seq] = f"PII:{cls}#?"
                continue
            n[cls] = n.get(cls, 0) + 1
            live[cls, value] = (at, f"PII:{cls}#{n[cls]}")
        out[seq] = live[cls, value][1]
    return out


def test_vault_expiry(spark):
    r = random.Random(2)
    rows = [(r.choice(["PAN", "EMAIL"]), f"v{r.randrange(5)}", r.randrange(0, 100), k) for k in range(200)]
    frame = spark.createDataFrame([(1, *x) for x in rows], "session long, cls string, value string, at long, seq long")
    got = {x.seq: x.token for x in vault.mint_with_ttl(frame, ttl_ms=10, cap=4).collect()}
    assert got == ttl_fold(rows, 10, 4)


def limit_fold(times, most, window):
    live, out = [], []
    for t in times:
        live = [x for x in live if x > t - window]
        out.append(len(live) < most)
        if out[-1]:
            live.append(t)
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    r = random.Random(3)
    times = sorted(r.randrange(0, 5000) for _ in range(120))
    frame = spark.createDataFrame([("u", t, k) for k, t in enumerate(times)], "session string, sent_at_ms long, seq long")
    got = [x.allowed for x in gate.rate_limit(frame, most=3, window_ms=200).orderBy("seq").collect()]
    assert got == limit_fold(times, 3, 200)
    events = spark.createDataFrame([(1, k, t) for k, t in enumerate(times)], "user_id long, event_id long, t long").select("user_id", "event_id", F.timestamp_millis("t").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    again = stateful.run_once(stateful.rate_limit(stream, 3, 200), str(tmp_path / "run"))
    assert [x.allowed for x in again.orderBy("event_id").collect()] == got


def test_stream_snapshots_and_frames(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 10), (1, 3, 20), (1, 2, 30), (1, 3, 40)], "tab long, version long, t long").select("tab", "version", F.timestamp_millis("t").alias("ts"))
    rows.write.parquet(str(tmp_path / "a"))
    got = stateful.run_once(stateful.fresh_snapshots(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "a"))), str(tmp_path / "ra")).collect()
    assert sorted((x.version, x.stale) for x in got) == [(1, False), (2, True), (3, False), (3, False)]
    frames = spark.createDataFrame([(1, 1, [1, 2], 5), (1, 2, [1, 3], 9)], "stream long, frame long, hashes array<bigint>, t long").withColumn("ts", F.timestamp_millis("t"))
    frames.write.parquet(str(tmp_path / "b"))
    got = stateful.run_once(stateful.frame_diffs(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "b"))), str(tmp_path / "rb")).collect()
    assert sorted((x.frame, x.n_changed) for x in got) == [(1, 2), (2, 1)]


def region(pos, role="text", text=None, value=None, label=None, x=0.0, y=0.0, source="dom", explained=True, structural=None, visual=None):
    return ("p", pos, f"e{pos}", role, label, (x, y, 100.0, 20.0), source, 0.97, ["structural:role"], explained, value, text, structural, visual, None, None)


def test_sanitize(spark):
    rows = [
        region(1, text="9999 4105", y=0.0), region(2, text="7058", x=110.0, y=2.0), region(3, "textbox", value="ABCPE1234F", label="PAN", y=50.0, structural="PAN"),
        region(4, "textbox", value="380015", label="PIN code", y=80.0), region(5, "textbox", value="hello", label="Note", y=110.0), region(6, "textbox", y=140.0), region(7, "image", source="vision", explained=False, y=170.0),
        region(8, "image", y=200.0, visual="FACE"), region(9, text="mail a.b@c.de or 4111 1111 1111 1111", y=230.0),
    ]
    frame = spark.createDataFrame(rows, policy.REGION)
    intents = spark.createDataFrame([("p", "send to a.b@c.de")], "page_id string, intent string")
    out = policy.sanitize(frame, "shield", intents)
    got = {r.pos: r for r in out["elements"].collect()}
    assert [got[k].branch for k in range(1, 10)] == ["cross", "cross", "structural", "filled", "filled", "empty", "masked", "visual", "none"]
    assert got[1].value.token == got[2].value.token == "PII:AADHAAR#1" and got[3].value.token == "PII:PAN#1" and got[3].value.length_bucket == "8_to_16"
    assert [r.text for r in out["untrusted_text"].collect()] == ["mail PII:EMAIL#1 or PII:CARD_NUMBER#1"]
    assert out["intents"].head().intent == "send to PII:EMAIL#1"
    legend = {r.legend_key: r.recoverable for r in out["legend"].collect()}
    assert legend == {"PII:AADHAAR": True, "PII:PAN": True, "PII:FACE": False, "PII:EMAIL": False, "PII:CARD_NUMBER": False}
    strict = {r.pos: r for r in policy.sanitize(frame, "fortress")["elements"].collect()}
    assert strict[4].value.token == "PII:PIN_CODE#1" and strict[5].value.kind == "redacted"
    summary = out["summary"].head()
    assert summary.regions_redacted == 5 and summary.unexplained_masked == 1


def test_different_lines_do_not_join(spark):
    frame = spark.createDataFrame([region(1, text="9999 4105", y=0.0), region(2, text="7058", x=110.0, y=90.0)], policy.REGION)
    assert policy.cross_region(frame, "shield").count() == 0


def test_greedy_and_scores(spark):
    box = lambda x: (float(x), 0.0, 10.0, 10.0)
    truth = spark.createDataFrame([("c", 1, "EMAIL", "high", True, box(0)), ("c", 2, "EMAIL", "high", True, box(100)), ("c", 3, "PAN", "invariant", True, box(200)), ("c", 4, "PAN", "invariant", False, box(300))], "capture_id string, g int, cls string, severity string, must_redact boolean, box struct<x:double,y:double,w:double,h:double>")
    predicted = spark.createDataFrame([("c", 1, "EMAIL", box(1)), ("c", 2, "EMAIL", box(0)), ("c", 3, "PAN", box(201)), ("c", 4, "EMAIL", box(301))], "capture_id string, p int, cls string, box struct<x:double,y:double,w:double,h:double>")
    matched = scoring.match(truth.filter("must_redact"), predicted)
    assert sorted((r.g, r.p) for r in matched.collect()) == [(1, 2), (3, 3)]
    s = scoring.score_all(truth, predicted, matched).head()
    assert (s.tp, s.fp, s.fn, s.false_alarms) == (2, 2, 1, 1) and abs(s.leak_rate - 1 / 3) < 1e-12 and abs(s.f1 - 4 / 7) < 1e-12
    assert [r.g for r in scoring.leaks(truth, matched).collect()] == [2]


def test_fusion(spark):
    dom = spark.createDataFrame([("p", 1, "a", "button", (0.0, 0.0, 10.0, 10.0), True), ("p", 2, "b", "text", (50.0, 0.0, 10.0, 10.0), True), ("p", 3, "c", "text", (90.0, 0.0, 5.0, 5.0), False)], "page_id string, pos int, id string, role string, css_box struct<x:double,y:double,w:double,h:double>, visible boolean")
    space = spark.createDataFrame([("p", 2.0, 0.5, 100, 100)], "page_id string, dpr double, scale double, image_w int, image_h int")
    seen = spark.createDataFrame([("p", 1, (1.0, 0.0, 10.0, 10.0), "control", 0.9), ("p", 2, (55.0, 0.0, 10.0, 10.0), "text", 0.9), ("p", 3, (55.0, 0.0, 10.0, 10.0), "media", 0.9)], "page_id string, idx int, box struct<x:double,y:double,w:double,h:double>, kind string, score double")
    got = fusion.fuse(dom, seen, space)
    assert [(r.idx, r.via, r.dom_id) for r in got.orderBy("idx").collect()] == [(1, "iou", "a"), (2, "iou+centroid", "b"), (3, None, None)]
    assert fusion.structure_only(dom, space, got).count() == 0
    assert abs(fusion.explained_fraction(got, space).head().unexplained_fraction - 0.01) < 1e-12


def element(i, role="textbox", label=None, kind="empty", token=None, text=None, risk=None, **state):
    s = tuple(state.get(k) for k in ("filled", "disabled", "focused", "required", "checked", "expanded", "invalid", "readonly", "partially_visible"))
    return (f"e{i}", role, label, s, (kind, text, token, None, None, None, None, None), ["structural:role"], 0.97, "dom", risk)


def packet(elements, pid="packet-0001", mode="shield", visual=(False, None, None, None), legend=None, intent="fill", session=1, at=1):
    return (pid, 1, mode, "form", visual, elements, legend or {}, intent, [], session, at)


def packets(spark, *rows):
    return spark.createDataFrame(list(rows), gate.PACKET + ", session long, sent_at_ms long")


def test_gate(spark):
    import hashlib

    ok = packet([element(1)], "packet-000a")
    leak = packet([element(1)], "packet-000b", intent="write to a.b@mail.example.com")
    gap = packet([element(1, kind="placeholder", token="PII:PAN#1")], "packet-000c")
    wire = packet([element(1)], "packet-000d", "wireframe", (True, "image/png", "0" * 64, "QQ=="))
    image = packet([element(1)], "packet-000e", visual=(True, "image/png", hashlib.sha256(b"QQ==").hexdigest(), "QQ=="))
    broken = packet([element(1)], "packet-000f", visual=(True, "image/png", "0" * 64, "QQ=="))
    known = packet([element(1, text="secret1", kind="filled"), element(2)], "packet-000g", mode="fortress")
    v = spark.createDataFrame([(1, "USERNAME", "secret1", "PII:USERNAME#1", False)], "session long, cls string, value string, token string, overflow boolean")
    got = {r.packet_id[-1]: r.reasons for r in gate.gate(packets(spark, ok, leak, gap, wire, image, broken, known), v).collect()}
    assert got == {"a": [], "b": ["tripwire"], "c": ["schema"], "d": ["schema"], "e": [], "f": ["visual"], "g": ["vault"]}


def test_outcomes_and_audit(spark):
    rows = [packet([element(1)], f"packet-{k:04d}", at=k) for k in range(5)] + [packet([element(1)], "packet-bad", mode="x", at=9)]
    decided = gate.outcomes(gate.gate(packets(spark, *rows)), most=3, window_ms=1000)
    got = {r.packet_id: (r.outcome, r.reasons) for r in decided.collect()}
    assert [got[f"packet-{k:04d}"][0] for k in range(5)] == ["sent"] * 3 + ["blocked"] * 2
    assert got["packet-0004"][1] == ["rate_limit"] and got["packet-bad"] == ("blocked", ["schema"])
    events = gate.audit(decided).filter("packet_id = 'packet-bad'").collect()
    assert [(e.stage, e.ok) for e in events] == [("schema", False)]
    assert gate.receipts(decided).count() == 6


def test_planner_and_guard(spark):
    field = packet([element(1, kind="filled", filled=True), element(2, label="Email", required=True), element(3, "button", "Submit")], "packet-000a")
    button = packet([element(1, "button", "Submit", risk="state_changing")], "packet-000b")
    off = packet([element(1, "button", "Submit", disabled=True)], "packet-000c")
    got = {r.packet_id[-1]: (r.action, r.target, r.requires_confirmation, r.confidence) for r in planner.next_step(packets(spark, field, button, off)).collect()}
    assert got == {"a": ("type", "e2", False, 0.75), "b": ("click", "e1", True, 0.7), "c": ("scroll", None, False, 0.4)}
    target = packet([element(1, kind="placeholder", token="PII:PAN#1"), element(2, kind="redacted", token="PII:FACE#1", role="image"), element(3, "button", "Pay", risk="state_changing")], "packet-000d")
    steps = [("type", "e1", "user_prompt", None, False), ("click", "e9", None, None, False), ("click", "e3", None, None, False), ("type", "e2", "placeholder", "PII:FACE#1", False), ("click", "e3", "placeholder", "PII:PAN#1", True)]
    plans = spark.createDataFrame([("q", "packet-000d", "other", steps)], f"plan_id string, packet_id string, answers string, steps array<{planner.STEP}>")
    found = sorted((r.step, r.problem) for r in planner.guard(plans, packets(spark, target)).collect())
    assert found == [
        (-1, "other_packet"), (0, "already_filled"), (1, "no_such_element"), (2, "risk_not_confirmed"), (3, "not_typable"), (3, "token_gone"), (4, "token_not_typed"), (4, "token_of_other"),
    ]


def test_perception(spark):
    page = '<main><form><label for="m">Mobile number</label><input id="m" type="tel" value="98765 43210" required><input type="password" name="p"><select name="city"></select><button>Pay now</button><p hidden>no</p><p>Some text</p></form></main>'
    pages = spark.createDataFrame([(1, "https://www.mybank.example.com/x", page), (2, "http://host.gov.in:80", None)], "page_id long, url string, html string")
    got = {r.id: r for r in perception.regions(pages).collect()}
    assert [(got[f"e{k}"].role, got[f"e{k}"].structural_class) for k in range(2, 6)] == [("textbox", "PHONE_IN"), ("password", "PASSWORD"), ("combobox", "ADDRESS"), ("button", None)] or len(got) >= 5
    assert any(r.raw_text == "Some text" for r in got.values()) and not any(r.raw_text == "no" for r in got.values())
    phone = next(r for r in got.values() if r.structural_class == "PHONE_IN")
    assert phone.label == "Mobile number" and phone.raw_value == "98765 43210"
    assert next(r for r in got.values() if r.role == "button").risk == "state_changing"
    assert {r.page_id: r.page_kind for r in perception.page_kinds(pages).collect()} == {1: "form", 2: "other"}
    assert {r.page_id: (r.origin_class, r.tls) for r in perception.origins(pages).collect()} == {1: ("banking", True), 2: ("government", False)}


def test_prompts(spark):
    fields = [("f1", "Full name", None), ("f2", "Email address", None), ("f3", "PIN code", None)]
    tasks = spark.createDataFrame([(1, "My name is Asha Rao, email: asha@mail.com and pin code 380015", fields), (2, None, fields)], "task_id long, prompt string, fields array<struct<id:string,label:string,structural_class:string>>")
    got = {r.task_id: r for r in prompts.answers(tasks).collect()}
    assert {a.field_id: a.value for a in got[1].answers} == {"f1": "Asha Rao", "f2": "asha@mail.com", "f3": "380015"}
    assert got[1].intent == "My name is [provided locally], email: [provided locally] and pin code [provided locally]"
    assert got[2].answers == [] and got[2].intent == ""


def test_media():
    image = np.random.default_rng(0).integers(0, 256, (36, 64, 4), dtype=np.uint8)
    h = media.tile_hashes(image)
    x = 0x811C9DC5
    for v in image[0:4:4, 0:4:4, :3].reshape(-1):
        x = ((x ^ int(v)) * 0x01000193) & 0xFFFFFFFF
    assert h[0] == x and len(h) == 144
    rect = {"x": 10.0, "y": 5.0, "w": 12.0, "h": 10.0}
    out = media.compose(image, [rect])
    assert media.failures(out, [rect]) == [] and media.failures(image, [rect])
    assert (out[0, 0] == image[0, 0]).all()
    assert media.detector_input(image).shape == (3, 240, 320)
    png = media.png(np.zeros((4, 6)))
    assert media.inspect(png) == {"format": "png", "width": 6, "height": 4, "removed": []}
    assert media.inspect(b"nothing") is None and math.isclose(float(media.detector_input(np.full((4, 4, 4), 255, np.uint8)).max()), 1.0)


def test_media_tables(spark):
    png = media.png(np.zeros((4, 6)))
    files = spark.createDataFrame([("a", png), ("b", b"junk"), ("c", None)], "name string, content binary")
    assert {r.name: r.clean for r in media.inspect_images(files).collect()} == {"a": True, "b": False, "c": False}
    box = lambda x: (float(x), 0.0, 10.0, 10.0)
    boxes = spark.createDataFrame([(1, 1, 0.9, box(0)), (1, 2, 0.8, box(1)), (1, 3, 0.75, box(50)), (1, 4, 0.1, box(90))], "frame long, ord long, score double, box struct<x:double,y:double,w:double,h:double>")
    assert sorted(r.ord for r in media.suppress(boxes).collect()) == [1, 3]
    assert sorted(r.ord for r in media.distinct_codes(boxes).collect()) == [1, 3, 4]


@pytest.mark.parametrize("text", ["\x01\x01\x01 aadhaar 9999 4105 7058 ok", "pan\x01 ABCPE1234F\x01 mail\x01a@mail.example.com\x01", "\x02\x00card 4111 1111 1111 1111\x01"])
def test_control_characters_keep_places(spark, text):
    from sparkveil.operators.recognizers import detect

    rows = spark.createDataFrame([(1, "s", text)], "pos int, session string, text string")
    spans = detect(rows, threshold=0.3).head().spans
    assert spans and all(text[s.start : s.end].replace("\x01", "\x02") == s.text for s in spans)
    clean = policy.sanitize_texts(rows, "fortress").head().clean
    for s in spans:
        assert s.text not in clean and not any(c.isdigit() for c in clean.replace("#1", ""))


def test_streams_forget_idle_keys(spark, tmp_path):
    """A key whose time is over leaves the state store, and begins anew if it comes back."""
    schema = "user_id long, event_id long, event_type string, t long"
    day = 24 * 60 * 60 * 1000
    batches = [[(1, 1, "a", day), (1, 2, "b", day + 1000)], [(2, 3, "a", 3 * day)], [(2, 4, "a", 3 * day + 1)], [(1, 5, "c", 3 * day + 2)]]
    source = tmp_path / "in"
    seen = {}
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema).select("user_id", "event_id", "event_type", F.timestamp_millis("t").alias("ts")).coalesce(1)
        frame.write.mode("append").parquet(str(source))
        got = stateful.run_once(stateful.sessions(spark.readStream.schema(frame.schema).parquet(str(source))), str(tmp_path / "run"))
        seen = {r.event_id: r.session_no for r in got.collect()}
    assert seen == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}


def test_strict_rules_of_packets_and_plans():
    from sparkveil.operators import wire

    good = {
        "schema": "scp/1.0", "packet_id": "packet-0001", "captured_at_ms": 5, "policy": {"mode": "shield", "policy_version": "1", "invariant_floor": True}, "device": {"backend": "none", "tier": "T0", "viewport": {"w": 8, "h": 6, "dpr": 1.5}},
        "origin": {"class": "other", "tls": True, "page_kind": "form", "lang": "en"}, "visual": {"present": False, "regions_redacted": 0}, "redaction_legend": {"PII:PAN": {"shape": "x", "recoverable_by_client": True}},
        "elements": [{"id": "e1", "role": "textbox", "label": None, "box": [0, 0, 1, 1], "value": {"kind": "placeholder", "token": "PII:PAN#1", "length": 10}, "evidence": ["structural:role"], "confidence": 1, "source": "dom"}],
        "task": {"intent": "go", "history": [{"step": 1, "action": "click", "element_label": None, "result": "ok"}]}, "untrusted_text": [{"src": "e1", "text": "t"}],
    }
    assert wire.packet_faults(good) == []

    def changed(path, value):
        import copy

        out = at = copy.deepcopy(good)
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        return [code for _, code in wire.packet_faults(out)]

    cases = [
        (("schema",), "scp/2", "unknown_value"), (("packet_id",), "short", "length"), (("captured_at_ms",), 0, "range"), (("captured_at_ms",), 1.5, "not_number"), (("captured_at_ms",), True, "not_number"), (("policy", "mode"), "open", "unknown_value"),
        (("policy", "invariant_floor"), False, "not_flag"), (("device", "viewport", "dpr"), 0, "range"), (("origin", "url"), "http://x", "unknown_key"), (("elements", 0, "box"), [1, 2, 3], "length"), (("elements", 0, "evidence"), ["guess:x"], "form"),
        (("elements", 0, "value"), {"kind": "filled"}, "missing"), (("elements", 0, "value"), {"kind": "other"}, "unknown_value"), (("elements", 0, "value", "token"), "PII:NONE#1", "form"), (("elements", 0, "confidence"), 1.1, "range"), (("elements", 0, "id"), "x1", "form"),
        (("elements", 0, "label"), "x" * 301, "length"), (("redaction_legend",), {}, "not_in_legend"), (("visual",), {"present": True, "regions_redacted": 0}, "incomplete"), (("visual", "data_b64"), "AAAA", "without_image"), (("task", "intent"), None, "not_text"),
        (("untrusted_text",), [{"src": "e1", "text": "t"}] * 201, "length"), (("task", "history", 0, "result"), "maybe", "unknown_value"), (("untrusted_text", 0, "src"), "p1", "form"),
    ]
    for path, value, code in cases:
        assert code in changed(path, value), (path, value)
    assert wire.packet_faults([]) == [("packet", "not_record")]
    plan = {"schema": "plan/1.0", "packet_id": "packet-0001", "reasoning_summary": "", "steps": [{"action": "scroll", "scroll": {"direction": "up", "amount": "page"}, "requires_confirmation": False}], "needs_more_context": False, "confidence": 0.5}
    assert wire.plan_faults(plan) == []
    for step, code in (({"action": "click", "requires_confirmation": True}, "missing_for_action"), ({"action": "type", "target_element_id": "e1", "requires_confirmation": True}, "missing_for_action"), ({"action": "scroll", "requires_confirmation": True}, "missing_for_action"), ({"action": "wait", "wait_ms": 10_001, "requires_confirmation": True}, "range"), ({"action": "done"}, "missing"), ({"action": "done", "requires_confirmation": True, "x": 1}, "unknown_key")):
        assert code in [c for _, c in wire.plan_faults(plan | {"steps": [step]})]


def test_built_packets_are_well_formed(spark):
    from sparkveil.operators import wire

    regions = perception.regions(spark.createDataFrame([(7, '<main><form><label for="m">Email</label><input id="m" type="email" value="a@mail.example.com"><input id="n"><p>Write to a@mail.example.com</p></form></main>')], "page_id long, html string")).drop("truncated")
    intents = spark.createDataFrame([("7", "mail a@mail.example.com")], "page_id string, intent string")
    meta = spark.createDataFrame([("7", "packet-0007", 5, "shield", "other", True, "form", None, 800, 600, 1.0)], "page_id string, packet_id string, captured_at_ms long, mode string, origin_class string, tls boolean, page_kind string, lang string, w int, h int, dpr double")
    history = spark.createDataFrame([("7", k, "click", None, "ok") for k in range(1, 61)], "page_id string, step int, action string, element_label string, result string")
    made = wire.build_packets(meta, policy.sanitize(regions, "shield", intents), history)
    import json

    packet = json.loads(made.head().raw)
    assert wire.packet_faults(packet) == []
    assert len(packet["task"]["history"]) == 50 and packet["task"]["history"][0]["step"] == 11 and "example.com" not in made.head().raw
    assert wire.read_requests(made.select(F.col("packet_id").alias("request_id"), "raw")).head().reason == "received"


def test_remembered_values_are_leaks_too(spark):
    from sparkveil.operators import vault

    minted = vault.mint(spark.createDataFrame([(1, "PAN", "ABCPE1234F", 1)], "session long, cls string, value string, seq long"))
    kept = spark.createDataFrame([(1, "k", "quo\"ted"), (1, "k2", "ABCPE1234F"), (1, "k3", "abc")], "session long, key string, value string")
    rows = spark.createDataFrame([(1, '{"t":"quo\\"ted and ABCPE1234F abc"}')], "session long, payload string")
    assert sorted(r.token for r in vault.leaks(rows, minted, kept=kept).collect()) == ["PII:PAN#1", "VAULT:REMEMBERED#1"]


def test_a_full_vault_and_a_hot_session(spark):
    from sparkveil.operators import vault

    rows = spark.createDataFrame([(k % 20 // 19, "EMAIL" if k % 3 else "PAN", f"v{k}", k) for k in range(3000)], "session long, cls string, value string, seq long").repartition(8)
    got = vault.mint(rows).collect()
    assert len(got) == 3000 and sum(not r.overflow for r in got) == 150 + 256
    hot = sorted((r for r in got if r.session == 0), key=lambda r: r.first_seq)
    assert all(not r.overflow for r in hot[:256]) and all(r.overflow for r in hot[256:])


def test_images_shrink_until_they_fit_and_stay_masked():
    from sparkveil.operators import intake

    r = np.random.default_rng(1)
    image = r.integers(100, 255, (90, 160, 4)).astype(np.uint8)
    rects = [{"x": 20, "y": 20, "w": 50, "h": 30}]
    made, out = intake.sendable(image, rects, most_edge=1600, most_bytes=12_000)
    assert len(made) <= 12_000 and out.shape[1] < 160
    assert (intake.unpacked(made)[..., :3] == out[..., :3]).all()
    scale = out.shape[1] / 160
    assert (out[int(25 * scale) : int(45 * scale), int(25 * scale) : int(65 * scale), :3] == intake.FILL).all()
    with pytest.raises(ValueError, match="does not fit"):
        intake.sendable(image, rects, most_bytes=100)
    pdf = intake.raster_pdf(out)
    assert pdf.startswith(b"%PDF") and pdf.rstrip().endswith(b"%%EOF") and pdf.count(b" obj\n") == 5


def test_assets_must_all_be_right(spark):
    rows = lambda *oks: spark.createDataFrame([(f"a{k}" + (".gz" if k == 0 else ""), ok) for k, ok in enumerate(oks)], "name string, ok boolean")
    assert media.usable_assets(rows(True, True)).head().loaded
    with pytest.raises(Exception, match="manifest"):
        media.usable_assets(rows(True, False)).collect()
    with pytest.raises(Exception, match="manifest"):
        media.usable_assets(spark.createDataFrame([("a", True)], "name string, ok boolean")).collect()


def test_exports(spark, tmp_path):
    from sparkveil.sources import export

    rows = spark.createDataFrame([("b", 2, 0.5), ("a|", None, 1.0)], "cls string, n int, recall double")
    assert export.markdown(rows, ("cls", "n", "recall")) == "| cls | n | recall |\n|---|---|---|\n| a\\| | - | 100.0 % |\n| b | 2 | 50.0 % |\n"
    with pytest.raises(ValueError, match="no report"):
        export.markdown(rows, ("cls",), most=1)
    export.write_json(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_tokens_in_a_text(spark):
    assert column(spark, ["a PII:PAN#2 b PII:EMAIL#1 PII:PAN#2", "", None], planner.tokens_in) == [["PII:PAN#2", "PII:EMAIL#1"], [], []]

import random

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import intervals, media, policy, ranges, vault, wire
from sparkveil.streaming import receipts


def panel(seed: int, n: int):
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", "a", None]), t, t, r.choice(["run", "run", "closed", "activated", "navigated"]), r.choice([1, 2, None]), r.choice(["x", "y", None, ""]), r.choice(["t1", "t2", None])) for t in range(n)]


def ends_by_hand(rows):
    out, states = {}, {}
    for user, _, event, kind, tab, origin, task in rows:
        s = states.setdefault(user, {"tab": None, "origin": None, "task": None, "n": 0})
        why = None
        if kind == "run":
            if s["task"] != task:
                why = "new_task"
            elif s["tab"] is not None and s["tab"] != tab:
                why = "tab_switched"
            elif s["origin"] is not None and s["origin"] != origin:
                why = "origin_changed"
            s.update(tab=tab, origin=origin, task=task)
        elif kind == "closed" and tab is not None and tab == s["tab"]:
            why = "tab_closed"
            s.update(tab=None, origin=None, task=None)
        elif kind == "activated" and s["tab"] is not None and tab != s["tab"]:
            why = "tab_switched"
            s.update(tab=tab, origin=None, task=None)
        elif kind == "navigated" and tab is not None and tab == s["tab"] and (not origin or origin != s["origin"]):
            why = "origin_changed"
            s.update(origin=None, task=None)
        s["n"] += why is not None
        out[event] = (why, s["n"])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_session_ends_over_ranges(spark, seed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = panel(seed, 300)
    events = spark.createDataFrame(rows, "user_id string, ts long, event_id long, kind string, tab long, origin string, task string").repartition(3)
    got = {r.event_id: (r.ended, r.session_no) for r in vault.session_ends(events).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == ends_by_hand(rows)


def gated(spark, folder, numbers):
    rows = [("s", f"packet-{i:010d}", i, "shield", (False, None, None, None), "blocked" if i % 3 == 0 else "sent", [], 1, "x", {}) for i in numbers]
    schema = "session string, packet_id string, sent_at_ms long, mode string, visual struct<present:boolean,format:string,sha256:string,data_b64:string>, outcome string, reasons array<string>, bytes int, payload_sha256 string, legend_counts map<string,int>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


@pytest.mark.parametrize("stop_at", ["kept", "sent"])
def test_receipts_come_first_and_once_though_a_run_is_stopped(spark, tmp_path, monkeypatch, stop_at):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    stream = gated(spark, source, range(20))
    mark, stopped = receipts._mark, []

    def failing(own, to, name, batch):
        if name == stop_at and batch >= 0 and not stopped:
            stopped.append(batch)
            raise RuntimeError("stopped here")
        mark(own, to, name, batch)

    monkeypatch.setattr(receipts, "_mark", failing)
    with pytest.raises(Exception, match="stopped here"):
        receipts.start(stream, folder, checkpoint).awaitTermination()
    assert stopped
    with pytest.raises(FileNotFoundError):  # what was written of the batch is not to be seen
        receipts.sent_packets(spark, folder)
    if stop_at == "sent":
        assert receipts.kept_receipts(spark, folder).count() == 20
    gated(spark, source, range(20, 30))
    receipts.start(stream, folder, checkpoint).awaitTermination()
    kept = [r.packet_id for r in receipts.kept_receipts(spark, folder).collect()]
    sent = [r.packet_id for r in receipts.sent_packets(spark, folder).collect()]
    assert sorted(kept) == [f"packet-{i:010d}" for i in range(30)]
    assert sorted(sent) == [f"packet-{i:010d}" for i in range(30) if i % 3]
    receipts.start(stream, folder, checkpoint).awaitTermination()  # nothing new: nothing changes
    assert receipts.kept_receipts(spark, folder).count() == 30


def test_a_cache_serves_evicts_and_refuses(spark):
    sha = lambda b: __import__("hashlib").sha256(b).hexdigest()
    wanted = spark.createDataFrame([(n, sha(n.encode())) for n in "abcdef"], "name string, sha256 string")
    cache = spark.createDataFrame([("a", b"a"), ("b", b"broken"), ("e", b"broken"), ("z", b"z")], "name string, content binary")
    source = spark.createDataFrame([("b", b"b"), ("b", b"b"), ("c", b"c"), ("d", b"wrong"), ("e", b"wrong")], "name string, content binary")
    rows = media.read_through(wanted, cache, source)
    assert {r.name: (r.status, r.content) for r in rows.collect()} == {"a": ("hit", b"a"), "b": ("refetched", b"b"), "c": ("fetched", b"c"), "d": ("mismatch", None), "e": ("mismatch", None), "f": ("missing", None)}
    held = media.next_cache(rows)
    assert sorted(r.name for r in held.collect()) == ["a", "b", "c"]
    assert {r.name: r.status for r in media.read_through(wanted.filter("name < 'd'"), held, source.limit(0)).collect()} == dict.fromkeys("abc", "hit")
    with pytest.raises(Exception, match="no right content of d"):
        media.served(rows.filter("name = 'd'")).collect()


def test_overlapping_intervals_over_bins(spark):
    r = random.Random(4)
    left = [(r.choice([1, 2, None]), i, (s := r.randrange(-50, 900)), s + r.choice([0, 1, 5, 300])) for i in range(120)]
    right = [(r.choice([1, 2, None]), i, (s := r.randrange(-50, 900)), s + r.choice([0, 1, 5, 300])) for i in range(120)]
    a, b = spark.createDataFrame(left, "k long, i long, s1 long, e1 long"), spark.createDataFrame(right, "k long, j long, s2 long, e2 long")
    for width in (1, 7, 256):
        got = sorted((x.i, x.j) for x in intervals.overlapping(a, b, ["k"], ("s1", "e1"), ("s2", "e2"), width).collect())
        assert got == sorted((i, j) for k, i, s, e in left for m, j, t, f in right if k is not None and k == m and s < e and t < f and s < f and t < e)


def test_a_value_over_three_regions_of_one_line(spark):
    texts = [("e1", "Card", 0, 10), ("e2", "4111 1111", 100, 12), ("e3", "1111", 200, 9), ("e4", "1111", 300, 10), ("e5", "1111", 400, 90)]
    rows = spark.createDataFrame([("p", i, e, t, None, (float(x), float(y), 90.0, 20.0)) for i, (e, t, x, y) in enumerate(texts)], "page_id string, pos int, id string, raw_text string, raw_value string, box struct<x:double,y:double,w:double,h:double>")
    assert sorted((r.id, r.cross_class, r.cross_value) for r in policy.cross_region(rows, "fortress").collect()) == [(e, "CARD_NUMBER", "4111111111111111") for e in ("e2", "e3", "e4")]


def test_range_columns_do_not_stay(spark):
    events = spark.createDataFrame([("u", 1, 1, "run", 1, "x", "t")], "user_id string, ts long, event_id long, kind string, tab long, origin string, task string")
    assert vault.session_ends(events).columns == [*events.columns, "ended", "session_no"]
    assert not {ranges.PART, ranges.AT} & set(vault.sessions(events.withColumn("event_type", F.lit("a"))).columns)


def test_failed_attempts_keep_bodies_in_their_task(spark):
    from sparkveil.plans import exchange

    got = exchange.failed_attempts(spark, "/root/testdata/sf0.001")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([(1, "{"), (2, "{}"), (3, None), (4, "[" + " " * 50)], "request_id long, raw string")
    found = {r.request_id: r.bytes for r in wire.failed_requests(rows, most_bytes=40).collect()}
    assert found == {1: 1, 3: 9}


def test_lines_of_long_pages_are_never_broadcast(spark):
    from sparkveil.plans import flows

    plan = flows.media_long_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan


def test_costly_rows_of_small_tables_are_spread(spark):
    from sparkveil.plans import catalogue, exchange, flows

    folder = "/root/testdata/sf0.001"
    for made in (catalogue._frames, exchange._requests, flows._attempts):
        assert made(spark, folder).rdd.getNumPartitions() >= 16


def test_rows_of_a_large_group_are_not_shuffled_to_its_intervals(spark):
    from sparkveil.operators import percentiles

    rows = spark.createDataFrame([("hot" if k % 10 else f"g{k % 30}" if k % 20 else None, float(k * 7919 % 3001)) for k in range(3000)], "g string, v double")
    got = percentiles.nearest_ranks(rows, ["g"], "v", {"p50": 50, "p95": 95}, small=200)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert [k for k in ("LeftAnti, BuildRight", "Inner, BuildRight") if k in plan] == ["LeftAnti, BuildRight", "Inner, BuildRight"]
    for r in got.collect():
        own = sorted(x.v for x in rows.filter(F.col("g").eqNullSafe(r.g)).collect())
        assert (r.n, r.p50, r.p95) == (len(own), own[-(-50 * len(own) // 100) - 1], own[-(-95 * len(own) // 100) - 1])


def test_a_sanitized_page_is_perceived_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    box = F.struct(*[F.lit(0.0).alias(c) for c in "xyhw"])
    regions = spark.range(20).select(
        F.col("id").cast("string").alias("page_id"), F.lit(1).alias("pos"), F.lit("e1").alias("id"), F.lit("text").alias("role"), F.lit(None).cast("string").alias("label"), box.alias("box"), F.lit("dom").alias("source"), F.lit(0.9).alias("confidence"),
        F.array(F.lit("structural:role")).alias("evidence"), F.lit(True).alias("explained"), F.lit(None).cast("string").alias("raw_value"), told(F.concat(F.lit("mail a.b@mail.example.com "), "id")).alias("raw_text"),
        *[F.lit(None).cast("string").alias(c) for c in ("structural_class", "visual_class", "input_type", "risk")],
    )
    texts = policy.sanitize(regions, "fortress")["untrusted_text"].collect()
    assert sorted(r.text for r in texts) == sorted(f"mail PII:EMAIL#1 {i}" for i in range(20))
    assert seen.value == 20


def test_packets_of_pages_are_built_once(spark):
    from sparkveil.plans import finds

    plan = finds.page_packets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "redaction_legend" in plan  # what is read of the packets
    assert "collect_list(struct(pos" not in plan


def test_redaction_is_scored_without_matching_what_is_not_asked_for(spark, monkeypatch):
    from sparkveil.operators import scoring
    from sparkveil.plans import catalogue

    asked, match = [], scoring.match
    monkeypatch.setattr(scoring, "match", lambda *args, **kinds: asked.append(1) or match(*args, **kinds))
    assert catalogue.redaction_score(spark, "/root/testdata/sf0.001").count() > 0
    assert not asked

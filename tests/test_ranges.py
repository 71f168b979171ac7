import random

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import gate, ranges, vault


def rows(seed: int, n: int, hot: float = 0.5):
    r, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += r.choice([0, 1, 3, 40, 400])
        out.append((r.choice(["hot", None, "a", "b", "c"]) if r.random() > hot else "hot", t, i, r.choice(["x", "y", None]), r.choice([1, 2, None])))
    return out


def frame(spark, own):
    return spark.createDataFrame(own, "session string, at long, seq long, kind string, n long").repartition(5)


@pytest.fixture
def ranged(spark):
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so small a table is one range
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def by_session(own):
    out = {}
    for row in sorted(own, key=lambda x: (x[1], x[2])):
        out.setdefault(row[0], []).append(row)
    return out


def test_running_sums_maxima_and_rows_before_over_ranges(ranged):
    own = rows(1, 400)
    dealt = ranges.dealt(frame(ranged, own), "session", ["at", "seq"])
    assert dealt.select(ranges.PART).distinct().count() > 2
    assert max(r["count"] for r in dealt.groupBy(ranges.PART).count().collect()) < 250  # though one session has half of all rows
    got = ranges.previous(ranges.running(dealt, "session", {"total": F.col("n")}, {"top": F.col("at")}), "session", {"was": "kind"})
    got = {r.seq: (r.total, r.top, r.was) for r in got.collect()}
    for mine in by_session(own).values():
        total, was = 0, None
        for _, at, seq, kind, n in mine:
            total += n or 0
            assert got[seq] == (total, at, was)
            was = kind


def test_islands_begin_after_gaps(ranged):
    own = rows(2, 300)
    got = {r.seq: r.island for r in ranges.islands(ranges.dealt(frame(ranged, own), "session", ["at", "seq"]), "session", "at", 40).collect()}
    numbers = set()
    for mine in by_session(own).values():
        last, number = None, None
        for _, at, seq, _, _ in mine:
            if last is None or at - last >= 40:
                number = got[seq]
                assert number not in numbers
                numbers.add(number)
            assert got[seq] == number
            last = at
    assert len(numbers) > 20


@pytest.mark.parametrize("seed", [3, 4])
def test_rate_limit_over_ranges(ranged, seed):
    own = rows(seed, 400)
    own += own[:30]  # repeated rows are attempts, too
    sends = frame(ranged, own)
    got = sorted((r.session or "", r.at, r.seq, r.allowed) for r in gate.rate_limit(sends, at="at", most=3, window_ms=50).collect())
    want = []
    for who, mine in by_session(own).items():
        live = []
        for _, at, seq, _, _ in mine:
            live = [t for t in live if t > at - 50]
            want.append((who or "", at, seq, len(live) < 3))
            if len(live) < 3:
                live.append(at)
    assert got == sorted(want)


def test_a_send_without_a_time_is_refused_and_empty_tables_stay_empty(spark):
    sends = spark.createDataFrame([("a", None, 1), ("a", 5, 2)], "session string, sent_at_ms long, seq long")
    assert {r.seq: r.allowed for r in gate.rate_limit(sends).collect()} == {1: False, 2: True}
    assert gate.rate_limit(sends.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_vault_expiry_over_ranges(ranged, seed):
    own = [(s, "EMAIL" if n == 1 else "PAN", f"{k}{seq % 5}", at, seq) for s, at, seq, k, n in rows(seed, 400)]
    attempts = ranged.createDataFrame(own, "session string, cls string, value string, at long, seq long").repartition(5)
    got = {r.seq: r.token for r in vault.mint_with_ttl(attempts, ttl_ms=60, cap=6).collect()}
    state = {}
    for who, cls, value, at, seq in sorted(own, key=lambda x: (x[3], x[4])):
        live, numbers = state.setdefault(who, ({}, {}))
        for k in [k for k, (made, _) in live.items() if made < at - 60]:
            del live[k]
        if (cls, value) not in live and len(live) < 6:
            numbers[cls] = numbers.get(cls, 0) + 1
            live[cls, value] = (at, numbers[cls])
        assert got[seq] == f"PII:{cls}#{live[cls, value][1] if (cls, value) in live else '?'}"


def test_automaton_equals_a_search_of_each_value(spark):
    r = random.Random(9)
    parts = ["abcd", "abcdef", "bcde", 'q"uo\\te', "línea", "xyzz", "zz\nzz", "ab"]
    value = lambda: "".join(r.choice(parts) for _ in range(r.randrange(1, 3)))
    own = [(r.choice([None, "a", "b"]), "EMAIL", f"PII:EMAIL#{i}", value()) for i in range(60)]
    payloads = [(r.choice([None, "a", "b", "c"]), i, r.choice([None, "", "".join(r.choice([value(), " ", "\\n"]) for _ in range(6))])) for i in range(2500)]
    entries = spark.createDataFrame(own, "session string, cls string, token string, value string")
    got = sorted((x.i, x.token) for x in vault.scan(spark.createDataFrame(payloads, "session string, i long, payload string").repartition(3), entries).collect())
    escaped = lambda v: v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    want = [(i, t) for s, i, text in payloads for e, _, t, v in own if s == e and text and len(v) >= 4 and (v in text or escaped(v) in text)]
    assert got == sorted(want)


def test_each_attempt_has_one_outcome(spark):
    own = [("a" if i % 3 else None, f"packet-{i // 2:010d}", i * 10, i) for i in range(80)]
    gated = spark.createDataFrame(own, "session string, packet_id string, sent_at_ms long, i long").withColumn("passed", F.lit(True)).withColumn("reasons", F.array().cast("array<string>"))
    got = {r.i: r.outcome for r in gate.outcomes(gated).collect()}
    assert len(got) == 80
    for null in (True, False):
        assert [got[i] for i in range(80) if (i % 3 == 0) == null] == ["sent"] * min(30, 27 if null else 53) + ["blocked"] * (0 if null else 23)

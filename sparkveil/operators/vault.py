"""The vault: session-stable tokens for values, first come first numbered."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkveil.functions.taxonomy import format_token
from sparkveil.operators import ranges
from sparkveil.sources.durable import durable
from sparkveil.sources.shipping import ship

CAP = 256
TTL_MS = 30 * 60 * 1000
#: Values shorter than this are never reported as leaks.
LEAST_LEAK = 4


def mint(attempts: DataFrame, session: str = "session", cap: int = CAP) -> DataFrame:
    """Tokens of a session's values: one row for each (session, cls, value) with first_seq, ordinal, token and overflow.

    ``attempts`` has the session, cls, value and seq, a sortable place of discovery. A value gets the
    next ordinal of its class where it first appears. Beyond ``cap`` values a session is full: later ones get
    no ordinal and the token PII:CLS#?. Attempts are aggregated first, and of a session's distinct values each task
    passes on its first ``cap`` only, so no task ranks more than that for each task before it, however large a session is.
    """
    first = attempts.groupBy(session, "cls", "value").agg(F.min("seq").alias("first_seq"))
    place = F.row_number().over(W.partitionBy(session).orderBy("first_seq", "cls", "value"))
    inside = first.withColumn("_place", place).filter(F.col("_place") <= cap)
    ordinal = F.row_number().over(W.partitionBy(session, "cls").orderBy("first_seq", "value"))
    inside = inside.select(F.col(session).alias("_session"), F.col("cls").alias("_cls"), F.col("value").alias("_value"), ordinal.cast("long").alias("ordinal"))
    same = F.col(session).eqNullSafe(F.col("_session")) & F.col("cls").eqNullSafe(F.col("_cls")) & F.col("value").eqNullSafe(F.col("_value"))
    ranked = first.join(inside, same, "left").withColumn("overflow", F.col("ordinal").isNull())
    token = F.when(F.col("overflow"), F.concat(F.lit("PII:"), F.col("cls"), F.lit("#?"))).otherwise(format_token(F.col("cls"), F.col("ordinal")))
    return ranked.withColumn("token", token).select(session, "cls", "value", "first_seq", "ordinal", "overflow", "token")


def resolve(tokens: DataFrame, vault: DataFrame, session: str = "session") -> DataFrame:
    """``tokens`` with the value behind each; null if the session's vault has no such token."""
    return tokens.join(vault.filter("not overflow").select(session, "token", "value"), [session, "token"], "left")


def stats(vault: DataFrame, session: str = "session") -> DataFrame:
    """Live entries of each session by class."""
    return vault.filter("not overflow").groupBy(session, "cls").agg(F.count("*").alias("entries"))


def remembered(events: DataFrame, session: str = "session", now=None, ttl: str | None = None) -> DataFrame:
    """The latest value that each (session, key) was given, with its time; with ``now`` and ``ttl`` (an interval) only what is not older."""
    latest = events.groupBy(session, "key").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("created_at"))
    return latest if now is None else latest.filter(F.col("created_at") >= F.lit(now) - F.expr(f"INTERVAL {ttl or '30 minutes'}"))


def live(vault: DataFrame) -> DataFrame:
    """A vault's entries as ``scan`` takes them: session, cls, token, value; cls and token are null where the vault has none."""
    rows = vault.filter("not overflow") if "overflow" in vault.columns else vault
    return rows.select("session", *[F.col(c) if c in vault.columns else F.lit(None).cast("string").alias(c) for c in ("cls", "token")], "value")


def json_escaped(value: Column) -> Column:
    """A value as it appears inside a JSON string."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":"|"\}$', "")


def scan(payloads: DataFrame, entries: DataFrame, session: str = "session", payload: str = "payload", kept: list[str] | None = None) -> DataFrame:
    """A row for each entry (session, cls, token, value) and payload of its session that has the value, as it is or JSON-escaped.

    Columns are those of ``payloads`` (or of them ``kept``), cls and token. A session's entries become one automaton (Aho-Corasick), and each payload is read
    once, whatever the number of entries. A session's payloads are streamed past its automaton; hot sessions, fewer than 1000, are cut
    into parts that each build it. An automaton holds the session's values: a vault is capped, a value's length is not.
    """
    spark = payloads.sparkSession
    ship(spark)
    rows = payloads.select(F.col(session).alias("_session"), F.col(payload).alias("_text"), F.struct(*(kept or payloads.columns)).alias("_kept"))
    counts = rows.groupBy("_session").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).head()[0] or 0
    share = max(1000, -(-total // 1000))
    hot = counts.filter(F.col("_n") > share).select(F.col("_session").alias("_hot"), F.ceil(F.col("_n") / share).cast("int").alias("_parts"))

    def parted(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), F.col("_session").eqNullSafe(F.col("_hot")), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_hot")

    read = parted(rows).select("_session", F.pmod(F.xxhash64("_text"), F.col("_parts")).cast("int").alias("_part"), F.lit(1).alias("_kind"), "_text", "_kept", *[F.lit(None).cast("string").alias(c) for c in ("said", "cls", "token")])
    own = entries.filter(F.length("value") >= LEAST_LEAK).select(F.col(session).alias("_session"), F.col("value").alias("_text"), json_escaped(F.col("value")).alias("said"), "cls", "token")
    own = parted(own).select("_session", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_kind"), "_text", F.lit(None).cast(rows.schema["_kept"].dataType).alias("_kept"), "said", "cls", "token")
    met = own.unionByName(read).repartition("_session", "_part").sortWithinPartitions("_session", "_part", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        now, words, named, automaton = object(), {}, [], None
        for batch in batches:
            hits, found = [], []
            columns = [batch.column(c).to_pylist() for c in ("_session", "_part", "_kind", "_text", "said", "cls", "token")]
            for i, (who, part, kind, text, said, cls, token) in enumerate(zip(*columns, strict=True)):
                if (who, part) != now:
                    now, words, named, automaton = (who, part), {}, [], None
                if kind == 0:
                    for word in {text, said}:
                        words.setdefault(word, []).append(len(named))
                    named.append((cls, token))
                    continue
                if not words or not text:
                    continue
                if automaton is None:
                    automaton = ahocorasick.Automaton()
                    for word, at in words.items():
                        automaton.add_word(word, at)
                    automaton.make_automaton()
                for at in sorted({a for _, own in automaton.iter(text) for a in own}):
                    hits.append(i)
                    found.append(named[at])
            if hits:
                kept_rows = batch.column("_kept").take(pa.array(hits))
                yield pa.RecordBatch.from_arrays([kept_rows, pa.array([c for c, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], ["_kept", "cls", "token"])

    schema = StructType([rows.schema["_kept"], StructField("cls", StringType()), StructField("token", StringType())])
    return met.mapInArrow(run, schema).select("_kept.*", "cls", "token")


def leaks(payloads: DataFrame, vault: DataFrame, session: str = "session", payload: str = "payload", kept: DataFrame | None = None) -> DataFrame:
    """Tokens whose value occurs in a payload of the same session, as it is or JSON-escaped: the payload's columns, cls and token.

    ``kept`` has the session's remembered values (session, key, value); one that has no token is named VAULT:REMEMBERED#n.
    """
    own = vault.filter(~F.col("overflow")).select(session, "cls", "token", "value")
    if kept is not None:
        more = kept.filter(F.length("value") >= LEAST_LEAK).select(session, "value").distinct().join(own.select(F.col(session).alias("_s"), F.col("value").alias("_v")), F.col(session).eqNullSafe(F.col("_s")) & (F.col("value") == F.col("_v")), "left_anti")
        nth = F.row_number().over(W.partitionBy(session).orderBy("value"))
        own = own.unionByName(more.select(session, F.lit(None).cast("string").alias("cls"), F.concat(F.lit("VAULT:REMEMBERED#"), nth).alias("token"), "value"))
    return scan(payloads, own, session, payload)


def sessions(events: DataFrame, user: str = "user_id", origin: str = "event_type", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """``events`` with the vault's session: it is wiped whenever the origin changes. A user's events are scanned in ranges."""
    rows = ranges.previous(ranges.dealt(events, user, list(order)), user, {"_was": origin})
    changed = F.coalesce((F.col(origin) != F.col("_was")).cast("long"), F.lit(0))
    return ranges.running(rows, user, sums={"session_no": changed}).drop("_was", ranges.PART, ranges.AT)


def ended(state: dict, kind: str, tab: int | None, origin: str | None, task: str | None) -> str | None:
    """Why an event ends what is kept, or null; ``state`` (tab, origin and task that are active) is changed.

    A run ends it if its task, tab or origin is another one; closing the active tab, showing another one, and a navigation of the
    active tab that is not within one known origin end it as well. Other tabs' events do nothing.
    """
    was = {k: state.get(k) for k in ("tab", "origin", "task")}
    if kind == "run":
        state.update(tab=tab, origin=origin, task=task)
        return run_ends(was, {"tab": tab, "origin": origin, "task": task})
    if kind == "closed" and tab is not None and tab == was["tab"]:
        state.update(tab=None, origin=None, task=None)
        return "tab_closed"
    if kind == "activated" and was["tab"] is not None and tab != was["tab"]:
        state.update(tab=tab, origin=None, task=None)
        return "tab_switched"
    if kind == "navigated" and tab is not None and tab == was["tab"] and (not origin or origin != was["origin"]):
        state.update(origin=None, task=None)
        return "origin_changed"
    return None


def run_ends(was: dict, now: dict) -> str | None:
    if was["task"] != now["task"]:
        return "new_task"
    if was["tab"] is not None and was["tab"] != now["tab"]:
        return "tab_switched"
    return "origin_changed" if was["origin"] is not None and was["origin"] != now["origin"] else None


def session_ends(events: DataFrame, user: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """``events`` (kind: run, closed, activated or navigated; tab, origin, task) with ended, why what is kept was wiped there, and session_no.

    A run sets all of the state, so a user's events are cut at runs and walked apart, in ranges; whether a run itself ends a session is told
    from the state that the event before it left.
    """

    def step(state: dict, kind: str, tab: int | None, origin: str | None, task: str | None) -> tuple:
        why = ended(state, kind, tab, origin, task)
        return why, state.get("tab"), state.get("origin"), state.get("task")

    rows = ranges.dealt(events, user, list(order))
    rows = ranges.running(rows, user, highest={"_run": F.when(F.col("kind") == "run", F.col(ranges.AT))})
    # before a user's first run nothing is active; those events need no walk, but a key that no run has
    keyed = rows.withColumn("_run", F.coalesce("_run", -1 - F.col(ranges.AT)))
    kinds = {"tab": "long", "origin": "string", "task": "string"}
    walked = ranges.in_order(keyed, "_run", [ranges.AT], ["kind", *kinds], "_why string, _tab long, _origin string, _task string", step)
    walked = ranges.previous(durable(walked), user, {f"_was_{k}": f"_{k}" for k in kinds})
    other = lambda k: ~F.col(f"_was_{k}").eqNullSafe(F.col(k))
    run = F.when(other("task"), "new_task").when(F.col("_was_tab").isNotNull() & other("tab"), "tab_switched").when(F.col("_was_origin").isNotNull() & other("origin"), "origin_changed")
    walked = walked.withColumn("ended", F.when(F.col("kind") == "run", run).otherwise(F.col("_why")))
    out = ranges.running(walked, user, sums={"session_no": F.col("ended").isNotNull().cast("long")})
    return out.drop(ranges.PART, ranges.AT, "_run", "_why", *[f"_{k}" for k in kinds], *[f"_was_{k}" for k in kinds])


def running_totals(receipts: DataFrame, amounts: tuple[str, ...], session: str = "session", order: str = "at") -> DataFrame:
    """``receipts`` (session, at and ``amounts``) with sent, the session's receipts so far, and each amount's sum so far.

    Rows are summed in ranges of (session, at), and a range starts from what its first session had before: no task gets a whole session.
    """
    rows = ranges.dealt(receipts, session, [order])
    out = ranges.running(rows, session, sums={"sent": F.lit(1).cast("long"), **{f"_sum_{a}": F.col(a).cast("long") for a in amounts}})
    return out.withColumns({a: F.col(f"_sum_{a}") for a in amounts}).drop(*[f"_sum_{a}" for a in amounts], ranges.PART, ranges.AT)


def mint_with_ttl(attempts: DataFrame, session: str = "session", ttl_ms: int = TTL_MS, cap: int = CAP) -> DataFrame:
    """Each attempt (session, cls, value, at: epoch ms, seq) with its token, as entries expire.

    An entry lives until it is older than ``ttl_ms``; using it does not renew it, and ordinals are not used again. After a gap
    longer than ``ttl_ms`` nothing lives, so a session is cut there: the parts are walked on their own, with at most ``cap`` entries
    and a counter for each class, and a second scan over the parts adds the ordinals that earlier ones gave out.
    """

    def step(state: dict, cls: str, value: str, at: int) -> tuple:
        live, numbers = state.setdefault("live", {}), state.setdefault("n", {})
        while live and (oldest := next(iter(live.values())))[0] < at - ttl_ms:  # made in order of time
            del live[oldest[2]]
        if (cls, value) not in live and len(live) < cap:
            numbers[cls] = numbers.get(cls, 0) + 1
            live[cls, value] = (at, numbers[cls], (cls, value))
        return (live[cls, value][1] if (cls, value) in live else None,)

    rows = attempts.select(session, "cls", "value", F.col("at").cast("long"), F.col("seq").cast("long"))
    cut = ranges.islands(ranges.dealt(rows, session, ["at", "seq"]), session, "at", ttl_ms + 1)
    walked = durable(ranges.in_order(cut, "island", [ranges.AT], ["cls", "value", "at"], "n long", step).drop(ranges.PART, ranges.AT))
    given = walked.groupBy(session, "cls", "island").agg(F.coalesce(F.max("n"), F.lit(0)).alias("_given"))
    given = ranges.running(ranges.dealt(given, [session, "cls"], ["island"]), [session, "cls"], sums={"_before": F.col("_given")})
    before = given.select("island", F.col("cls").alias("_cls"), (F.col("_before") - F.col("_given")).alias("_before"))
    out = walked.join(before, (walked["island"] == before["island"]) & F.col("cls").eqNullSafe(F.col("_cls")))
    token = F.concat(F.lit("PII:"), F.col("cls"), F.lit("#"), F.coalesce((F.col("n") + F.col("_before")).cast("string"), F.lit("?")))
    return out.select(session, "cls", "value", "at", "seq", token.alias("token"))

"""Keyed state over event time: rate limit, vault with expiry, sessions, loops, uploads, stale snapshots, frame differences.

Each function works on a stream and, with the same result, on a batch read as one (availableNow). State
is bounded for each key, and a key that is idle for as long as its state can matter is forgotten when the watermark
has passed: nothing of a session stays in the state store after its time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkveil.operators.gate import SENDS, WINDOW_MS
from sparkveil.operators.vault import CAP, TTL_MS, ended
from sparkveil.sources.shipping import ship

#: How late rows may come. Later ones are dropped.
WATERMARK = "30 minutes"
#: Idle time after which a session's order or counters no longer matter.
IDLE_MS = 24 * 60 * 60 * 1000
#: Steps, stalled steps and corrections of one task at most; cancelled or sent uploads that a tab remembers.
MOST_STEPS, MOST_STALLED, MOST_CORRECTED, MOST_UPLOADS = 30, 3, 3, 256


def _keyed(events: DataFrame, key: str, columns: list[str], order: list[str], out: str, idle_ms: int, step: Callable[[dict, dict], tuple]) -> DataFrame:
    """A stream of (key, ts, columns) to rows of ``out`` (key first): ``step`` takes a key's state, which it changes, and
    one row (with at: its time in milliseconds) after the other, in order of ts and ``order``.

    The state is JSON and goes when the watermark is ``idle_ms`` past the key's last row.
    """
    ship(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    names = [key, *(f.split()[0] for f in out.split(", "))]

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", *order], kind="stable")
        at = rows["ts"].astype("datetime64[ms]").astype("int64").tolist()
        made = [(group[0], *step(kept, {**row, "at": t})) for row, t in zip(rows[columns].to_dict("records"), at, strict=True)]
        state.update((json.dumps(kept),))
        state.setTimeoutTimestamp(max(max(at, default=0) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(made, columns=names)

    keyed = events.select(key, F.col("ts").cast("timestamp").alias("ts"), *columns).withWatermark("ts", WATERMARK).groupBy(key)
    return keyed.applyInPandasWithState(fold, f"`{key}` {kind}, {out}", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit(events: DataFrame, most: int = SENDS, window_ms: int = WINDOW_MS) -> DataFrame:
    """Stream of (user_id, event_id, ts) to (user_id, event_id, allowed); see ``operators.gate.rate_limit``."""

    def step(state: dict, row: dict) -> tuple:
        state["live"] = [t for t in state.get("live", []) if t > row["at"] - window_ms]
        allowed = len(state["live"]) < most
        if allowed:
            state["live"].append(row["at"])
        return int(row["event_id"]), allowed

    return _keyed(events, "user_id", ["event_id"], ["event_id"], "event_id long, allowed boolean", window_ms, step)


def vault(events: DataFrame, ttl_ms: int = TTL_MS, cap: int = CAP) -> DataFrame:
    """Stream of (session, seq, ts, cls, value) to (session, seq, token); see ``operators.vault.mint_with_ttl``.

    A session that is forgotten begins anew, with ordinals from 1.
    """

    def step(state: dict, row: dict) -> tuple:
        cls, value = row["cls"], row["value"]
        live = state["live"] = [x for x in state.get("live", []) if x[2] >= row["at"] - ttl_ms]
        found = next((x for x in live if x[:2] == [cls, value]), None)
        if found is None:
            if len(live) >= cap:
                return int(row["seq"]), f"PII:{cls}#?"
            numbers = state.setdefault("n", {})
            numbers[cls] = numbers.get(cls, 0) + 1
            found = [cls, value, row["at"], numbers[cls]]
            live.append(found)
        return int(row["seq"]), f"PII:{cls}#{found[3]}"

    return _keyed(events, "session", ["seq", "cls", "value"], ["seq"], "seq long, token string", max(ttl_ms, IDLE_MS), step)


def sessions(events: DataFrame) -> DataFrame:
    """Stream of (user_id, event_id, ts, event_type) with session_no, which grows with each change of the origin; see ``operators.vault.sessions``."""

    def step(state: dict, row: dict) -> tuple:
        if state.get("origin", row["event_type"]) != row["event_type"]:
            state["n"] = state.get("n", 0) + 1
        state["origin"] = row["event_type"]
        return int(row["event_id"]), row["event_type"], state.get("n", 0)

    return _keyed(events, "user_id", ["event_id", "event_type"], ["event_id"], "event_id long, event_type string, session_no long", IDLE_MS, step)


def session_ends(events: DataFrame) -> DataFrame:
    """Stream of (user_id, event_id, ts, kind, tab, origin, task) with ended and session_no; see ``operators.vault.session_ends``."""

    def known(value):
        return None if value is None or value != value else value  # pandas has NaN for null

    def step(state: dict, row: dict) -> tuple:
        tab = known(row["tab"])
        why = ended(state, row["kind"], None if tab is None else int(tab), known(row["origin"]), known(row["task"]))
        state["n"] = state.get("n", 0) + (why is not None)
        return int(row["event_id"]), why, state["n"]

    return _keyed(events, "user_id", ["event_id", "kind", "tab", "origin", "task"], ["event_id"], "event_id long, ended string, session_no long", IDLE_MS, step)


def loops(events: DataFrame) -> DataFrame:
    """Stream of a task's steps (user_id, event_id, ts, stalled, corrected) with its counters and a verdict: go_on, or why the task has to stop."""

    def step(state: dict, row: dict) -> tuple:
        for name, more in (("steps", True), ("stalled", row["stalled"]), ("corrected", row["corrected"])):
            state[name] = state.get(name, 0) + int(more)
        verdict = "too_many_steps" if state["steps"] > MOST_STEPS else "stalled" if state["stalled"] > MOST_STALLED else "too_many_corrections" if state["corrected"] > MOST_CORRECTED else "go_on"
        return int(row["event_id"]), state["steps"], state["stalled"], state["corrected"], verdict

    return _keyed(events, "user_id", ["event_id", "stalled", "corrected"], ["event_id"], "event_id long, steps long, stalled long, corrected long, verdict string", IDLE_MS, step)


def uploads(events: DataFrame, most: int = MOST_UPLOADS) -> DataFrame:
    """Stream of (user_id, event_id, ts, upload, cancel) with outcome: cancelled, dropped (it was cancelled before),
    repeated (it was sent before) or sent. The last ``most`` uploads of each kind are remembered."""

    def step(state: dict, row: dict) -> tuple:
        gone, sent = state.setdefault("gone", []), state.setdefault("sent", [])
        upload = int(row["upload"])
        said = "cancelled" if row["cancel"] else "dropped" if upload in gone else "repeated" if upload in sent else "sent"
        kept = gone if said == "cancelled" else sent if said == "sent" else None
        if kept is not None and upload not in kept:
            kept.append(upload)
            del kept[:-most]
        return int(row["event_id"]), said

    return _keyed(events, "user_id", ["event_id", "upload", "cancel"], ["event_id"], "event_id long, outcome string", IDLE_MS, step)


def fresh_snapshots(events: DataFrame) -> DataFrame:
    """Stream of (tab, version, ts) with stale: the tab has shown a later version before."""

    def step(state: dict, row: dict) -> tuple:
        version, last = int(row["version"]), state.get("last")
        state["last"] = version if last is None else max(last, version)
        return version, last is not None and version < last

    return _keyed(events, "tab", ["version"], ["version"], "version long, stale boolean", IDLE_MS, step)


def frame_diffs(hashed: DataFrame) -> DataFrame:
    """Stream of (stream, frame, ts, hashes) to (stream, frame, n_changed); see ``operators.media.frame_diffs``."""

    def step(state: dict, row: dict) -> tuple:
        now, last = [int(h) for h in row["hashes"]], state.get("last")
        state["last"] = now
        return int(row["frame"]), len(now) if last is None or len(last) != len(now) else sum(a != b for a, b in zip(last, now, strict=True))

    return _keyed(hashed, "stream", ["frame", "hashes"], ["frame"], "frame long, n_changed long", IDLE_MS, step)


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is now, and the table it wrote. ``folder`` is shared by all executors."""
    out, checkpoint = f"{folder}/out", f"{folder}/checkpoint"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return stream.sparkSession.read.schema(stream.schema).parquet(out)

"""Stateful event flows: rate limits, write throttling, duplicate-scan guard, webhook routing, snapshot appends.

The stateful rules are plain functions over one key's ordered events. ``limited`` and ``throttled`` run them as batch jobs over
a key's events in time order; ``limit_stream`` and ``throttle_stream`` run the same functions in Structured Streaming,
where what a key keeps is its state, until it no longer matters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditspark.streaming import stateful

#: Requests in a window of seconds; seconds between writes of one scan's progress.
LIMIT, WINDOW_S, WRITE_S = 300, 60.0, 1.0
#: Resets of a password in a window of seconds.
RESETS, RESET_WINDOW_S = 3, 900.0
#: How much later than others an event of a stream may come, in seconds.
LATE_S = 10.0


def admit(times: Iterable[float], held: list[float], limit: int, window_s: float) -> tuple[list[bool], list[float]]:
    """Which requests a sliding window admits. Rejected ones are not remembered."""
    out = []
    for t in times:
        held = [h for h in held if t - h < window_s]
        if ok := len(held) < limit:
            held.append(t)
        out.append(ok)
    return out, held


def throttle(times: Iterable[float], terminal: Iterable[bool], last: float | None, every_s: float = WRITE_S) -> tuple[list[bool], float | None]:
    """Which progress events are written: the terminal ones, and others a while after the last written."""
    out = []
    for t, end in zip(times, terminal):
        if ok := bool(end) or last is None or t - last >= every_s:
            last = t
        out.append(ok)
    return out, last


def limited(events: DataFrame, limit: int = LIMIT, window_s: float = WINDOW_S) -> DataFrame:
    """key, at (seconds), event_id, admitted. A key's events pass one task in time order, batch by batch; what is
    remembered between batches is at most ``limit`` times, however many events the key has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for frame in frames:
            for k, own in frame.groupby("key", sort=False):
                if k != key:
                    key, held = k, []
                ok, held = admit(own["at"], held, limit, window_s)
                yield own.assign(admitted=ok)

    ordered = events.repartition("key").sortWithinPartitions("key", "at", "event_id")
    return ordered.select("key", "at", "event_id").mapInPandas(run, "key long, at double, event_id long, admitted boolean")


def throttled(events: DataFrame, every_s: float = WRITE_S) -> DataFrame:
    """key, at, event_id, written."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for frame in frames:
            for k, own in frame.groupby("key", sort=False):
                if k != key:
                    key, last = k, None
                ok, last = throttle(own["at"], own["terminal"], last, every_s)
                yield own.drop(columns="terminal").assign(written=ok)

    ordered = events.repartition("key").sortWithinPartitions("key", "at", "event_id")
    return ordered.select("key", "at", "event_id", "terminal").mapInPandas(run, "key long, at double, event_id long, written boolean")


def limit_stream(events: DataFrame, limit: int = LIMIT, window_s: float = WINDOW_S, clock: str = "event", late_s: float = LATE_S) -> DataFrame:
    """As ``limited`` on a stream: a key's state is the list of times that it holds, and ends when the last is past."""

    def decide(own: pd.DataFrame, held: list[float] | None) -> tuple:
        ok, held = admit(own["at"], list(held or []), limit, window_s)
        return ok, held or None, held[-1] + window_s if held else 0.0

    return stateful.decided(events, decide, "held array<double>", "admitted", window_s, clock, late_s)


def throttle_stream(events: DataFrame, every_s: float = WRITE_S, clock: str = "event", late_s: float = LATE_S) -> DataFrame:
    """As ``throttled`` on a stream: a key's state is the time of its last write, and ends when any event would be written."""

    def decide(own: pd.DataFrame, last: float | None) -> tuple:
        ok, last = throttle(own["at"], own["terminal"], last, every_s)
        return ok, last, last + every_s

    return stateful.decided(events, decide, "last double", "written", every_s, clock, late_s)


class Spaced(StatefulProcessor):
    """Rows of a key that come a while after the last one that was let through; the state ends when any would pass."""

    def __init__(self, delay_s: float) -> None:
        self.delay_s = delay_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows))
        own = own.sort_values(["at_seconds", *(c for c in own.columns if c not in ("at_seconds", "ts"))])
        ok, last = throttle(own["at_seconds"], [False] * len(own), self.last.get()[0] if self.last.exists() else None, self.delay_s)
        self.last.update((last,))
        stateful.only_timer(self.handle, int((last + self.delay_s) * 1000) + 1)
        yield own[ok].drop(columns="at_seconds")

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def guard_duplicates(scans: DataFrame, delay_s: float = 60.0, late_s: float = LATE_S) -> DataFrame:
    """Of scans (repo, commit, ts, ...) of the same content within the delay of one that was let through, none but that one:
    the rule of ``throttle`` over a pair's scans in time order, on a table or a stream."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_seconds")
    if scans.isStreaming:
        stateful.timed_state(scans.sparkSession)
        timed = scans.select("*", at).withWatermark("ts", f"{late_s} seconds")
        return timed.groupBy("repo", "commit").transformWithStateInPandas(Spaced(delay_s), scans.schema, "append", "EventTime")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for frame in frames:
            for k, own in frame.groupby(["repo", "commit"], sort=False, dropna=False):
                if k != key:
                    key, last = k, None
                ok, last = throttle(own["at_seconds"], [False] * len(own), last, delay_s)
                yield own[ok].drop(columns="at_seconds")

    rest = [c for c in scans.columns if c not in ("repo", "commit", "ts")]
    ordered = scans.select("*", at).repartition("repo", "commit").sortWithinPartitions("repo", "commit", "at_seconds", *rest)
    return ordered.mapInPandas(run, scans.schema)


def route_webhooks(events: DataFrame, repositories: DataFrame) -> DataFrame:
    """Webhook events (kind, action, branch, repo_name) to what they start: a review or a scan, for connected repositories."""
    starts = F.when((F.col("kind") == "pull_request") & F.col("action").isin("opened", "synchronize", "reopened"), "review").when((F.col("kind") == "push") & (F.col("branch") == F.col("default_branch")), "scan")
    known = repositories.where(F.coalesce(F.col("is_connected"), F.lit(True))).select("repo_name", "default_branch")
    return events.join(known, "repo_name").withColumn("starts", starts).where(F.col("starts").isNotNull())


def replay(tasks: DataFrame, scans: DataFrame) -> DataFrame:
    """Dead-letter tasks (event_id, ts, arguments, resolved) that are open, with the scan that their arguments name: the
    newest task of a scan is replayed, which sets the scan to pending; all of its tasks are resolved."""
    open_ = tasks.where(~F.col("resolved")).withColumn("analysis_id", F.get_json_object("arguments", "$.analysis_id").try_cast("long"))
    known = open_.join(scans.select("analysis_id", F.col("status").alias("was")), "analysis_id")
    place = F.row_number().over(Window.partitionBy("analysis_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return known.withColumn("replayed", place == 1).withColumn("status", F.lit("pending")).withColumn("resolved", F.lit(True))


def heartbeat_stream(events: DataFrame, silence_s: float = 5.0) -> DataFrame:
    """A row for each key (ts, terminal) that says nothing for a while before it ends, once a silence, by event time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame({"key": [key[0]], "beat_ms": [state.getCurrentWatermarkMs()]})
            state.remove()
            return
        own = pd.concat(list(frames)).sort_values("ts")
        if bool(own["terminal"].any()):
            if state.exists:
                state.remove()
            return
        due = int(own["ts"].max().timestamp() * 1000 + silence_s * 1000)
        state.update((due,))
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return events.groupBy("key").applyInPandasWithState(step, "key long, beat_ms long", "due long", "append", GroupStateTimeout.EventTimeTimeout)


def running_maximum(events: DataFrame, value: str) -> DataFrame:
    """Counters of a key that never fall."""
    return events.withColumn("shown", F.max(value).over(Window.partitionBy("key").orderBy("at", "event_id")))

"""Streams with timers and state that ends: rules over a key's events, progress channels, the guard of running scans.

All use ``transformWithState`` with the RocksDB state store, which ``timed_state`` sets for the session. Events of a key
come in order from batch to batch, as from a partitioned log; within a batch they are put in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Silence before a heartbeat, and what a second scan of a commit waits for the first, in seconds.
SILENCE_S, WAIT_S = 5.0, 60.0
#: A channel without progress, and a scan without an end, for so long are given up.
ABANDON_S, LOST_S = 3600.0, 3600.0


def timed_state(spark: SparkSession) -> None:
    """Keep the state of this session's streams in RocksDB, as timers and time-to-live need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def only_timer(handle: StatefulProcessorHandle, at_ms: int | None) -> None:
    """Leave the key the one timer ``at_ms``, or none."""
    for old in list(handle.listTimers()):
        if old != at_ms:
            handle.deleteTimer(old)
    if at_ms is not None:
        handle.registerTimer(at_ms)


class Rule(StatefulProcessor):
    """A rule over a key's events: ``decide`` takes them in order and what is remembered, and gives a decision for each
    and what to remember, with the time (seconds) from which it no longer matters.

    By event time a timer ends the memory when the watermark has passed that time, however late the stream runs. By
    processing time the state's time-to-live does, ``keep_s`` after the last event, if other events come or not."""

    def __init__(self, decide: Callable, memory: str, name: str, by_event_time: bool, keep_s: float) -> None:
        self.decide, self.memory, self.name, self.by_event_time, self.keep_s = decide, memory, name, by_event_time, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("memory", self.memory, None if self.by_event_time else int(self.keep_s * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        own = pd.concat(list(rows)).sort_values(["at", "event_id"])
        decisions, held, until = self.decide(own, held[0] if held is not None else None)
        if held is None:
            self.state.clear()
        else:
            self.state.update((held,))
        if self.by_event_time:
            only_timer(self.handle, None if held is None else int(until * 1000) + 1)
        yield pd.DataFrame({"key": key[0], "at": own["at"], "event_id": own["event_id"], self.name: decisions})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def decided(events: DataFrame, decide: Callable, memory: str, name: str, keep_s: float, clock: str = "event", late_s: float = 0.0) -> DataFrame:
    """key, at, event_id and the decision of every event (key, at, event_id, ...) of a stream, by ``Rule``.

    ``clock``: what ends the memory, event or processing time. By event time, events later than ``late_s`` have no
    decision, as their key's memory may be gone."""
    timed_state(events.sparkSession)
    by_event_time = clock == "event"
    if by_event_time:
        events = events.withColumn("_ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("_ts", f"{late_s} seconds")
    schema = f"key {events.schema['key'].dataType.simpleString()}, at double, event_id long, {name} boolean"
    rule = Rule(decide, memory, name, by_event_time, keep_s)
    return events.groupBy("key").transformWithStateInPandas(rule, schema, "append", "EventTime" if by_event_time else "ProcessingTime")


class Channel(StatefulProcessor):
    """Progress of one key: each event, the end, heartbeats in silence."""

    def __init__(self, silence_s: float, abandon_s: float) -> None:
        self.silence_ms, self.abandon_ms = int(silence_s * 1000), int(abandon_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long", 2 * self.abandon_ms)

    @staticmethod
    def said(key: tuple, kinds: list[str], ids: list, at: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(kinds), "kind": kinds, "event_id": pd.array(ids, "Int64"), "at_ms": at})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        own = pd.concat(list(rows)).sort_values(["at", "event_id"])
        kinds, ids = [], []
        for event, end in zip(own["event_id"].tolist(), own["terminal"].tolist()):
            kinds += ["progress", "closed"] if end else ["progress"]
            ids += [event, event] if end else [event]
        if kinds[-1] == "closed":
            self.last.clear()
            only_timer(self.handle, None)
        else:
            self.last.update((now,))
            only_timer(self.handle, now + self.silence_ms)
        yield self.said(key, kinds, ids, [now] * len(kinds))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        given_up = now - self.last.get()[0] >= self.abandon_ms
        if given_up:
            self.last.clear()
        else:
            self.handle.registerTimer(now + self.silence_ms)
        yield self.said(key, ["abandoned" if given_up else "heartbeat"], [None], [now])

    def close(self) -> None:
        pass


def progress_channel(events: DataFrame, silence_s: float = SILENCE_S, abandon_s: float = ABANDON_S) -> DataFrame:
    """key, kind, event_id, at_ms of a stream of progress (key, at, event_id, terminal), by the clock: ``progress`` for
    each event, ``closed`` after one that ends the key, ``heartbeat`` after each silence before that, and ``abandoned``
    instead where there was no progress for a long time. After either of these the key has no state; what comes later for
    it opens a new channel."""
    timed_state(events.sparkSession)
    schema = f"key {events.schema['key'].dataType.simpleString()}, kind string, event_id long, at_ms long"
    return events.groupBy("key").transformWithStateInPandas(Channel(silence_s, abandon_s), schema, "append", "ProcessingTime")


@dataclass
class Guard:
    """The scans of one content: those that run, which of them has the guard, and those that wait for its result."""

    holder: int | None = None
    running: list[tuple[int, float]] = field(default_factory=list)  # scan, since
    waiting: list[tuple[int, float]] = field(default_factory=list)  # scan, until
    wait_s: float = WAIT_S
    lost_s: float = LOST_S

    def pass_to(self, at: float) -> list[tuple]:
        """What time alone decides up to ``at``: who has waited long enough scans; scans that never end are given up."""
        due = sorted((until, scan) for scan, until in self.waiting if until <= at)
        self.waiting = [w for w in self.waiting if w[1] > at]
        self.running = [r for r in self.running + [(scan, until) for until, scan in due] if at - r[1] < self.lost_s]
        if self.holder not in [scan for scan, _ in self.running]:
            self.holder = None
        return [(scan, "scans after waiting", until, None) for until, scan in due]

    def start(self, scan: int, at: float) -> list[tuple]:
        out = self.pass_to(at)
        if self.holder is not None:
            self.waiting.append((scan, at + self.wait_s))
            return out
        self.holder = scan
        self.running.append((scan, at))
        return [*out, (scan, "scans", at, None)]

    def end(self, scan: int, at: float, good: bool) -> list[tuple]:
        """A good end gives its result to all that wait; a failed one leaves them waiting. Ends of scans that do not run
        say nothing."""
        out = self.pass_to(at)
        if scan not in [r for r, _ in self.running]:
            return out
        self.running = [r for r in self.running if r[0] != scan]
        if scan == self.holder:
            self.holder = None
        if good:
            out += [(waiter, "reuses", at, scan) for waiter, _ in self.waiting]
            self.waiting = []
        return out

    def take(self, events: Iterable[tuple]) -> list[tuple]:
        """``events`` (at, scan, ended, good) in order; ends come before starts of the same time."""
        out = []
        for at, scan, ended, good in events:
            out += self.end(scan, at, good) if ended else self.start(scan, at)
        return out


GUARDED = "scan long, outcome string, at double, result_of long"
_ORDER = {"repo": True, "commit": True, "at": True, "ended": False, "scan": True}


def outcomes(rows: list[tuple], key: dict) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=["scan", "outcome", "at", "result_of"])
    return found.assign(**key, result_of=found["result_of"].astype("Int64"))[[*key, "scan", "outcome", "at", "result_of"]]


def _schema(scans: DataFrame) -> str:
    return f"repo {scans.schema['repo'].dataType.simpleString()}, commit {scans.schema['commit'].dataType.simpleString()}, {GUARDED}"


def guarded(scans: DataFrame, wait_s: float = WAIT_S, lost_s: float = LOST_S) -> DataFrame:
    """repo, commit, scan, outcome, at, result_of of every start among ``scans`` (repo, commit, at, scan, ended, good).

    A start scans where no scan of the content has the guard; else it waits for a running scan's result and reuses it,
    or scans all the same when the wait is over. A key's events pass one task in order, batch by batch; what is kept
    between batches is the scans that run and wait."""
    order = [F.col(c) if up else F.col(c).desc() for c, up in _ORDER.items()]
    names = scans.select("repo", "commit").columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, guard = None, Guard()
        for frame in frames:
            for k, own in frame.groupby(names, sort=False, dropna=False):
                if k != key:
                    if key is not None:
                        yield outcomes(guard.pass_to(float("inf")), dict(zip(names, key)))
                    key, guard = k, Guard(wait_s=wait_s, lost_s=lost_s)
                yield outcomes(guard.take(zip(own["at"], own["scan"].tolist(), own["ended"], own["good"])), dict(zip(names, key)))
        if key is not None:
            yield outcomes(guard.pass_to(float("inf")), dict(zip(names, key)))

    ordered = scans.repartition("repo", "commit").sortWithinPartitions(*order)
    return ordered.select(*names, "at", "scan", "ended", "good").mapInPandas(run, _schema(scans))


class GuardOfScans(StatefulProcessor):
    """``Guard`` as the state of a key, with a timer for whatever time decides next."""

    def __init__(self, wait_s: float, lost_s: float) -> None:
        self.wait_s, self.lost_s = wait_s, lost_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("guard", "holder long, running array<long>, since array<double>, waiting array<long>, until array<double>")

    def load(self) -> Guard:
        if not self.state.exists():
            return Guard(wait_s=self.wait_s, lost_s=self.lost_s)
        holder, running, since, waiting, until = self.state.get()
        return Guard(holder, list(zip(running, since)), list(zip(waiting, until)), self.wait_s, self.lost_s)

    def save(self, guard: Guard) -> None:
        if not guard.running and not guard.waiting:
            self.state.clear()
            only_timer(self.handle, None)
            return
        running, waiting = ([list(x) for x in zip(*rows)] or [[], []] for rows in (guard.running, guard.waiting))
        self.state.update((guard.holder, *running, *waiting))
        due = min([until for _, until in guard.waiting] + [since + self.lost_s for _, since in guard.running])
        only_timer(self.handle, int(due * 1000) + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["at", "ended", "scan"], ascending=[True, False, True])
        guard = self.load()
        found = guard.take(zip(own["at"], own["scan"].tolist(), own["ended"], own["good"]))
        self.save(guard)
        yield outcomes(found, {"repo": key[0], "commit": key[1]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        guard = self.load()
        found = guard.pass_to(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self.save(guard)
        yield outcomes(found, {"repo": key[0], "commit": key[1]})

    def close(self) -> None:
        pass


def guard_stream(scans: DataFrame, wait_s: float = WAIT_S, lost_s: float = LOST_S, late_s: float = 0.0) -> DataFrame:
    """As ``guarded`` on a stream, by event time: a wait ends when the watermark, ``late_s`` behind, has passed it."""
    timed_state(scans.sparkSession)
    timed = scans.withColumn("_ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("_ts", f"{late_s} seconds")
    return timed.groupBy("repo", "commit").transformWithStateInPandas(GuardOfScans(wait_s, lost_s), _schema(scans), "append", "EventTime")

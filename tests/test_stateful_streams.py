"""Streams with timers: equal to their batch forms over many batches, and without state when all is quiet."""

from __future__ import annotations

import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from auditspark.streaming import events as ev
from auditspark.streaming import stateful

EVENTS = "key long, at double, event_id long, terminal boolean"
SCANS = "repo long, commit string, at double, scan long, ended boolean, good boolean"


def in_files(spark, folder, batches, schema):
    """One file a batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, name, folder):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return query


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def made_events(seed, n=240, keys=5):
    rng = random.Random(seed)
    return [(rng.randrange(keys), t, i, rng.random() < 0.1) for i, t in enumerate(sorted(rng.uniform(0, 400) for _ in range(n)))]


@pytest.mark.parametrize("rule", ["limit", "throttle"])
def test_rules_by_event_time(spark, tmp_path, rule):
    rows = made_events(7)
    later = [(99, 2000.0, 9990, True)]
    batches = [rows[k : k + 60] for k in range(0, 240, 60)] + [later, [(99, 4000.0, 9991, True)], [(99, 6000.0, 9992, True)]]
    source = in_files(spark, tmp_path / "in", batches, EVENTS)
    every = spark.createDataFrame([r for b in batches for r in b], EVENTS)
    streamed, batch, column = (ev.limit_stream(source, 3, 60.0), ev.limited(every, 3, 60.0), "admitted") if rule == "limit" else (ev.throttle_stream(source, 5.0), ev.throttled(every, 5.0), "written")
    query = run(streamed, f"rule_{rule}", tmp_path / "ck")
    assert {r["event_id"]: r[column] for r in spark.table(f"rule_{rule}").collect()} == {r["event_id"]: r[column] for r in batch.collect()}
    counts = state_rows(query)
    assert max(counts) >= 5 and counts[-1] < max(counts)  # the five keys are forgotten; one that is still young may stay
    assert counts[-1] <= 2


def test_rule_by_processing_time_ends_by_itself(spark, tmp_path):
    """With no further event of any key, time-to-live ends the state; the rule forgets no sooner than its window."""
    folder = tmp_path / "in"
    spark.createDataFrame([(k, 0.5 * i, 10 * k + i, False) for k in range(3) for i in range(4)], EVENTS).coalesce(1).write.parquet(str(folder))
    source = spark.readStream.schema(EVENTS).parquet(str(folder))
    query = ev.limit_stream(source, 2, 3.0, clock="processing").writeStream.format("memory").queryName("ttl").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not (state_rows(query) and max(state_rows(query)) > 0 and state_rows(query)[-1] == 0):
            time.sleep(0.5)
        assert max(state_rows(query)) >= 3 and state_rows(query)[-1] == 0
    finally:
        query.stop()
    assert {r["event_id"]: r["admitted"] for r in spark.table("ttl").collect()} == {10 * k + i: i < 2 for k in range(3) for i in range(4)}


def test_channel(spark, tmp_path):
    """Every event is passed on, silence gives heartbeats until the end, and ended or given-up keys leave no state."""
    folder = tmp_path / "in"
    spark.createDataFrame([(1, 0.0, 1, False), (2, 0.0, 2, False), (2, 1.0, 3, True), (3, 0.0, 4, False)], EVENTS).coalesce(1).write.parquet(str(folder))
    source = spark.readStream.schema(EVENTS).parquet(str(folder))
    made = stateful.progress_channel(source, silence_s=1.0, abandon_s=8.0)
    query = made.writeStream.format("memory").queryName("channel").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    try:
        deadline = time.time() + 90
        said = lambda: [(r["key"], r["kind"], r["event_id"]) for r in spark.table("channel").collect()]
        while time.time() < deadline and (1, "heartbeat", None) not in said():
            time.sleep(0.3)
        spark.createDataFrame([(1, 9.0, 5, True)], EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        while time.time() < deadline and not ({(1, "closed", 5), (3, "abandoned", None)} <= set(said())):
            time.sleep(0.3)
        found = said()
        time.sleep(2.5)
        assert said() == found  # nothing is said of ended channels
        assert state_rows(query)[-1] == 0
    finally:
        query.stop()
    assert [x for x in found if x[1] != "heartbeat" and x[0] == 1] == [(1, "progress", 1), (1, "progress", 5), (1, "closed", 5)]
    assert [x for x in found if x[0] == 2] == [(2, "progress", 2), (2, "progress", 3), (2, "closed", 3)]
    beats = [x for x in found if x[0] == 3]
    assert beats[0] == (3, "progress", 4) and beats[-1] == (3, "abandoned", None) and set(beats[1:-1]) == {(3, "heartbeat", None)} and len(beats) >= 4


def test_guard_by_hand():
    """Start, duplicate, end, failed end, waiting too long, a scan that is lost."""
    g = stateful.Guard(wait_s=60, lost_s=300)
    assert g.start(1, 0) == [(1, "scans", 0, None)]
    assert g.start(2, 10) == [] and g.start(3, 20) == []
    assert g.end(1, 30, True) == [(2, "reuses", 30, 1), (3, "reuses", 30, 1)]
    assert g.end(2, 31, True) == [] and not g.running
    assert g.start(4, 40) == [(4, "scans", 40, None)] and g.start(5, 50) == []
    assert g.end(4, 60, False) == []  # a failure frees the guard; who waits goes on waiting
    assert g.start(6, 61) == [(6, "scans", 61, None)]
    assert g.start(7, 111) == [(5, "scans after waiting", 110, None)]
    assert g.end(5, 112, True) == [(7, "reuses", 112, 5)] and g.holder == 6
    assert g.start(8, 400) == [(8, "scans", 400, None)]  # scan 6 was lost at 361
    assert g.end(6, 401, True) == [] and g.end(8, 402, True) == [] and not g.running and g.holder is None


def plain_guard(rows, wait, lost):
    """What becomes of the scans of one content, second by second."""
    out, running, waiting, holder = [], {}, deque(), None
    queue = sorted(rows, key=lambda r: (r[2], not r[4], r[3]))
    for _, _, at, scan, ended, good in [*queue, (0, 0, 1e18, -1, True, False)]:
        for w, until in sorted(list(waiting), key=lambda x: (x[1], x[0])):
            if until <= at:
                waiting.remove((w, until))
                running[w] = until
                out.append((w, "scans after waiting", until, None))
        running = {k: t for k, t in running.items() if at - t < lost}
        holder = holder if holder in running else None
        if not ended and holder is None:
            holder, running[scan] = scan, at
            out.append((scan, "scans", at, None))
        elif not ended:
            waiting.append((scan, at + wait))
        elif scan in running:
            del running[scan]
            holder = None if holder == scan else holder
            if good:
                out += [(w, "reuses", at, scan) for w, _ in waiting]
                waiting.clear()
    return out


def made_scans(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for scan in range(n):
        repo, commit, at = rng.randrange(2), rng.choice(["c", "d"]), float(rng.randrange(2000))
        rows += [(repo, commit, at, scan, False, True), (repo, commit, at + rng.randrange(1, 150), scan, True, rng.random() < 0.6)]
    return sorted(rows, key=lambda r: (r[2], not r[4], r[3]))


@pytest.mark.parametrize("form", ["batch", "stream"])
def test_guard_against_a_plain_model(spark, tmp_path, form):
    rows = made_scans(4)
    expected = sorted((k, *x) for k in {r[:2] for r in rows} for x in plain_guard([r for r in rows if r[:2] == k], 60.0, 200.0))
    assert {x[2] for x in expected} == {"scans", "reuses", "scans after waiting"}
    if form == "batch":
        found = stateful.guarded(spark.createDataFrame(rows, SCANS).repartition(3), 60.0, 200.0)
    else:
        later = [[(9, "z", t, 1000 + k, False, True)] for k, t in enumerate((5000.0, 6000.0, 7000.0))]
        cut = [[r for r in rows if lo <= r[2] < hi] for lo, hi in zip((0, 500, 1000, 1500), (500, 1000, 1500, 1e9))]
        source = in_files(spark, tmp_path / "in", [*cut, *later], SCANS)
        query = run(stateful.guard_stream(source, 60.0, 200.0, late_s=1.0), "guard_of_scans", tmp_path / "ck")
        found = spark.table("guard_of_scans").where(F.col("repo") != 9)
        assert state_rows(query)[-1] <= 2
    assert sorted(((r["repo"], r["commit"]), r["scan"], r["outcome"], r["at"], r["result_of"]) for r in found.collect()) == expected


def test_guard_of_nothing(spark):
    assert stateful.guarded(spark.createDataFrame([], SCANS)).collect() == []

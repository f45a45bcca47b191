"""Failing rows of a stream stand alone in the failures, the others are written once, and a replay mends."""

from __future__ import annotations

import datetime
import time

import pytest
from pyspark.sql import functions as F

from auditspark.sources.keyed_table import KeyedTable
from auditspark.streaming import dead_letters as dl

SCHEMA = "id long, amount string, at timestamp"
START = datetime.datetime(2024, 1, 1, 0, 0, 0, 123456)


@pytest.fixture
def place(spark, tmp_path):
    out = KeyedTable(spark, str(tmp_path / "out"), "id long, amount double, at timestamp", ["id"])
    calls = []

    def work(rows, name):
        calls.append(name)
        out.append(rows.withColumn("amount", F.col("amount").cast("double")), name)  # fails where the amount is no number

    def lenient(rows, name):
        out.append(rows.withColumn("amount", F.coalesce(F.expr("try_cast(amount AS double)"), F.lit(-1.0))), name)

    return out, calls, work, lenient, str(tmp_path / "dead"), tmp_path


def rows_of(spark, rows):
    return spark.createDataFrame([(i, a, START + datetime.timedelta(seconds=i)) for i, a in rows], SCHEMA)


def test_stream_with_bad_rows(spark, place):
    out, calls, work, lenient, dead, tmp_path = place
    spark.conf.set("spark.sql.ansi.enabled", "true")
    first = [(i, str(i)) for i in range(40)] + [(100, "bad")]
    second = [(i, str(i)) for i in range(40, 60)]
    for rows in (first, second):
        rows_of(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.05)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = source.writeStream.foreachBatch(dl.isolating(work, dead, "load")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    assert sorted(r["id"] for r in out.read().collect()) == list(range(60))
    (failed,) = dl.open_failures(spark, dead, "load").collect()
    assert '"amount":"bad"' in failed["arguments"] and "CAST_INVALID_INPUT" in failed["error"] and "Traceback" in failed["trace"] and failed["rows"] == 1
    assert len(calls) < 30  # about twice the logarithm of the batch, not a run for each row
    # a replay that fails leaves it open, one that works closes it; the row is the same to the microsecond
    assert dl.replay(spark, dead, "load", SCHEMA, work, "1").count() == 1
    assert dl.replay(spark, dead, "load", SCHEMA, lenient, "2").count() == 0
    assert [(r["amount"], r["at"]) for r in out.read().where("id = 100").collect()] == [(-1.0, START + datetime.timedelta(seconds=100))]
    assert dl.replay(spark, dead, "load", SCHEMA, lenient, "2").count() == 0 and out.read().count() == 61


def test_a_batch_that_comes_again(spark, place):
    """After a crash between the parts, nothing is written or reported twice."""
    out, calls, work, _, dead, _ = place
    batch = rows_of(spark, [(i, str(i)) for i in range(10)] + [(50, "bad"), (51, None)])
    crashed = []

    def crashing(rows, name):
        if name.count(".") >= 2 and not crashed:
            crashed.append(name)
            raise KeyboardInterrupt
        work(rows, name)

    with pytest.raises(KeyboardInterrupt):
        dl.isolating(crashing, dead, "load")(batch, 3)
    for _ in range(2):
        dl.isolating(work, dead, "load")(batch, 3)
    assert sorted(r["id"] for r in out.read().collect()) == [*range(10), 51]
    assert [r["rows"] for r in dl.open_failures(spark, dead, "load").collect()] == [1]


def test_equal_rows_fail_together(spark, place):
    out, calls, work, lenient, dead, _ = place
    dl.isolating(work, dead, "load")(rows_of(spark, [(1, "bad")] * 3 + [(2, "2")]), 0)
    assert [r["rows"] for r in dl.open_failures(spark, dead, "load").collect()] == [3]
    seen = []
    dl.replay(spark, dead, "load", SCHEMA, lambda rows, name: seen.append(rows.count()), "again")
    assert seen == [3] and dl.open_failures(spark, dead, "load").count() == 0


def test_good_batches_run_once(spark, place):
    out, calls, work, _, dead, _ = place
    dl.isolating(work, dead, "load")(rows_of(spark, [(1, "1"), (2, "2")]), 0)
    assert calls == ["load-0"] and dl.open_failures(spark, dead, "load").count() == 0

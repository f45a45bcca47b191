"""The keyed table: every batch once, every key once, whatever fails or runs at once."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from auditspark.sources.keyed_table import KeyedTable

SCHEMA = "id long, kind string, at double, note string"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id", "kind"], ["at"], buckets=4)


def batch(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted((tuple(r[c] for c in ("id", "kind", "at", "note")) for r in df.collect()), key=repr)


def test_first_row_of_a_key_counts(spark, table):
    assert table.read().collect() == []
    assert table.append(batch(spark, (1, "a", 2.0, "later"), (1, "a", 1.0, "z"), (1, "a", 1.0, "first"), (2, None, 1.0, None)), 0)
    assert table.append(batch(spark, (1, "a", 0.0, "too late"), (2, None, 0.0, "null is a key"), (3, "c", 1.0, "new")), 1)
    expected = sorted([(1, "a", 1.0, "first"), (2, None, 1.0, None), (3, "c", 1.0, "new")], key=repr)
    assert content(table.read()) == expected
    assert content(spark.read.parquet(table.path)) == expected  # any reader
    assert {r["batch"] for r in table.read().collect()} == {"0", "1"}


def test_a_batch_counts_once(spark, table):
    rows = batch(spark, (1, "a", 1.0, "x"))
    assert table.append(rows, "s/1 ä") and not table.append(rows, "s/1 ä")
    assert not table.append(batch(spark, (9, "other", 1.0, "rows")), "s/1 ä")
    assert content(table.read()) == [(1, "a", 1.0, "x")] and table.commits() == {1: "s/1 ä"}


def test_empty_batches_are_known(spark, table):
    empty = batch(spark, (1, "a", 1.0, "x")).limit(0)
    assert table.append(empty, 7) and not table.append(empty, 7)
    assert table.read().collect() == []
    assert table.append(batch(spark, (1, "a", 1.0, "x")), 8) and table.read().count() == 1


def test_failures_leave_nothing(spark, table):
    def fail():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        table.append(batch(spark, (1, "a", 1.0, "x")), 0, before_commit=fail)
    broken = batch(spark, (1, "a", 1.0, "x")).withColumn("note", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        table.append(broken, 0)
    assert table.read().collect() == []
    table.sweep()
    assert table.append(batch(spark, (1, "a", 1.0, "again")), 0) and content(table.read()) == [(1, "a", 1.0, "again")]


def test_writers_at_once(spark, table):
    """Both have written before either commits: the second sees the first's keys after all."""
    meet, errors = threading.Barrier(2, timeout=60), []

    def write(name, first):
        waited = []

        def wait():
            if not waited:
                waited.append(1)
                meet.wait()

        try:
            own = KeyedTable(spark, table.path, SCHEMA, ["id", "kind"], ["at"], buckets=4)
            assert own.append(batch(spark, *[(i, "k", 1.0, name) for i in range(first, first + 20)]), name, before_commit=wait)
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=write, args=a) for a in (("one", 0), ("two", 10))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    found = table.read()
    assert sorted(r["id"] for r in found.collect()) == list(range(30)) and sorted(table.commits().values()) == ["one", "two"]


def test_only_buckets_of_the_batch_are_read(spark, table):
    table.append(batch(spark, *[(i, "k", 1.0, "x") for i in range(100)]), 0)
    known = table.read().where(F.col("bucket").isin([1]))
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert 0 < len(known.inputFiles()) and known.count() < 100


def test_own_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="own"):
        KeyedTable(spark, str(tmp_path), "id long, bucket int", ["id"])

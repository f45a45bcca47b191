"""Running numbers in pieces against plain loops, for any size of the pieces."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from auditspark.operators import patches, segments


@pytest.mark.parametrize("piece", [1, 3, 7, 1000])
def test_counters(spark, piece):
    rng = random.Random(piece)
    rows = [(key, pos, rng.randrange(100) if rng.random() < 0.15 else None, rng.randrange(3)) for key, n in ((1, 60), (2, 1), (None, 25), (3, 14)) for pos in range(n)]
    expected = []
    value: dict = {}
    for key, pos, reset, step in rows:
        value[key] = reset if reset is not None else value.get(key, 0)
        expected.append((key, pos, value[key]))
        value[key] += 0 if reset is not None else step
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key long, pos long, reset long, step long")
    found = segments.counters(df, ["key"], "pos", F.col("reset"), F.col("step"), piece)
    assert found.columns == ["key", "pos", "reset", "step", "value"]
    assert sorted(((r["key"], r["pos"], r["value"]) for r in found.collect()), key=repr) == sorted(expected, key=repr)


def test_positions_of_a_hot_key(spark):
    """A key with most rows is spread over ranges, and still counted in order."""
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.7 else rng.choice([2, 3, None]), rng.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, at long, id long").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        found = segments.positions(df, ["key"], ["at", "id"])
        ranged = df.repartitionByRange("key", "at", "id").groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("key") == 1).alias("n"))
        assert sum(r["n"] > 0 for r in ranged.collect()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by: dict = {}
    for key, at, i in rows:
        by.setdefault(key, []).append((at, i))
    expected = {i: n for own in by.values() for n, (_, i) in enumerate(sorted(own))}
    assert {r["id"]: r["n"] for r in found.collect()} == expected


def plain(patch):
    number, out = 0, []
    for pos, line in enumerate(patch.split("\n")):
        if m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line):
            number = int(m[1])
            out.append((pos, number))
        else:
            out.append((pos, number))
            number += not line.startswith("-")
    return out


@pytest.mark.parametrize("piece", [2, 5, segments.PIECE])
def test_patches_in_pieces(spark, piece):
    rng = random.Random(9)
    texts = []
    for i in range(6):
        lines = ["diff --git a b"] * rng.randint(0, 2)
        for _ in range(rng.randint(0, 12)):
            start = rng.randrange(500)
            lines += [f"@@ -{start},9 +{start},9 @@ x"] + [rng.choice("+- ") + f"line {rng.randrange(9)}" for _ in range(rng.randint(0, 9))]
        texts.append((i, "\n".join(lines or ["x"])))
    df = spark.createDataFrame(texts, "patch_id long, patch string")
    found = patches.patch_lines(df, piece)
    assert sorted((r["patch_id"], r["pos"], r["number"]) for r in found.collect()) == sorted((i, p, n) for i, t in texts for p, n in plain(t))
    lines = spark.createDataFrame([(i, p, x) for i, t in texts for p, x in enumerate(t.split("\n"))], "patch_id long, pos long, line string")
    assert sorted(map(tuple, patches.added_lines(lines).collect())) == sorted(map(tuple, patches.added_lines(df).collect()))

"""Findings from outside: filters by hand, answers as variants."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditspark.operators import external


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("code", "risky"),
    [
        ("os.getenv('A')", False), ("os.getenv('A', 'dev')", False), ("os.getenv('A', 'my-password-1')", True), ("os.getenv('A', 'abcdef')", False), ("os.getenv('A', 'abcdefgh')", True),
        ("os.getenv('A', 'with space here')", False), ('f("a", "0.0.0.0") + g(1, "supersecret" )', False), ("os.getenv('A', \"postgresql://\")", False), ("", False),
    ],
)
def test_risky_defaults(spark, code, risky):
    assert value(spark, external.risky_default(F.lit(code))) is risky


def test_settings(spark):
    rows = [("x = os.getenv('A')", "", True), ("x = os.getenv('A', 'my-token-1')", "", False), ("class S(BaseSettings):", "", True), ("class Settings:", "", True), ("class A:", "Settings", True), ("Settings()", "", False), ("x = 1", "os.environ['A']", True), ("x = 1", "", False)]
    for line, before, expected in rows:
        assert value(spark, external.is_settings(F.lit(line), F.lit(before))) is expected, line


def test_accepted(spark):
    schema = "id long, severity string, category string, issue string, suggestion string, before_code string, line_text string"
    good = "A long enough suggestion for the score"
    rows = [
        (1, "Critical", "Injection", "SQL injection by string building", good, "q", "execute(q + x)"), (2, "Critical", "Styling", "SQL injection by string building", good, "q", "execute(q + x)"),
        (3, None, None, "SQL injection by string building", good, None, None), (4, "High", "", "SQL injection by string building", None, None, "x"), (5, "Medium", "Security", "SQL injection by string building", good, None, "x"),
        (6, "Critical", "Secrets", "Information disclosure by print", good, None, "print(x)"), (7, "High", "Secrets", "short", good, None, "x"),
    ]
    found = {r["id"]: r for r in external.accepted(spark.createDataFrame(rows, schema), F.col("line_text")).collect()}
    assert set(found) == {1, 4, 5}
    assert found[4]["suggestion"] == "Please verify and secure this code." and found[4]["category"] == "" and found[4]["before_code"] == ""


def test_variants(spark):
    rows = [
        (1, '[{"file": "a", "x": [1, {"y": 2}]}, {"file": "b"}]'), (2, 'Sure:\n```json\n{"file": "c"}\n```\nDone [1].'), (3, 'Found [ {"file": "d"} ] here'), (4, 'It is {"line": 1, "file": "e"} and {"file": "f", "n": {"m": 1}}'),
        (5, "no json"), (6, None), (7, "[]"), (8, "[1, \"two\"]"), (9, "7"), (10, '[{"file": "g"}'),
    ]
    found = external.variants_from_text(spark.createDataFrame(rows, "id long, answer string"), "answer")
    shown = sorted((r["id"], r["pos"], r["v"]) for r in found.select("id", "pos", F.to_json("value").alias("v")).collect())
    assert shown == [(1, 0, '{"file":"a","x":[1,{"y":2}]}'), (1, 1, '{"file":"b"}'), (2, 0, '{"file":"c"}'), (3, 0, '{"file":"d"}'), (4, 0, '{"file":"f","n":{"m":1}}'), (8, 0, "1"), (8, 1, '"two"'), (10, 0, '{"file":"g"}')]


def test_recommendations(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5), (0, None, 1, 0, 2), (0, 0, 0, 0, 0)], "critical long, high long, vulnerable long, quality long, outdated long")
    assert [r[0] for r in df.select(external.recommendations()).collect()] == [
        ["Fix 1 critical security issue(s) first", "Review 2 high-severity security finding(s)", "Update 3 vulnerable dependenc(y/ies)", "Refactor 4 code quality issue(s)"],
        ["Update 1 vulnerable dependenc(y/ies)", "Update 2 outdated dependenc(y/ies)"],
        [],
    ]

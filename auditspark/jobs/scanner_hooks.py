"""Scanners in Python over the given documents and conversations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.operators import scanners
from auditspark.sources.adapters import files, sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
REGISTRY = scanners.Registry()
LONG = 300


@REGISTRY.register("brackets")
def brackets(path: str, content: str) -> Iterator[tuple]:
    """The first line after which more round brackets have been closed than opened."""
    depth = 0
    for number, line in enumerate(content.split("\n"), 1):
        depth += line.count("(") - line.count(")")
        if depth < 0:
            yield number, "Low", "More brackets closed than opened", "Code Smell"
            return


@REGISTRY.register("long_line")
def long_line(path: str, content: str) -> Iterator[tuple]:
    for number, line in enumerate(content.split("\n"), 1):
        if len(line) > LONG:
            yield scanners.Finding(number, "Info", f"Line of {len(line)} characters", "Code Smell", suggestion="Break the line.")


@REGISTRY.register("first_number")
def first_number(path: str, content: str) -> list[tuple]:
    """The first number, where it is at least 100; fails on texts without one."""
    found = re.search("[0-9]+", content)
    if found is None:
        raise ValueError("no number in " + path)
    value = found.group()
    return [(content[: found.start()].count("\n") + 1, "Medium", "Number " + value, "Code Smell")] if len(value.lstrip("0")) >= 3 else []


def scanner_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings and failures of all scanners on each document."""
    own = files(spark, d).select("repo", "file_id", "path", "content")
    return scanners.scan(own, REGISTRY).drop("why_it_matters", "risk_level", "before_code", "after_code", "cwe")


def scanner_failures(spark: SparkSession, d: str) -> DataFrame:
    """How often each scanner fails on the turns of conversations, read by SQL through the registered table function."""
    turns = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.col("text").alias("content"))
    REGISTRY.register_sql(spark, "scan_text")
    return scanners.failures(spark.sql("SELECT t.path, s.* FROM {turns} t, LATERAL scan_text(t.path, t.content) s", turns=turns))


QUERIES = {f.__name__: f for f in (scanner_findings, scanner_failures)}
_LINES = """, l AS (SELECT repo, file_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files),
depth AS (SELECT *, sum(len(line) - len(replace(line, '(', '')) - len(line) + len(replace(line, ')', ''))) OVER (PARTITION BY file_id ORDER BY n) AS depth FROM l),
number AS (SELECT repo, file_id, path, content, regexp_extract(content, '[0-9]+') AS v FROM files)"""
ORACLE = {
    "scanner_findings": sql(_LINES + f""", f AS (
SELECT repo, file_id, path, 'brackets' AS scanner, min(n) AS line, 'Low' AS severity, 'More brackets closed than opened' AS issue, '' AS suggestion FROM depth WHERE depth < 0 GROUP BY ALL
UNION ALL SELECT repo, file_id, path, 'long_line', n, 'Info', 'Line of ' || length(line) || ' characters', 'Break the line.' FROM l WHERE length(line) > {LONG}
UNION ALL SELECT repo, file_id, path, 'first_number', len(string_split(content[:strpos(content, v)], chr(10))), 'Medium', 'Number ' || v, '' FROM number WHERE length(ltrim(v, '0')) >= 3)
SELECT repo, file_id, path, scanner, CAST(line AS INTEGER) AS line, severity, issue, 'Code Smell' AS category, 'Other' AS vulnerability_type, suggestion, NULL AS error FROM f
UNION ALL SELECT repo, file_id, path, 'first_number', NULL, NULL, NULL, NULL, NULL, NULL, 'ValueError: no number in ' || path FROM number WHERE v = ''"""),
    "scanner_failures": "SELECT 'first_number' AS scanner, 'ValueError' AS error, count(*) AS texts FROM conversations WHERE NOT regexp_matches(coalesce(text, ''), '[0-9]') HAVING count(*) > 0",
}

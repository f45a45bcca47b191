"""Scanners in Python: each failure is one row, and everything else stays."""

from __future__ import annotations

import pytest

from auditspark.operators.scanners import Finding, Registry, failures, scan


@pytest.fixture
def registry():
    own = Registry()

    @own.register("todo")
    def todo(path, content):
        return [Finding(k, "Low", "TODO", suggestion="Do it.") for k, line in enumerate(content.split("\n"), 1) if "TODO" in line]

    @own.register("half")
    def half(path, content):
        yield 1, "High", "seen before the failure"
        if "boom" in content:
            raise RuntimeError("x" * 900)

    own.register("odd", lambda path, content: [(1, "Severe", "no such severity")] if content == "odd" else [("one", "Low", "no line")] if content == "line" else [])
    return own


FILES = [("r", 1, "a.py", "ok\nTODO one\nTODO two"), ("r", 2, "b.py", "boom TODO"), ("s", 3, "c.py", "odd"), ("s", 4, "d.py", "line"), ("s", 5, None, None)]


def rows(df):
    return sorted(((r["file_id"], r["scanner"], r["line"], r["issue"]) for r in df.collect()), key=repr)


def test_failure_of_one_scanner_on_one_text(spark, registry):
    files = spark.createDataFrame(FILES, "repo string, file_id long, path string, content string")
    found = scan(files, registry)
    assert found.columns[:4] == ["repo", "file_id", "path", "scanner"]
    good = rows(found.where("error IS NULL"))
    assert good == sorted([(1, "todo", 2, "TODO"), (1, "todo", 3, "TODO"), (2, "todo", 1, "TODO"), *((i, "half", 1, "seen before the failure") for i in (1, 3, 4, 5))], key=repr)
    bad = {(r["file_id"], r["scanner"]): r for r in found.where("error IS NOT NULL").collect()}
    assert set(bad) == {(2, "half"), (3, "odd"), (4, "odd")}
    assert bad[2, "half"]["error"].startswith("RuntimeError: xxx") and len(bad[2, "half"]["error"]) == 500
    assert bad[3, "odd"]["line"] is None and "Severe" in bad[3, "odd"]["error"]
    assert sorted((r["scanner"], r["error"], r["texts"]) for r in failures(found).collect()) == [("half", "RuntimeError", 1), ("odd", "ValueError", 2)]


def test_whole_finding(spark, registry):
    files = spark.createDataFrame(FILES[:1], "repo string, file_id long, path string, content string")
    first = scan(files, registry).where("scanner = 'todo'").orderBy("line").first()
    assert (first["why_it_matters"], first["risk_level"], first["suggestion"], first["category"], first["vulnerability_type"]) == ("TODO", "Low", "Do it.", "Security", "Other")


def test_sql(spark, registry):
    spark.createDataFrame(FILES, "repo string, file_id long, path string, content string").createOrReplaceTempView("some_files")
    registry.register_sql(spark, "scan_some")
    found = spark.sql("SELECT f.file_id, s.scanner, s.line, s.issue FROM some_files f, LATERAL scan_some(f.path, f.content) s WHERE s.error IS NULL")
    assert len(rows(found)) == 7


def test_names_stand_once(registry):
    with pytest.raises(ValueError, match="registered"):
        registry.register("todo", lambda path, content: [])


def test_no_scanners_and_no_files(spark, registry):
    files = spark.createDataFrame(FILES, "repo string, file_id long, path string, content string")
    assert scan(files, Registry()).collect() == [] and scan(files.limit(0), registry).collect() == []

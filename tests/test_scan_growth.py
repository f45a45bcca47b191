"""Scans read each text once, whatever the number of rules, and long texts in time proportional to their length."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from auditspark.functions import text
from auditspark.jobs import outside, scans, whole_findings
from auditspark.operators import patches, rules, sections
from auditspark.sources.repos import repo_files

FILES = "repo long, file_id long, path string, content string"


def reads(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("query", [scans.scan_findings, scans.averaged_scores, scans.patch_findings, scans.pr_review, outside.commit_findings, whole_findings.whole_findings, whole_findings.whole_csv])
def test_one_pass(spark, sf_dir, query):
    """The table is read once, and its rows are sent once, to their file."""
    df = query(spark, sf_dir)
    assert reads(df) == 1
    shuffles = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles <= (2 if query is scans.averaged_scores else 1)  # means by repository are sent too


def test_pr_scan_reads_two_sides(spark, sf_dir):
    assert reads(scans.pr_scan(spark, sf_dir)) == 2


def test_long_functions_of_a_long_file(spark):
    """Thousands of lines in one function, and thousands of functions: lines are looked at a bounded number of times."""
    long = "def first():\n" + "    x = 1\n" * 20_000 + "y = 2\n"
    many = "".join(f"def f{i}():\n    return {i}\n" for i in range(10_000)) + "def last():\n" + "    x = 1\n\n" * 60
    files = spark.createDataFrame([(1, 1, "a.py", long), (1, 2, "b.py", many), (1, 3, "c.md", long)], FILES)
    began = time.time()
    found = sorted(tuple(r) for r in rules.long_functions(files).select("file_id", "line", "name", "length", "severity").collect())
    assert found == [(1, 1, "first", 20_000, "High"), (2, 20_001, "last", 120, "High")]
    assert time.time() - began < 60


@pytest.mark.parametrize("seed", range(3))
def test_repeated_blocks(spark, seed):
    rng = random.Random(seed)
    texts = [(1, i, "a.py", "\n".join(rng.choices(["a", "b", " c", "# n", "", "d"], k=rng.randint(0, 30)))) for i in range(40)]
    found = {(r["file_id"], r["line_no"], r["n"]) for r in scans.clones.repeated_blocks(spark.createDataFrame(texts, FILES)).collect()}
    expected = set()
    for _, i, _, t in texts:
        code = [(k, x.strip()) for k, x in enumerate(t.splitlines(), 1) if x.strip() and not x.strip().startswith("#")]
        at: dict = {}
        for k in range(len(code) - 2):
            at.setdefault(tuple(x for _, x in code[k : k + 3]), []).append(code[k][0])
        if len(t.splitlines()) >= 6:
            expected |= {(i, *x) for x in sorted((p[0], len(p)) for p in at.values() if len(p) > 1)[:3]}
    assert found == expected


def test_needles_are_in_every_match():
    """Matches of the patterns in made-up texts have one of the needles."""
    assert text.needles(r"(?i)(?:os|sub)\.run\s*\(x+|Eval") == (".run", "eval") and text.needles(r"(?i)a?b*") == () and text.needles(r"(?i)x|\d") == ()
    rng, found = random.Random(1), 0
    patterns = [r.pattern for r in [*rules.RULES, *rules.LOOKING]] + ["(?i)" + p for p, *_ in rules.SECRETS]
    words = sorted({w for p in patterns for n in text.needles(p) for w in (n, n.upper())}) + ["(", "= ", "'abcdefghijklmnopq'", "url=", "+", "shell=True", "\n", ": ", "://a:b@", "{x}}}", "$", "`", "verify=False", "user", "jwt", "token", "_key", "os.", "alg"]
    for _ in range(3000):
        t = "".join(rng.choices(words, k=rng.randint(1, 7)))
        for p in patterns:
            if re.search(p, t, re.ASCII):
                found += 1
                assert not text.needles(p) or any(n in t.lower() for n in text.needles(p)), (p, t)
    assert found > 3000


def test_same_line_and_issue_counts_once_by_the_first_rule(spark):
    own = [rules.Rule("a", "(?i)x+", "High", "1", "same words"), rules.Rule("b", "(?i)xy", "Low", "2", "same words"), rules.Rule("c", "(?i)y", "Low", "3", "other")]
    files = spark.createDataFrame([(1, 1, "p", "xy x\ny\nXy"), (1, 2, "p", "z"), (1, 3, "p", "\x01y")], FILES)
    found = sorted((r["file_id"], r["line"], r["name"], r["severity"], r["cwe"]) for r in rules.pattern_findings(files, own).collect())
    assert found == [(1, 1, "a", "High", "1"), (1, 1, "c", "Low", "3"), (1, 2, "c", "Low", "3"), (1, 3, "a", "High", "1"), (1, 3, "c", "Low", "3"), (3, 1, "c", "Low", "3")]


def test_lines_with_odd_ends(spark):
    texts = ["", "a", " a \n", " \t a\u2003", "\u2003 \ta \tb\t", " \u00a0 x", "\t \t", "\ta\r\nb \r\n", "a\x0b b  c\x85", " ", "\r", "é x é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", text.lined(F.col("t")).alias("l")).collect()
    for r in rows:
        own = texts[r["i"]].splitlines()
        assert [(x["no"], x["line"], x["s"], x["indent"]) for x in r["l"]] == [(k, x, x.strip(), len(x) - len(x.lstrip())) for k, x in enumerate(own, 1)]


def test_findings_on_lines_of_patches(spark):
    """Findings of a patch that adds nothing stay, whether patches are texts or lines."""
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 7, "d"), (3, 5, "e"), (4, 1, "f")], "patch_id long, line int, issue string")
    made = [(1, "@@ -1,1 +2,1 @@\n+new\n-old\n same\n@@ -9,1 +9,1 @@\n+x"), (2, "@@ -1,1 +1,1 @@\n same"), (4, "@@ -1,1 +3,1 @@\n+z")]
    expected = [(1, 2, "b"), (1, 2, "c"), (2, 7, "d"), (3, 5, "e")]
    texts = spark.createDataFrame(made, "patch_id long, patch string")
    lines = spark.createDataFrame([(i, p, x) for i, t in made for p, x in enumerate(t.split("\n"))], "patch_id long, pos long, line string")
    for own in (texts, lines):
        assert sorted(tuple(r) for r in patches.on_modified_lines(found, own).select("patch_id", "line", "issue").collect()) == expected


def test_parts_are_spread_over_all_cores(spark, tmp_path):
    """A part of a few bytes makes a whole file: small tables of parts are not left to one task."""
    spark.range(4000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = repo_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({spark.sparkContext.defaultParallelism})" in plan


def test_report_sends_findings_once(spark):
    """What each finding says is made where it stands: no text of a report is shuffled."""
    findings = spark.createDataFrame([(1, f"{k:02}", "a.py", k, "High", "Security", "i", "s", None, None, None, None) for k in range(5)], "analysis_id long, ord string, file string, line int, severity string, category string, issue string, suggestion string, risk_level string, why_it_matters string, before_code string, after_code string")
    plan = sections.of_findings(findings.repartition("analysis_id", "file"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and sections.of_findings(findings).count() == 5 * 2 + 3

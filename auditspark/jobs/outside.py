"""Queries over findings and texts from outside, and over layouts of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.operators import complexity, external, patches, rules
from auditspark.jobs.changes import patch_table
from auditspark.jobs.code_audit import numbered
from auditspark.sources.adapters import files, findings, sql, table
from auditspark.sources.code import CTE as CODE


def security_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of the findings as if reported from outside: the issue's words and the line by its numbers."""
    own = findings(spark, d)
    issue = F.when(F.col("line") % 3 == 0, F.concat(F.lit("Hardcoded secret in "), "file")).otherwise(F.col("issue"))
    line = F.when(F.col("line") % 2 == 0, "x = os.getenv('A')").otherwise("y = 1")
    advice = F.when(F.col("line") % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Move the value out of the source, see "), "file"))
    return own.select("analysis_id", "ord", F.round(external.security_confidence(issue, advice, F.col("severity"), line, F.lit("")), 2).alias("confidence"))


def smell_confidence(spark: SparkSession, d: str) -> DataFrame:
    own = findings(spark, d)
    issue = F.when(F.col("line") % 3 == 0, F.concat(F.lit("Long Function in "), "file")).when(F.col("line") % 3 == 1, "Line too long here").otherwise(F.col("issue"))
    return own.select("analysis_id", "ord", F.round(external.smell_confidence(issue, F.lit("short"), F.col("severity")), 2).alias("confidence"))


def findings_from_answers(spark: SparkSession, d: str) -> DataFrame:
    """Findings read back from answers that hold each order's items as JSON, fenced, within prose, or broken."""
    item = F.to_json(F.struct(F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file"), F.col("l_linenumber").alias("line")))
    made = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("items"))
    plain, kind = F.concat(F.lit("["), "items", F.lit("]")), F.col("id") % 4
    answer = F.when(kind == 0, plain).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), plain, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("I found "), plain, F.lit(" in all."))).otherwise("no findings")
    return made.select("id", F.explode(external.findings_from_text(answer, "struct<file:string,line:int>")).alias("f")).select("id", "f.*")


def batch_packing(spark: SparkSession, d: str) -> DataFrame:
    return external.pack(external.chunks(files(spark, d), 3), "file_id", 4, 2000)


def layers(spark: SparkSession, d: str) -> DataFrame:
    return external.layers(numbered(spark, d).select("repo", "path"))


def commit_rules(spark: SparkSession, d: str) -> DataFrame:
    """The unsafe_eval rules on the added lines of patches (``commit_findings`` has all); a patch's line is a line of the derived source."""
    lines = numbered(spark, d).select(F.col("repo").alias("patch_id"), "file_id", "line_no", "line")
    patch = F.concat(F.lit("@@ -1,1 +1,1 @@\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(F.lit("+"), x["line"])), "\n"))
    made = lines.groupBy(F.col("file_id").alias("patch_id")).agg(patch.alias("patch"))
    added = patches.added_lines(made).groupBy("patch_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), "\n").alias("content"))
    own = added.select((F.col("patch_id") % 50).alias("repo"), F.col("patch_id").alias("file_id"), F.lit("patch").alias("path"), "content")
    return rules.pattern_findings(own, [r for r in rules.RULES if r.name == "unsafe_eval"]).drop("path")


def added_text(spark: SparkSession, d: str) -> DataFrame:
    """The added lines of patches as texts with their files' paths; a patch's line is a line of the derived source."""
    lines = numbered(spark, d).select("repo", "file_id", "path", "line_no", "line")
    patch = F.concat(F.lit("@@ -1,1 +1,1 @@\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(F.lit("+"), x["line"])), "\n"))
    made = lines.groupBy("repo", "file_id", "path").agg(patch.alias("patch"))
    added = made.select("repo", "file_id", "path", F.explode(F.array(patches.added_in(F.col("patch")))).alias("added")).where(F.size("added") > 0)
    return added.select("repo", "file_id", "path", F.array_join(F.transform(F.sort_array("added"), lambda x: x["text"]), "\n").alias("content"))


def commit_findings(spark: SparkSession, d: str) -> DataFrame:
    """Security rules and smells on the added lines of patches."""
    return rules.scan(added_text(spark, d))


def commit_impact(spark: SparkSession, d: str) -> DataFrame:
    return rules.impact(commit_findings(spark, d))


def commit_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Functions of the added lines of Python files."""
    return complexity.python_complexity(added_text(spark, d).where(F.col("path").endswith(".py")))


def patch_sizes(spark: SparkSession, d: str) -> DataFrame:
    return patches.added_lines(patch_table(spark, d)).groupBy("patch_id").agg(F.count(F.lit(1)).alias("added"), F.min("number").alias("first"), F.max("number").alias("last"))


QUERIES = {f.__name__: f for f in (security_confidence, smell_confidence, findings_from_answers, batch_packing, layers, commit_rules, commit_findings, commit_impact, commit_complexity, patch_sizes)}
_GRADE = "greatest(0.0, CASE severity WHEN 'Critical' THEN {0} WHEN 'High' THEN {1} WHEN 'Medium' THEN {2} WHEN 'Low' THEN {3} ELSE 0.30 END"
ORACLE = {
    "security_confidence": sql(" SELECT analysis_id, ord, round(CASE WHEN line % 6 = 0 THEN 0.0 ELSE " + _GRADE.format("0.95", "0.85", "0.75", "0.60") + " - CASE WHEN line % 3 = 0 THEN 0 ELSE 0.15 END - CASE WHEN line % 5 = 0 THEN 0.10 ELSE 0 END) END, 2)::DOUBLE AS confidence FROM findings"),
    "smell_confidence": sql(" SELECT analysis_id, ord, round(CASE line % 3 WHEN 1 THEN 0.0 WHEN 2 THEN 0.3 ELSE " + _GRADE.format("0.90", "0.85", "0.75", "0.55") + " - 0.10) END, 2)::DOUBLE AS confidence FROM findings"),
    "findings_from_answers": "SELECT l_orderkey AS id, 'f' || l_partkey AS file, l_linenumber AS line FROM lineitem WHERE l_orderkey % 4 < 3",
    "batch_packing": sql(r""", split AS (SELECT repo, file_id, CASE WHEN content[-1:] = chr(10) THEN string_split(content[:-2], chr(10)) WHEN content = '' THEN [] ELSE string_split(content, chr(10)) END AS ls FROM files),
u AS (SELECT repo, file_id, k AS chunk, length(array_to_string(ls[3 * k - 2:3 * k], chr(10))) AS chars FROM (SELECT *, unnest(range(1, greatest(1, (len(ls) + 2) // 3) + 1)) AS k FROM split)),
r AS (SELECT repo, file_id, chunk, chars, 0 AS batch, chars > 2000 AS big, CASE WHEN chars > 2000 THEN 0 ELSE 1 END AS n, CASE WHEN chars > 2000 THEN 0 ELSE chars END AS total FROM u WHERE chunk = 1
UNION ALL SELECT repo, file_id, chunk, chars, b + CAST(f AS INTEGER), big, CASE WHEN big THEN 0 WHEN f THEN 1 ELSE n + 1 END, CASE WHEN big THEN 0 WHEN f THEN chars ELSE total + chars END FROM (
  SELECT u.repo, u.file_id, u.chunk, u.chars, r.batch + CAST(r.big AS INTEGER) AS b, r.n, r.total, u.chars > 2000 AS big, r.n > 0 AND (r.n >= 4 OR r.total + u.chars > 2000 OR u.chars > 2000) AS f FROM r JOIN u ON u.repo = r.repo AND u.file_id = r.file_id AND u.chunk = r.chunk + 1))
SELECT repo, file_id, CAST(chunk AS INTEGER) AS chunk, CAST(chars AS INTEGER) AS chars, CAST(batch AS INTEGER) AS batch FROM r""").replace("WITH ", "WITH RECURSIVE ", 1),
    "layers": f"WITH {CODE}, t AS (SELECT DISTINCT repo, split_part(path, '/', 1) AS dir FROM code_files), m(dir, layer) AS (VALUES ('core', 'services/domain'), ('services', 'services/domain'), ('web', 'frontend/ui'), ('tools', 'scripts/tooling')) SELECT repo, layer, string_agg(dir, ',' ORDER BY dir) AS evidence FROM t JOIN m USING (dir) GROUP BY ALL",
    "patch_sizes": """WITH e AS (SELECT user_id AS patch_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
s AS (SELECT patch_id, event_type, CAST(n // 15 * 60 + 10 + coalesce(count(*) FILTER (event_type <> 'error') OVER (PARTITION BY patch_id, n // 15 ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS number FROM e)
SELECT patch_id, count(*) AS added, min(number) AS first, max(number) AS last FROM s WHERE event_type IN ('click', 'view') GROUP BY patch_id""",
    "commit_rules": f"""WITH {CODE}, h AS (SELECT repo, file_id, line_no AS line, line AS t FROM numbered)
SELECT repo, file_id, line, 'unsafe_eval' AS name, 'Critical' AS severity, 'CWE-95' AS cwe, CASE WHEN regexp_matches(t, '\\beval\\s*\\(') THEN 'eval()' ELSE 'exec() (Python/JS)' END AS issue FROM h WHERE regexp_matches(t, '\\b(eval|exec)\\s*\\(')""",
}

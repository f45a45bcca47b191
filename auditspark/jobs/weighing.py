"""Findings from outside weighed and filtered, recommendations, isolated insights, checks of fixes, answers as variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.operators import external, reports, service
from auditspark.sources.adapters import findings, sql, table
from auditspark.sources.repos import CTE as REPOS
from auditspark.sources.repos import repo_files
from auditspark.sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


def picked(n: Column, *texts: str | None) -> Column:
    return F.get(F.array(*[F.lit(t).cast("string") for t in texts]), (n % len(texts)).cast("int"))


@query(sql(""", f AS (SELECT *, analysis_id % 7 AS m, line % 3 = 0 AS secret, CASE WHEN line % 4 = 0 THEN 0.10 ELSE 0.0 END AS vague,
  CASE severity WHEN 'Critical' THEN 0.95 WHEN 'High' THEN 0.85 WHEN 'Medium' THEN 0.75 WHEN 'Low' THEN 0.60 ELSE 0.30 END AS base, ([ 'Security', 'Injection', NULL, 'Performance', 'Secrets'])[analysis_id % 5 + 1] AS c FROM findings)
SELECT analysis_id, ord, severity, coalesce(c, 'Security') AS category, CASE WHEN secret THEN 'Hardcoded secret in module ' || file ELSE 'SQL injection through string building in ' || file END AS issue,
  CASE WHEN line % 4 = 0 THEN 'short' ELSE 'Move the value out of the source, see ' || file END AS suggestion, CASE WHEN line % 5 = 0 THEN 'settings.value' ELSE '' END AS before_code
FROM f WHERE NOT (secret AND (m IN (0, 1, 2, 5, 6) OR line % 5 = 0)) AND coalesce(c, '') <> 'Performance' AND round(base - vague, 6) >= 0.75 AND m NOT IN (0, 2, 3, 5)"""))
def accepted_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings as if reported from outside, on lines that read the environment, declare settings or do neither."""
    own, n = findings(spark, d), F.col("analysis_id")
    lines = ("x = os.getenv('A')", "x = os.getenv('K', 'my-secret-token')", "class AppSettings(BaseSettings):", "class Settings:", "y = 1", "v = os.environ.get('MODE', 'development')", "k = os.getenv('K', 'Abcdef123456')")
    issue = F.when(F.col("line") % 3 == 0, F.concat(F.lit("Hardcoded secret in module "), "file")).otherwise(F.concat(F.lit("SQL injection through string building in "), "file"))
    suggestion = F.when(F.col("line") % 4 == 0, "short").otherwise(F.concat(F.lit("Move the value out of the source, see "), "file"))
    given = own.select("analysis_id", "ord", "severity", picked(n % 5, "Security", "Injection", None, "Performance", "Secrets").alias("category"), issue.alias("issue"), suggestion.alias("suggestion"), F.when(F.col("line") % 5 == 0, "settings.value").alias("before_code"))
    return external.accepted(given, picked(n % 7, *lines))


@query(sql(""", f AS (SELECT *, analysis_id % 4 AS m, line % 4 AS k, CASE severity WHEN 'Critical' THEN 0.90 WHEN 'High' THEN 0.85 WHEN 'Medium' THEN 0.75 WHEN 'Low' THEN 0.55 ELSE 0.30 END AS base FROM findings)
SELECT analysis_id, ord, CASE WHEN k = m AND k < 3 THEN 0.0 ELSE base END::DOUBLE AS confidence FROM f"""))
def smells_by_line(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of smells from outside, where the line tells that some are made up."""
    own = findings(spark, d)
    issue = picked(F.col("line") % 4, "Too many import lines in a long function", "Dead code behind a comment", "Dead code in error handling", "Deep nesting of loops here")
    line = picked(F.col("analysis_id") % 4, "import os", "x = 1  # TODO later", "load_dotenv()", "x = 1")
    sure = external.smell_confidence(issue, F.lit("Split the code into smaller functions now"), F.col("severity"), line)
    return own.select("analysis_id", "ord", F.round(sure, 2).alias("confidence"))


@query(sql(""", n AS (SELECT analysis_id, count(*) FILTER (category = 'security' AND severity = 'Critical') AS critical, count(*) FILTER (category = 'security' AND severity = 'High') AS high, count(*) FILTER (category = 'code_smell') AS quality FROM findings GROUP BY ALL),
r AS (SELECT analysis_id, 1 AS k, 'Fix ' || critical || ' critical security issue(s) first' AS t FROM n WHERE critical > 0 UNION ALL SELECT analysis_id, 2, 'Review ' || high || ' high-severity security finding(s)' FROM n WHERE high > 0
UNION ALL SELECT analysis_id, 3, 'Update ' || analysis_id % 3 || ' vulnerable dependenc(y/ies)' FROM n WHERE analysis_id % 3 > 0 UNION ALL SELECT analysis_id, 4, 'Refactor ' || quality || ' code quality issue(s)' FROM n WHERE quality > 0
UNION ALL SELECT analysis_id, 5, 'Update ' || analysis_id % 4 || ' outdated dependenc(y/ies)' FROM n WHERE analysis_id % 4 > 0)
SELECT analysis_id, coalesce(string_agg(t, ' | ' ORDER BY k), '') AS recommendations FROM n LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY k) <= 4) USING (analysis_id) GROUP BY analysis_id"""))
def scan_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """What to do first about each scan, from its findings and the state of its dependencies."""
    of = lambda kind, level=None: F.count_if((F.col("category") == kind) & (F.lit(True) if level is None else F.col("severity") == level))
    counts = findings(spark, d).groupBy("analysis_id").agg(of("security", "Critical").alias("critical"), of("security", "High").alias("high"), of("code_smell").alias("quality"))
    known = counts.withColumn("vulnerable", F.col("analysis_id") % 3).withColumn("outdated", F.col("analysis_id") % 4)
    return known.select("analysis_id", F.array_join(external.recommendations(), " | ").alias("recommendations"))


@query("SELECT * FROM (VALUES ('severities', 'completed'), ('files', 'failed'), ('issues', 'completed')) v(name, status)")
def insight_status(spark: SparkSession, d: str) -> DataFrame:
    """Three outputs of the findings, one of which fails: the others are written."""
    own = findings(spark, d)
    broken = own.select(F.when(F.col("line") >= 1, F.raise_error(F.lit("this one fails"))).alias("file"))
    done = reports.run_isolated({"severities": own.groupBy("severity").count(), "files": broken, "issues": own.groupBy("issue").count()}, shared_folder(spark))
    return spark.createDataFrame([(k, v.partition(":")[0]) for k, v in done.items()], "name string, status string")


@query(f"""WITH {REPOS}, b AS (SELECT file_id, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext, content || CASE WHEN file_id % 5 = 0 THEN '}}' ELSE '' END AS code FROM repo_files),
n AS (SELECT *, length(code) - length(replace(code, '{{', '')) - length(code) + length(replace(code, '}}', '')) AS braces, length(code) - length(replace(code, '(', '')) - length(code) + length(replace(code, ')', '')) AS parens FROM b)
SELECT file_id AS id, NOT (message LIKE 'Py%' OR message LIKE 'Un%' OR message LIKE 'Em%') AS ok, message, true AS imports_ok FROM (SELECT file_id, CASE WHEN ext = '.py' THEN CASE WHEN file_id % 5 = 0 THEN 'Python syntax error at line ' || len(string_split(code, chr(10))) ELSE 'Syntax OK' END
  WHEN ext IN ('.js', '.ts', '.jsx', '.tsx') THEN CASE WHEN braces <> 0 THEN 'Unbalanced braces: ' || braces WHEN parens <> 0 THEN 'Unbalanced parentheses: ' || parens ELSE 'Syntax OK (brace/paren balance)' END
  WHEN trim(code, ' ' || chr(10)) = '' THEN 'Empty code' ELSE 'Syntax OK (basic check)' END AS message FROM n WHERE ext <> '')""")
def fix_messages(spark: SparkSession, d: str) -> DataFrame:
    """Files as proposed fixes, some with a brace too many, with what the check says of syntax and imports."""
    own = repo_files(spark, d).where(F.col("path").rlike(r"\.[^./]*$"))
    code = F.concat("content", F.when(F.col("file_id") % 5 == 0, "}").otherwise(""))
    return service.fix_checks(own.select(F.col("file_id").alias("id"), "path", code.alias("code"))).select("id", "ok", "message", "imports_ok")


@query("""SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS pos, 'f' || l_partkey AS file, l_linenumber AS line, CASE WHEN l_linenumber % 2 = 0 THEN 'see [1]{' END AS note, CAST(l_suppkey AS BIGINT) AS second_ref FROM lineitem WHERE l_orderkey % 4 < 3
UNION ALL SELECT DISTINCT l_orderkey, 0, 'single', 1, NULL, CAST(NULL AS BIGINT) FROM lineitem WHERE l_orderkey % 8 = 3""")
def answer_fields(spark: SparkSession, d: str) -> DataFrame:
    """Findings of any shape read from answers: whole, fenced, within prose, single, or none; lists in them are read by path."""
    item = F.to_json(F.struct(F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linenumber") % 2 == 0, "see [1]{").alias("note"), F.array(F.struct(F.array(F.lit(0), F.col("l_suppkey")).alias("refs"))).alias("more")))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("t"))
    made = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["t"]), ",").alias("items"))
    plain, kind = F.concat(F.lit("["), "items", F.lit("]")), F.col("id") % 4
    single = F.when(F.col("id") % 8 == 3, 'so: {"file": "single", "line": 1, "more": []} it is').otherwise("{broken")
    answer = F.when(kind == 0, plain).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), plain, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("I found "), plain, F.lit(" in all."))).otherwise(single)
    rows = external.variants_from_text(made.select("id", answer.alias("answer")), "answer")
    get = lambda path, kind: F.try_variant_get("value", path, kind)
    return rows.select("id", "pos", get("$.file", "string").alias("file"), get("$.line", "int").alias("line"), get("$.note", "string").alias("note"), get("$.more[0].refs[1]", "long").alias("second_ref"))

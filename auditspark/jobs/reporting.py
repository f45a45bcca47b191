"""Queries on health, debt, languages and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.functions import code
from auditspark.jobs.source_text import PATHS, paths
from auditspark.operators import health, reports, sections, service
from auditspark.sources.adapters import analyses, file_of_part, files, findings, repositories, sql, table
from auditspark.sources.code import CTE as CODE
from auditspark.sources.code import code_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None, own: bool = False) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle if own else sql(oracle)
        return f

    return add


@query(PATHS + """, own AS (SELECT s.*, p_size % 8 AS repo, CAST(p_retailprice * 500 AS BIGINT) AS size FROM seen s JOIN part ON p_partkey = file_id),
f AS (SELECT repo, count(*) FILTER (starts_with(name, 'readme')) AS readmes, count(*) FILTER (is_test) AS tests, count(*) FILTER (type = 'source' AND NOT is_test) AS sources, count(*) FILTER (type = 'source' AND NOT is_test AND size > 512000) AS large, count(*) FILTER (type = 'source' AND NOT is_test AND regexp_matches(path, '(?i)\\b(auth|login|password|secret|key|token|db|database|config|credential|jwt|sign|verify)\\b')) AS hotspots FROM own WHERE NOT skip GROUP BY repo)
SELECT repo, readmes, tests, sources, large, hotspots, CAST(greatest(0, 100 - CASE WHEN readmes = 0 THEN 20 ELSE 0 END - CASE WHEN tests = 0 THEN 20 ELSE 0 END - least(15, 5 * large)) AS INTEGER) AS score FROM f""")  # fmt: skip
def repo_health(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), (F.col("p_size") % 8).alias("repo"), (F.col("p_retailprice") * 500).cast("long").alias("size"))
    return health.repository_health(paths(spark, d).join(sizes, "file_id"))


def repo_findings(spark: SparkSession, d: str) -> DataFrame:
    done = analyses(spark, d).where(F.col("status") == "completed").select("analysis_id", F.col("repo_id").alias("repo"))
    return findings(spark, d).join(done, "analysis_id")


DEBT = """, own AS (SELECT f.*, a.repo_id AS repo, CASE WHEN category = 'security' THEN CASE severity WHEN 'Critical' THEN 'security_critical' WHEN 'High' THEN 'security_high' ELSE 'security_other' END
  WHEN category = 'code_smell' AND severity IN ('Critical', 'High') THEN 'code_smell_major' WHEN category = 'code_smell' AND severity = 'Medium' THEN 'code_smell' END AS kind FROM findings f JOIN analyses a USING (analysis_id) WHERE status = 'completed'),
items AS (SELECT repo, kind AS category, CASE WHEN category = 'security' THEN severity WHEN kind = 'code_smell_major' THEN 'High' ELSE 'Medium' END AS severity, count(*) AS n,
  round(count(*) * CASE kind WHEN 'security_critical' THEN 4.0 WHEN 'security_high' THEN 3.0 WHEN 'code_smell_major' THEN 2.0 ELSE 1.0 END, 1)::DOUBLE AS hours, arg_min(file, (analysis_id, ord, file, line)) AS file, arg_min(line, (analysis_id, ord, file, line)) AS line
  FROM own WHERE kind IS NOT NULL GROUP BY repo, kind, 3)"""


@query(DEBT + " SELECT * FROM items")
def debt_items(spark: SparkSession, d: str) -> DataFrame:
    return health.debt_items(repo_findings(spark, d))


@query(DEBT + """ SELECT repo, count(*) AS items, round(sum(hours), 1) AS hours, CAST(greatest(0, 100 - sum(CASE severity WHEN 'Critical' THEN 8 WHEN 'High' THEN 5 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END)) AS INTEGER) AS score,
CAST(min(CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END) AS INTEGER) AS worst FROM items GROUP BY repo""")  # fmt: skip
def debt_summary(spark: SparkSession, d: str) -> DataFrame:
    return health.debt_summary(health.debt_items(repo_findings(spark, d)))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _language_sql(c: str) -> str:
    cases = []
    for name, patterns in code.LANGUAGES:
        test = " OR ".join(f"regexp_matches({c}, {quoted(p)})" for p in patterns)
        if name == "Python":
            test += f" OR (regexp_matches({c}, '#\\s+') AND contains({c}, 'def '))"
        value = f"CASE WHEN {' OR '.join(f'regexp_matches({c}, {quoted(p)})' for p in code.TYPED)} THEN 'TypeScript' ELSE 'JavaScript' END" if name == "Script" else quoted(name)
        cases.append(f"WHEN {test} THEN {value}")
    return f"CASE {' '.join(cases)} ELSE 'Unknown' END"


@query(f"WITH {CODE} SELECT repo, file_id, {_language_sql('content')} AS language FROM code_files", own=True)
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return code_files(spark, d).select("repo", "file_id", code.detect_language(F.col("content")).alias("language"))


@query(f"""WITH {CODE}, t AS (SELECT repo, file_id, trim(content) AS s FROM code_files), n AS (SELECT *, length(regexp_replace(s, '\\P{{L}}', '', 'g')) AS letters,
  CAST(regexp_matches(s, '[{{}}()\\[\\];=<>:]') AS INTEGER) + CAST(regexp_matches(s, '\\b\\w+\\s*=\\s*.+') AS INTEGER) + CAST(regexp_matches(s, '(?m)^\\s*#') AS INTEGER) + CAST(regexp_matches(s, '(?m)^\\s*//') AS INTEGER) AS structure,
  {" + ".join(f"CAST(regexp_matches(s, {quoted('(?i)' + k)}) AS INTEGER)" for k in code.KEYWORDS)} AS words FROM t)
SELECT repo, file_id, length(s) >= 12 AND letters > 0 AND ((words >= 1 AND structure >= 1) OR (structure >= 2 AND letters >= 4)) AS valid FROM n""", own=True)  # fmt: skip
def code_validity(spark: SparkSession, d: str) -> DataFrame:
    return code_files(spark, d).select("repo", "file_id", code.is_valid_code(F.col("content")).alias("valid"))


@query(""", w AS (SELECT repo, file_id, content, list_filter(regexp_split_to_array(lower(content), '[^0-9A-Za-z_]+'), lambda x: x <> '') AS ws, length(regexp_replace(content, '[^{}\\[\\]();=<>_+\\-*/#\\\\$:&|^%]', '', 'g')) / greatest(length(content), 1) AS symbols FROM files)
SELECT repo, count(*) AS files, count(*) FILTER (symbols < 0.025) AS plain FROM w GROUP BY repo""")
def prose_by_repo(spark: SparkSession, d: str) -> DataFrame:
    """Files of a repository, and those with few code symbols."""
    symbols = F.length(F.regexp_replace("content", r"[^{}\[\]();=<>_+\-*/#\\$:&|^%]", "")) / F.greatest(F.length("content"), F.lit(1))
    return files(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.count_if(symbols < 0.025).alias("plain"))


_STRIP = "regexp_replace(t.text, '^[\\s\\x1C-\\x1F\\x{85}\\x{A0}]+|[\\s\\x1C-\\x1F\\x{85}\\x{A0}]+$', '', 'g')"


@query(f"""WITH t AS (SELECT conv_id, turn, CASE turn % 9 WHEN 3 THEN 'https://example.org/' || turn WHEN 5 THEN 'Education, skills and experience at work' WHEN 7 THEN 'def f(x):' || chr(10) || '    return x' ELSE text END AS text FROM conversations),
s AS (SELECT conv_id, turn, {_STRIP} AS s FROM t), l AS (SELECT *, lower(s) AS low, {_language_sql('s')} AS language, length(regexp_replace(s, '\\P{{L}}', '', 'g')) AS letters, length(regexp_replace(s, '[^{{}}\\[\\]();=<>_+\\-*/#\\\\$:&|^%]', '', 'g')) / greatest(length(s), 1) AS symbols,
  list_filter(regexp_split_to_array(lower(s), '[^0-9A-Za-z_]+'), lambda x: x <> '') AS ws, {" + ".join(f"CAST(regexp_matches(lower(s), {quoted(chr(92) + 'b' + w + chr(92) + 'b')}) AS INTEGER)" for w in code.RESUME_WORDS)} AS resume FROM s),
n AS (SELECT *, CAST(regexp_matches(s, '[{{}}()\\[\\];=<>:]') AS INTEGER) + CAST(regexp_matches(s, '\\b\\w+\\s*=\\s*.+') AS INTEGER) + CAST(regexp_matches(s, '(?m)^\\s*#') AS INTEGER) + CAST(regexp_matches(s, '(?m)^\\s*//') AS INTEGER) AS structure,
  {" + ".join(f"CAST(regexp_matches(s, {quoted('(?i)' + k)}) AS INTEGER)" for k in code.KEYWORDS)} AS words FROM l)
SELECT conv_id, turn, CASE WHEN coalesce(s, '') = '' THEN 'empty' WHEN regexp_matches(s, '(?i)^(https?://\\S+|www\\.\\S+)$') THEN 'url' WHEN resume >= 3 AND NOT regexp_matches(low, 'def |class |import |const |function|[{{}}]|fn ') THEN 'resume' WHEN letters = 0 THEN 'no letters'
  WHEN language = 'Unknown' AND symbols < 0.025 AND len(ws) > 10 AND len(list_filter(ws, lambda x: x IN ({", ".join(map(quoted, code.STOP_WORDS))}))) / greatest(len(ws), 1) > 0.15 THEN 'prose'
  WHEN language = 'Unknown' AND NOT (length(s) >= 12 AND NOT regexp_matches(s, '^\\pN+$') AND ((words >= 1 AND structure >= 1) OR (structure >= 2 AND letters >= 4))) THEN 'not code' ELSE 'valid' END AS verdict,
  CASE WHEN language = 'Unknown' THEN 'Python' ELSE language END AS language FROM n""", own=True)
def snippet_validation(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as snippets, with a link, a resume or code in place of some: prose, not code, or code."""
    n = F.col("turn") % 9
    own = F.when(n == 3, F.concat(F.lit("https://example.org/"), F.col("turn").cast("string"))).when(n == 5, "Education, skills and experience at work").when(n == 7, "def f(x):\n    return x").otherwise(F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", own.alias("text"))
    verdict, language = code.snippet_verdict(F.col("text"))
    return rows.select("conv_id", "turn", verdict.alias("verdict"), language.alias("language"))


@query(""", i AS (SELECT analysis_id, file, category, line, issue, severity, '- line ' || line || ' [' || severity || '] ' || issue AS t FROM findings),
c AS (SELECT analysis_id, file, category, '### ' || category || chr(10) || string_agg(t, chr(10) ORDER BY line, issue, severity, t) AS part FROM i GROUP BY analysis_id, file, category),
f AS (SELECT analysis_id, file, '## ' || file || chr(10) || string_agg(part, chr(10) ORDER BY category) AS part FROM c GROUP BY analysis_id, file)
SELECT analysis_id, string_agg(part, chr(10) || chr(10) ORDER BY file) AS markdown FROM f GROUP BY analysis_id""")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.markdown(findings(spark, d))


def report_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scans with scores for two in three, their files and their findings as the report takes them. Items are sent to their
    scan, and to their file of it, as the table has them; what a report shows of them is made there."""
    n, line = F.col("analysis_id"), F.col("line")
    kind = F.when(F.col("category") == "security", "Security").when(F.col("category") == "code_smell", "Code Smell").otherwise("Style")
    scans = analyses(spark, d).join(repositories(spark, d).select("repo_id", F.col("name").alias("repo_name")), "repo_id")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    items = items.join(scans.select(F.col("analysis_id").alias("l_orderkey")), "l_orderkey", "left_semi").withColumn("file", file_of_part())
    own = findings(spark, d, items.repartition("l_orderkey", "file")).withColumn("category", kind).withColumn("suggestion", F.concat(F.lit("See "), "file")).withColumn("risk_level", F.when(line % 2 == 0, "Low"))
    own = own.withColumn("why_it_matters", F.when(line % 3 != 0, "because")).withColumn("before_code", F.when(line % 4 == 0, F.concat(F.lit("x = "), line.cast("string")))).withColumn("after_code", F.when(line % 5 == 0, "y = 1"))
    log = items.groupBy(F.col("l_orderkey").alias("analysis_id"), "file").agg(F.count(F.lit(1)).alias("findings")).select("*", F.col("file").alias("pos"), F.lit("source").alias("type"), F.lit("Analyzed").alias("status"))
    score = {c: F.when(n % 3 != 0, (n * (k + 1)) % 101) for k, (c, _) in enumerate(sections.SCORES)}
    shown = scans.select("analysis_id", "repo_name", F.col("pull_request_id").alias("pr_number"), F.when(n % 5 != 0, F.date_format("scanned_at", "yyyy-MM-dd")).alias("generated_at"), (n % 100).alias("risk_score"), *[c.alias(k) for k, c in score.items()])
    return shown, log, own


_ITEM = """'- **Line ' || line || '** [' || severity || ']: ' || issue || chr(10) || '  *Risk Level:* ' || CASE WHEN line % 2 = 0 THEN 'Low' ELSE severity END || chr(10) || '  *Why it matters:* ' || CASE WHEN line % 3 = 0 THEN 'See suggestion details.' ELSE 'because' END
  || chr(10) || '  *Recommendation:* See ' || file || CASE WHEN line % 4 = 0 OR line % 5 = 0 THEN chr(10) || '  *Refactoring Comparison:*' ELSE '' END
  || CASE WHEN line % 4 = 0 THEN chr(10) || '  ```' || chr(10) || '  // BEFORE' || CASE kind WHEN 1 THEN ' (Insecure)' WHEN 2 THEN ' (Smell)' ELSE '' END || ':' || chr(10) || 'x = ' || line || chr(10) || '  ```' ELSE '' END
  || CASE WHEN line % 5 = 0 THEN chr(10) || '  ```' || chr(10) || '  // AFTER' || CASE kind WHEN 1 THEN ' (Remediated)' WHEN 2 THEN ' (Clean)' ELSE ' (Remediated/Optimized)' END || ':' || chr(10) || 'y = 1' || chr(10) || '  ```' ELSE '' END"""


@query(f""", s AS (SELECT a.*, name FROM analyses a JOIN repositories USING (repo_id)),
i AS (SELECT f.*, min(ord) OVER (PARTITION BY analysis_id, file) AS place, CASE category WHEN 'security' THEN 1 WHEN 'code_smell' THEN 2 ELSE 3 END AS kind FROM findings f JOIN s USING (analysis_id)),
b AS (SELECT s.analysis_id, count(i.severity) AS n, {", ".join(f"count(*) FILTER (i.severity = '{v}') AS n_{v}" for v in sections.COUNTED)} FROM s LEFT JOIN i USING (analysis_id) GROUP BY s.analysis_id)
SELECT analysis_id, 1 AS section, '' AS place, 0 AS kind, 0 AS head, '' AS ord, '# Audit Report - ' || name || chr(10) || CASE WHEN pull_request_id IS NOT NULL THEN '**Pull Request:** #' || pull_request_id || chr(10) ELSE '' END
  || '**Generated at:** ' || CASE WHEN analysis_id % 5 = 0 THEN 'N/A' ELSE strftime(scanned_at, '%Y-%m-%d') END || chr(10) || chr(10) || '## Executive Summary' || chr(10) || '- **Overall Risk Score:** ' || (analysis_id % 100) || '/100' || chr(10) || '- **Findings Breakdown:**' || chr(10)
  || {" || ".join(f"'  - {v}: ' || n_{v} || chr(10)" for v in sections.COUNTED)} || '  - **Total Issues:** ' || n || chr(10)
  || CASE WHEN analysis_id % 3 = 0 THEN '' ELSE chr(10) || '- **Platform Quality Scores:**' || {" || ".join(f"chr(10) || '  - {name}: ' || (analysis_id * {k + 1} % 101) || '/100'" for k, (_, name) in enumerate(sections.SCORES))} || chr(10) END AS text FROM s JOIN b USING (analysis_id)
UNION ALL SELECT DISTINCT analysis_id, 2, '', 0, x.h, '', x.t FROM i, (VALUES (0, '## Files Analyzed' || chr(10) || '| File | Type | Status | Findings |' || chr(10) || '| --- | --- | --- | --- |'), (2, chr(10))) x(h, t)
UNION ALL SELECT analysis_id, 2, '', 0, 1, file, '| `' || file || '` | source | Analyzed | ' || count(*) || ' |' FROM i GROUP BY analysis_id, file
UNION ALL SELECT DISTINCT analysis_id, 3, '', 0, 0, '', '## Findings Grouped By File' FROM i
UNION ALL SELECT DISTINCT analysis_id, 3, place, 0, 0, '', '### `' || file || '`' || chr(10) FROM i
UNION ALL SELECT DISTINCT analysis_id, 3, place, kind, x.h, '', CASE WHEN x.h = 2 THEN '' ELSE '#### ' || CASE kind WHEN 1 THEN 'Security Findings' WHEN 2 THEN 'Code Smells' ELSE 'General Findings' END END FROM i, (VALUES (0), (2)) x(h)
UNION ALL SELECT analysis_id, 3, place, kind, 1, ord, {_ITEM} FROM i
UNION ALL SELECT analysis_id, 4, '', 0, 0, '', '## Executive Issues List' || chr(10) || 'No issues found! Code quality is clean.' FROM b WHERE n = 0
UNION ALL SELECT DISTINCT analysis_id, 4, '', 0, x.h, '', x.t FROM i, (VALUES (0, '## Executive Issues List' || chr(10) || '| File | Line | Severity | Category | Issue | Suggestion |' || chr(10) || '| --- | --- | --- | --- | --- | --- |'), (2, chr(10))) x(h, t)
UNION ALL SELECT analysis_id, 4, '', 0, 1, ord, '| `' || file || '` | ' || line || ' | **' || severity || '** | ' || CASE kind WHEN 1 THEN 'Security' WHEN 2 THEN 'Code Smell' ELSE 'Style' END || ' | ' || issue || ' | See ' || file || ' |' FROM i""")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of the reports of all scans, with what it is sorted by."""
    return sections.report_rows(*report_tables(spark, d))


@query(""" SELECT file AS "File", CAST(line AS VARCHAR) AS "Line", severity AS "Severity", category AS "Category", issue AS "Issue", 'See ' || file AS "Suggestion", '' AS "Why It Matters", 'line ' || line AS "Before Code", '' AS "After Code" FROM findings""")
def csv_report(spark: SparkSession, d: str) -> DataFrame:
    own = findings(spark, d).withColumn("suggestion", F.concat(F.lit("See "), "file")).withColumn("before_code", F.concat(F.lit("line "), F.col("line").cast("string")))
    return reports.csv_rows(own)


@query(""" SELECT '{"analysis_id":' || analysis_id || ',"line":' || line || ',"severity":"' || severity || '"}' AS json FROM findings""")
def json_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.json_rows(findings(spark, d).select("analysis_id", "line", "severity"))


@query("SELECT conv_id, turn, role, length(text) AS chars, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back FROM conversations QUALIFY back <= 10", own=True)
def chat_history_last10(spark: SparkSession, d: str) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"), back.alias("back")).where(F.col("back") <= 10)


_MESSAGES = "(['ok', 'Error 401', 'invalid_api_key', 'API key has EXPIRED', '429 slow down', 'Quota reached', 'Model x is deprecated', 'model_not_found', '404 page', 'timeout'])"
_CLASS = """CASE WHEN regexp_matches(m, '401|403|invalid_api_key|invalid api key|unauthorized|authentication') OR contains(m, 'api key') AND contains(m, 'expired') THEN 'auth' WHEN regexp_matches(m, '429|rate_limit|rate limit|quota|limit exceeded|too many requests') THEN 'rate_limit'
  WHEN contains(m, 'model') AND regexp_matches(m, 'does not exist|not found|no longer supported|decommissioned|deprecated|do not have access|does not have access|not have permission|unavailable|404|model_not_found') THEN 'model' ELSE 'other' END"""


@query(f"""WITH t AS (SELECT event_id, {_MESSAGES}[event_id % 10 + 1] AS msg, CASE WHEN event_id % 2 = 0 THEN ' Alpha' ELSE 'beta' END AS provider FROM events), c AS (SELECT *, {_CLASS} AS kind FROM (SELECT *, lower(msg) AS m FROM t)), n AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'Alpha' ELSE 'Beta' END AS name FROM c)
SELECT event_id, kind, CASE kind WHEN 'auth' THEN 'The ' || name || ' API key is missing, invalid, or expired. Please update your API key in Settings.' WHEN 'rate_limit' THEN 'The ' || name || ' API rate limit was exceeded. Please wait a moment and try again.'
  WHEN 'model' THEN 'The selected ' || name || ' model is not available on your account. Please choose a different model in Settings.' ELSE 'LLM provider is not configured correctly. Please update your API key and model in Settings.' END AS said FROM n""", own=True)
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    messages = ("ok", "Error 401", "invalid_api_key", "API key has EXPIRED", "429 slow down", "Quota reached", "Model x is deprecated", "model_not_found", "404 page", "timeout")
    key = F.col("event_id")
    message, provider = F.get(F.array(*map(F.lit, messages)), (key % 10).cast("int")), F.when(key % 2 == 0, " Alpha").otherwise("beta")
    return table(spark, d, "events").select("event_id", service.error_class(message).alias("kind"), service.friendly_error(provider, message).alias("said"))

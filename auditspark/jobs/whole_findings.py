"""Findings with all that a report shows of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.jobs.scans import scan_oracle
from auditspark.operators import advice, reports, rules
from auditspark.sources.code import CTE as CODE
from auditspark.sources.code import code_files


def whole_findings(spark: SparkSession, d: str) -> DataFrame:
    """The findings of all rules on the derived source files, with suggestion, reason and the code before and after."""
    files = code_files(spark, d)
    return advice.whole(rules.scan(files, code=True))


def whole_csv(spark: SparkSession, d: str) -> DataFrame:
    """The CSV report of these findings: all nine columns filled."""
    own = whole_findings(spark, d).withColumn("file", F.col("path"))
    return reports.csv_rows(own)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_ROWS = ", ".join(f"({', '.join(map(quoted, (n, i, advice.NAMED.get(i, i), *advice.KINDS[n], advice.CWE_OF_ISSUE.get(i, advice.CWE[n]), s)))})" for n, i, s in advice.ADVICE)
_QUERY = " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in advice.PARAMETERIZED.items())
_LEAK = "'Hardcoded ' || lower(issue) || ' in source code. If the repository is compromised, this credential is immediately exposed. Attackers scan public repos for these patterns.'"
_SMELLS = {
    "magic_number": (
        "'Extract the magic number ' || x || ' into a named constant for better readability and maintainability.'",
        "'Magic number ' || x || ' makes the code harder to understand. Named constants explain the purpose and make the code self-documenting.'",
        "'# Define a named constant' || chr(10) || 'CONSTANT_NAME = ' || x || chr(10) || '# Then use CONSTANT_NAME in the code'",
    ),
    "unused_import": (
        "'Remove the unused import ''' || x || ''' to keep the code clean and reduce cognitive load.'",
        "'''' || x || ''' is imported but never used in the code. Unused imports increase cognitive load and can mask missing functionality.'",
        "'# Remove: ' || b",
    ),
    "long_parameter_list": (
        "'Function ''' || x || ''' has ' || regexp_extract(issue, '([0-9]+) params', 1) || ' parameters. Consider grouping related parameters into a configuration object, data class, or using keyword arguments.'",
        "'Functions with ' || regexp_extract(issue, '([0-9]+) params', 1) || '+ parameters are hard to call correctly and difficult to maintain. Grouping related parameters improves API design.'",
        "'# Group related params into a config/dataclass'",
    ),
    "deep_nesting": (
        "'Refactor to reduce nesting depth using early returns, guard clauses, or extracting nested logic into helper functions.'",
        "'Code nested ' || regexp_extract(issue, '([0-9]+) levels', 1) || ' levels deep is hard to read and test. Deep nesting increases cognitive load and makes bugs harder to spot.'",
        quoted("# Use guard clauses / early returns:\n# if not valid_input:\n#     return error\n# # Continue with main logic at lower nesting"),
    ),
    "duplicate_code": (
        "'This code block appears multiple times. Extract it into a shared function or utility method.'",
        "'Duplicate code increases maintenance burden. When one copy is updated, the others may be forgotten, leading to inconsistencies.'",
        quoted("# Extract this into a shared function:\n# def shared_function():\n#     ...\n# Then call shared_function() at each location"),
    ),
}


def _smell(k: int) -> str:
    return " ".join(f"WHEN name = '{n}' THEN {texts[k]}" for n, texts in _SMELLS.items())


_AFTER = f"""CASE name WHEN 'hardcoded_secrets' THEN coalesce(nullif(regexp_extract(b, '^(\\w+)\\s*[=:]', 1), ''), 'SECRET') || ' = os.getenv("' || upper(coalesce(nullif(regexp_extract(b, '^(\\w+)\\s*[=:]', 1), ''), 'SECRET')) || '")'
  WHEN 'sql_injection' THEN CASE lang {_QUERY} END
  WHEN 'xss' THEN CASE WHEN contains(b, 'innerHTML') THEN regexp_extract(b, '([\\w.]+)\\s*\\.innerHTML', 1) || '.textContent = safeValue;  // or use DOMPurify.sanitize()' ELSE '// Sanitize user input before inserting into the DOM' END
  WHEN 'csrf' THEN '# Remove @csrf_exempt and ensure CSRF middleware is active'
  WHEN 'command_injection' THEN replace(b, 'shell=True', 'shell=False')
  WHEN 'unsafe_eval' THEN CASE WHEN contains(b, 'eval(') AND lang = 'python' THEN 'import ast' || chr(10) || replace(b, 'eval(', 'ast.literal_eval(') WHEN contains(b, 'exec(') THEN '# WARNING: exec() usage — consider refactoring' || chr(10) || b ELSE b END
  WHEN 'missing_authorization' THEN '# Add auth dependency, e.g. in FastAPI:' || chr(10) || b || chr(10) || 'async def endpoint(current_user: User = Depends(get_current_user)):'
  WHEN 'insecure_storage' THEN CASE WHEN contains(b, 'localStorage') THEN {quoted(advice.COOKIE)} ELSE replace(replace(b, 'pickle.load', 'json.load'), 'yaml.load(', 'yaml.safe_load(') END
  WHEN 'jwt_misconfiguration' THEN b WHEN 'ssrf' THEN {quoted(advice.ALLOWED)} WHEN 'path_traversal' THEN {quoted(advice.INSIDE)}
  WHEN 'unsafe_deserialization' THEN replace(replace(b, 'pickle.load', 'json.load'), 'yaml.load(', 'yaml.safe_load(') ELSE CASE {_smell(2)} END END"""
_WHOLE = f"""WITH f AS ({scan_oracle()}), n AS (WITH {CODE} SELECT file_id, line_no, line, stripped, lead(line) OVER w AS second, lead(line, 2) OVER w AS third FROM numbered WINDOW w AS (PARTITION BY file_id ORDER BY line_no)),
a(name, issue, title, vulnerability_type, prefix, why, cwe, advised) AS (VALUES {_ROWS}),
j AS (SELECT f.*, n.stripped AS b, concat_ws(chr(10), n.line, second, third) AS block, CASE WHEN path LIKE '%.js' THEN 'javascript' ELSE 'python' END AS lang, title, vulnerability_type, prefix, why, cwe, advised,
  coalesce(nullif(regexp_extract(f.issue, '^Magic Number: (.*)$', 1), ''), nullif(regexp_extract(f.issue, '^Unused Import: ''(.*)''$', 1), ''), regexp_extract(f.issue, '^Long Parameter List: (.*?) ?\\(', 1)) AS x
  FROM f JOIN n ON n.file_id = f.file_id AND n.line_no = f.line LEFT JOIN a ON a.name = f.name AND a.issue = f.issue)
SELECT repo, file_id, path, CASE kind WHEN 'security' THEN 'Security' ELSE 'Code Smell' END AS category, line, severity, CASE kind WHEN 'security' THEN prefix || title ELSE issue END AS issue,
  coalesce(vulnerability_type, '') AS vulnerability_type, coalesce(cwe, '') AS cwe, coalesce(advised, CASE {_smell(0)} END) AS suggestion, CASE WHEN name = 'hardcoded_secrets' THEN {_LEAK} WHEN kind = 'security' THEN why ELSE CASE {_smell(1)} END END AS why_it_matters,
  severity AS risk_level, CASE name WHEN 'duplicate_code' THEN block ELSE b END AS before_code, {_AFTER} AS after_code FROM j"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (whole_findings, whole_csv)}
ORACLE: dict[str, str] = {
    "whole_findings": _WHOLE,
    "whole_csv": f"""SELECT path AS "File", CAST(line AS VARCHAR) AS "Line", severity AS "Severity", category AS "Category", issue AS "Issue", suggestion AS "Suggestion", why_it_matters AS "Why It Matters", before_code AS "Before Code", after_code AS "After Code" FROM ({_WHOLE})""",
}

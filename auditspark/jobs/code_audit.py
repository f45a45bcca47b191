"""Queries of the code rules over the derived source files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.operators import rules
from auditspark.sources.code import CTE, code_files, code_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = f"WITH {CTE}{oracle}"
        return f

    return add


def numbered(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("ord"))
    return code_lines(spark, d).withColumn("line_no", place).drop("ord")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pattern_oracle(chosen: list[rules.Rule]) -> str:
    values = ", ".join(f"({k}, {quoted(r.name)}, {quoted(r.severity)}, {quoted(r.cwe)}, {quoted(r.issue)})" for k, r in enumerate(chosen))
    finds = " UNION ALL ".join(f"SELECT {k} AS rule, repo, file_id, path, regexp_split_to_array(content, {quoted(r.pattern)}) AS parts, regexp_extract_all(content, {quoted(r.pattern)}) AS found FROM code_files WHERE regexp_matches(content, {quoted(r.pattern)})" for k, r in enumerate(chosen))
    return f""", rules(rule, name, severity, cwe, issue) AS (VALUES {values}), found AS ({finds}),
hit AS (SELECT rule, repo, file_id, path, 1 + len(array_to_string(parts[:i], '') || array_to_string(found[:i - 1], '')) - len(replace(array_to_string(parts[:i], '') || array_to_string(found[:i - 1], ''), chr(10), '')) AS line FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM found))
SELECT repo, file_id, path, CAST(line AS INTEGER) AS line, name, severity, cwe, issue FROM hit JOIN rules USING (rule) QUALIFY row_number() OVER (PARTITION BY file_id, line, substr(issue, 1, 60) ORDER BY rule) = 1"""


def _pattern_query(name: str, chosen: list[rules.Rule], oracle: bool = True) -> None:
    QUERIES[name] = lambda spark, d: rules.pattern_findings(code_files(spark, d), chosen)
    if oracle:
        ORACLE[name] = f"WITH {CTE}{_pattern_oracle(chosen)}"


_pattern_query("security_rules", rules.RULES)
for _name in dict.fromkeys(r.name for r in rules.RULES):
    _pattern_query(f"{_name}_rule", [r for r in rules.RULES if r.name == _name])
_pattern_query("lookaround_rules", rules.LOOKING, oracle=False)
#: The same meaning by two tests of a line, as DuckDB's patterns have no look-around.
ORACLE["lookaround_rules"] = rf"""WITH {CTE} SELECT repo, file_id, path, line_no AS line, 'command_injection' AS name, 'High' AS severity, 'CWE-78' AS cwe, 'exec() in PHP/Node (or generic)' AS issue FROM numbered
WHERE regexp_matches(line, '(?i)\bexec\s*\(') AND NOT regexp_matches(line, '(?i)(os|subprocess|child_process|Runtime\.getRuntime\(\))\.exec\s*\(')
UNION ALL SELECT repo, file_id, path, line_no, 'insecure_storage', 'High', 'CWE-922', 'Cookie without httpOnly/Secure flags for sensitive data' FROM numbered WHERE regexp_matches(line, '(?i)cookie.*(password|secret|token|jwt)') AND NOT contains(lower(line), 'httponly')"""


@query(f""", ls AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM numbered),
p(rule, pattern, severity, issue) AS (VALUES {", ".join(f"({k}, {quoted('(?i)' + p)}, {quoted(s)}, {quoted(i)})" for k, (p, s, i) in enumerate(rules.SECRETS))})
SELECT DISTINCT repo, file_id, path, line_no AS line, severity, issue FROM ls JOIN p ON regexp_matches(line, pattern) WHERE NOT regexp_matches(near, {quoted(rules.LEGITIMATE)})
AND NOT regexp_matches(CASE WHEN rule = 4 THEN regexp_extract(line, '(?i)(postgresql|mysql|mongodb|redis|sqlite)://') ELSE regexp_extract(line, pattern, CASE WHEN rule = 4 THEN 0 ELSE 1 END) END, {quoted(rules.PLACEHOLDER)})""".replace("regexp_extract(line, pattern, CASE WHEN rule = 4 THEN 0 ELSE 1 END)", "CASE rule " + " ".join(f"WHEN {k} THEN regexp_extract(line, {quoted('(?i)' + p)}, 1)" for k, (p, _, _) in enumerate(rules.SECRETS[:4])) + " END"))  # fmt: skip
def hardcoded_secrets_rule(spark: SparkSession, d: str) -> DataFrame:
    return rules.hardcoded_secrets(code_files(spark, d))


@query(rf""" SELECT repo, file_id, path, line_no, line FROM numbered WHERE NOT (stripped[1:1] IN ('#', '*') OR stripped[1:2] IN ('//', '--', '/*')) AND regexp_matches(stripped, {quoted(rules.SQL_WORDS)})
AND (regexp_matches(stripped, '[''"]\s*\+\s*([^\s''"]|$)') OR {" OR ".join(f"regexp_matches(stripped, {quoted(p)})" for p in rules.SQL_JOINED[1:])})""")
def sql_injection_rule(spark: SparkSession, d: str) -> DataFrame:
    return rules.sql_injection(numbered(spark, d)).select("repo", "file_id", "path", "line_no", "line")


@query(f""", ls AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 4 FOLLOWING) AS near FROM numbered)
SELECT repo, file_id, path, line_no AS line FROM ls WHERE ({" OR ".join(f"regexp_matches(line, {quoted(p)})" for p in rules.ROUTES)}) AND NOT regexp_matches(near, {quoted(rules.AUTHORIZED)}) AND NOT regexp_matches(line, {quoted(rules.OPEN_ROUTES)})""")
def missing_authorization_rule(spark: SparkSession, d: str) -> DataFrame:
    return rules.missing_authorization(code_files(spark, d))


@query(r""", m AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(stripped, '"[^"]*"', '""', 'g'), '''[^'']*''', '''''''', 'g'), '#[^#]*$', '') AS bare, regexp_extract(stripped, '^(\w+)\s*=', 1) AS name FROM numbered
  WHERE NOT (stripped[1:1] IN ('#', '*') OR stripped[1:2] IN ('//', '--', '/*')) AND NOT regexp_matches(stripped, 'range\s*\(')),
p AS (SELECT *, regexp_extract(bare[i:], '^\d+\.?\d*') AS run FROM (SELECT *, unnest(range(1, length(bare) + 1)) AS i FROM m WHERE NOT (name <> '' AND upper(name) = name)) WHERE regexp_matches(bare[i:i], '\d') AND NOT regexp_matches(coalesce(bare[i - 1:i - 1], ''), '[A-Za-z_]')),
c AS (SELECT *, CASE WHEN regexp_matches(bare[i + length(run):i + length(run)], '[A-Za-z_]') THEN left(run, length(run) - 1) ELSE run END AS num FROM p),
g AS (SELECT repo, file_id, path, line_no, arg_min(num, i) AS number FROM c WHERE num <> '' AND CAST(num AS DOUBLE) NOT IN (0, 1, 2, 10, 100) AND CAST(num AS DOUBLE) <= 10000 GROUP BY ALL)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line_no) <= 5""")
def magic_numbers(spark: SparkSession, d: str) -> DataFrame:
    return rules.magic_numbers(numbered(spark, d)).select("repo", "file_id", "path", "line_no", "number")


@query(r""", i AS (SELECT *, starts_with(stripped, 'import ') OR starts_with(stripped, 'from ') AS imp FROM numbered WHERE path LIKE '%.py'),
rest AS (SELECT file_id, string_agg(stripped, chr(10) ORDER BY line_no) AS rest FROM i WHERE NOT imp GROUP BY file_id),
n AS (SELECT repo, file_id, path, line_no, k, trim(split_part(trim(names[k]), ' as ', 1)) AS name FROM (SELECT *, unnest(range(1, len(names) + 1)) AS k FROM (SELECT *, string_split(regexp_extract(stripped, '^(?:from\s+\S+\s+)?import\s+(.+)$', 1), ',') AS names FROM i WHERE imp)))
SELECT repo, file_id, path, line_no, name FROM n LEFT JOIN rest USING (file_id) WHERE name NOT IN ('*', '') AND NOT regexp_matches(coalesce(rest, ''), '\b' || regexp_escape(name) || '\b') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line_no, k) <= 5""")
def unused_imports(spark: SparkSession, d: str) -> DataFrame:
    return rules.unused_imports(code_files(spark, d))


@query(r""" SELECT repo, file_id, path, line_no, regexp_extract(line, '\b(TODO|FIXME|HACK|XXX|WORKAROUND)\b[:\s]?(.{0,120})', 1) AS marker, trim(regexp_extract(line, '\b(TODO|FIXME|HACK|XXX|WORKAROUND)\b[:\s]?(.{0,120})', 2)) AS note
FROM numbered WHERE regexp_matches(line, '\b(TODO|FIXME|HACK|XXX|WORKAROUND)\b')""")
def todo_markers(spark: SparkSession, d: str) -> DataFrame:
    return rules.todo_markers(numbered(spark, d))


@query(r""" SELECT repo, file_id, path, line_no AS line, regexp_extract(line, 'def\s+(\w+)\s*\(([^)]*)\)', 1) AS name, CAST(len(list_filter(string_split(regexp_extract(line, 'def\s+(\w+)\s*\(([^)]*)\)', 2), ','), lambda x: trim(x) <> '')) AS INTEGER) AS params
FROM numbered WHERE regexp_matches(line, 'def\s+(\w+)\s*\(([^)]*)\)') AND len(string_split(regexp_extract(line, 'def\s+(\w+)\s*\(([^)]*)\)', 2), ',')) > 5""")
def long_parameter_lists(spark: SparkSession, d: str) -> DataFrame:
    return rules.long_parameter_lists(code_files(spark, d))


EDGES = r""", named AS (SELECT repo, path, split_part(path, '/', 1) AS src, CASE WHEN path LIKE '%.py' THEN split_part(regexp_extract(line, '^\s*(?:from|import)\s+([\w.]+)', 1), '.', 1) ELSE split_part(regexp_extract(line, '(?:import\s+[^''"]*?from\s*|require\s*\(\s*)[''"]([^''"]+)[''"]', 1), '/', 1) END AS name FROM numbered
  WHERE CASE WHEN path LIKE '%.py' THEN regexp_matches(line, '^\s*(from\s+[\w.]+\s+import|import\s+[\w.]+)') ELSE regexp_matches(line, '(?:import\s+[^''"]*?from\s*|require\s*\(\s*)[''"]([^''"]+)[''"]') END),
tops AS (SELECT DISTINCT repo, split_part(path, '/', 1) AS name FROM code_files),
edges AS (SELECT n.repo, n.src, n.name AS dst, t.name IS NOT NULL AS internal, count(*) AS n FROM named n LEFT JOIN tops t ON t.repo = n.repo AND t.name = n.name WHERE t.name IS NULL OR n.src <> n.name GROUP BY ALL)"""


@query(EDGES + " SELECT * FROM edges")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return rules.import_edges(code_files(spark, d))


@query(EDGES + " SELECT a.repo, a.src, a.dst FROM edges a JOIN edges b ON a.repo = b.repo AND a.src = b.dst AND a.dst = b.src WHERE a.internal AND b.internal AND a.src < a.dst")
def mutual_imports(spark: SparkSession, d: str) -> DataFrame:
    return rules.mutual_imports(rules.import_edges(code_files(spark, d)))


@query(EDGES + """, i AS (SELECT repo, dst, sum(n) AS n FROM edges WHERE internal GROUP BY ALL), t AS (SELECT repo, sum(n) AS total FROM i GROUP BY repo)
SELECT repo, dst AS component, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM i JOIN t USING (repo) WHERE total >= 30 AND n / total > 0.6 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, dst DESC) = 1""")
def god_components(spark: SparkSession, d: str) -> DataFrame:
    return rules.god_components(rules.import_edges(code_files(spark, d)))

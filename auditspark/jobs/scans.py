"""Scans with all rules: of files, of patches, of what patches add; and the debt that they make."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions import text
from auditspark.jobs import code_audit, outside
from auditspark.jobs.code_audit import numbered
from auditspark.jobs.repo_files import FUNCTIONS, NUMBER, REPORT, SOURCES, at, classified, functions
from auditspark.operators import clones, complexity, debt, external, patches, rules, scores, tree
from auditspark.sources.adapters import files as documents
from auditspark.sources.adapters import table
from auditspark.sources.code import CTE as CODE
from auditspark.sources.code import code_files
from auditspark.sources.repos import CTE as REPOS
from auditspark.sources.repos import repo_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


BLOCKS = r""", code AS (SELECT repo, file_id, path, line_no, stripped, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS pos FROM numbered WHERE stripped <> '' AND NOT (stripped[1:1] = '#' OR stripped[1:2] IN ('//', '--', '/*'))),
b AS (SELECT repo, file_id, path, line_no, concat_ws('|', stripped, lead(stripped) OVER w, lead(stripped, 2) OVER w) AS block, lead(line_no, 2) OVER w AS last FROM code WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
g AS (SELECT repo, file_id, path, min(line_no) AS line, count(*) AS n FROM b WHERE last IS NOT NULL AND file_id IN (SELECT file_id FROM numbered GROUP BY file_id HAVING count(*) >= 6) GROUP BY repo, file_id, path, block HAVING count(*) > 1)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line) <= 3"""
NESTING = r""", n AS (SELECT *, length(line) - length(ltrim(line, ' ' || chr(9))) AS indent FROM numbered WHERE stripped <> '' AND NOT (stripped[1:1] = '#' OR stripped[1:2] IN ('//', '--', '/*'))),
x AS (SELECT *, CASE WHEN indent >= 4 THEN indent // 4 WHEN contains(line[:indent], chr(9)) THEN indent ELSE 0 END AS depth FROM n)
SELECT repo, file_id, path, max(depth) AS depth, arg_min(line_no, (-depth, line_no)) AS line FROM x GROUP BY ALL HAVING max(depth) > 4"""


def _part(kind: str, oracle: str, line: str, name: str, severity: str, issue: str) -> str:
    return f"SELECT repo, file_id, path, '{kind}' AS kind, CAST({line} AS INTEGER) AS line, {name} AS name, {severity} AS severity, {issue} AS issue FROM ({oracle})"


#: Numbers of any text: a digit right after a letter begins none, and one before a letter loses its last character.
MAGIC = r""", m AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(stripped, '"[^"]*"', '""', 'g'), '''[^'']*''', '''''''', 'g'), '#[^#]*$', '') AS bare, regexp_extract(stripped, '^(\w+)\s*=', 1) AS name FROM numbered
  WHERE NOT (stripped[1:1] IN ('#', '*') OR stripped[1:2] IN ('//', '--', '/*')) AND NOT regexp_matches(stripped, 'range\s*\(')),
t AS (SELECT repo, file_id, path, line_no, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT *, regexp_extract_all(regexp_replace(bare, '([A-Za-z_])\d', '\1;', 'g'), '\d+\.?\d*[A-Za-z_]?') AS ts FROM m WHERE NOT (name <> '' AND upper(name) = name))),
c AS (SELECT *, CASE WHEN regexp_matches(t, '[A-Za-z_]$') THEN left(t, length(t) - 2) ELSE t END AS num FROM t),
g AS (SELECT repo, file_id, path, line_no, arg_min(num, i) AS number FROM c WHERE num <> '' AND CAST(num AS DOUBLE) NOT IN (0, 1, 2, 10, 100) AND CAST(num AS DOUBLE) <= 10000 GROUP BY ALL)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line_no) <= 5"""


def scan_oracle(source: str = CODE, magic: str | None = None) -> str:
    """All rules over ``code_files`` and ``numbered`` of ``source``; ``magic``: SQL of the numbers, for texts that are no code."""
    own = {name: code_audit.ORACLE[name].replace(CODE, source) for name in ("security_rules", "lookaround_rules", "hardcoded_secrets_rule", "sql_injection_rule", "missing_authorization_rule", "magic_numbers", "unused_imports", "long_parameter_lists")}
    if magic:
        own["magic_numbers"] = f"WITH {source}{magic}"
    lists = f"SELECT * FROM ({own['long_parameter_lists']}) WHERE path LIKE '%.py' QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line, name) <= 3"
    parts = [
        _part("security", own["security_rules"], "line", "name", "severity", "issue"),
        _part("security", own["lookaround_rules"], "line", "name", "severity", "issue"),
        _part("security", own["hardcoded_secrets_rule"], "line", "'hardcoded_secrets'", "severity", "issue"),
        _part("security", own["sql_injection_rule"], "line_no", "'sql_injection'", "'Critical'", "'SQL Injection — String Concatenation in Query'"),
        _part("security", own["missing_authorization_rule"], "line", "'missing_authorization'", "'High'", "'Missing Authorization Guard on API Endpoint'"),
        _part("code_smell", own["magic_numbers"], "line_no", "'magic_number'", "'Medium'", "'Magic Number: ' || number"),
        _part("code_smell", own["unused_imports"], "line_no", "'unused_import'", "'Low'", "'Unused Import: ''' || name || ''''"),
        _part("code_smell", lists, "line", "'long_parameter_list'", "'Medium'", "'Long Parameter List: ' || name || '(' || params || ' params)'"),
        _part("code_smell", f"WITH {source}{BLOCKS}", "line", "'duplicate_code'", "'Medium'", "'Duplicate Code Block (' || n || ' occurrences)'"),
        _part("code_smell", f"WITH {source}{NESTING}", "line", "'deep_nesting'", "'Medium'", "'Deep Nesting: ' || depth || ' levels deep (threshold: 4)'"),
    ]
    return " UNION ALL ".join(parts)


@query(scan_oracle())
def scan_findings(spark: SparkSession, d: str) -> DataFrame:
    """All rules over the derived source files."""
    return rules.scan(code_files(spark, d))


#: The given texts and pages as ``code_files`` and ``numbered``.
DOCUMENTS = """code_files AS (SELECT coalesce(source, '') AS repo, doc_id AS file_id, coalesce(source, '') || '/doc_' || doc_id || '.txt' AS path, coalesce(text, '') AS content FROM documents),
code_split AS (SELECT repo, file_id, path, CASE WHEN content[-1:] = chr(10) THEN string_split(content[:-2], chr(10)) WHEN content = '' THEN [] ELSE string_split(content, chr(10)) END AS ls FROM code_files),
numbered AS (SELECT repo, file_id, path, ls[i] AS line, trim(ls[i], ' ' || chr(9) || chr(13)) AS stripped, CAST(i AS INTEGER) AS line_no FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM code_split))"""
PAGES = DOCUMENTS.replace(DOCUMENTS.partition("(")[2].partition(" FROM documents")[0] + " FROM documents", "SELECT coalesce(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '') AS repo, page_id AS file_id, 'page_' || page_id || '.html' AS path, coalesce(html, '') AS content FROM pages")


@query(scan_oracle(DOCUMENTS, MAGIC))
def document_findings(spark: SparkSession, d: str) -> DataFrame:
    """All rules over the given texts, which are no code."""
    own = documents(spark, d).select("repo", "file_id", "path", "content")
    return rules.scan(own)


@query(scan_oracle(PAGES, MAGIC))
def page_findings(spark: SparkSession, d: str) -> DataFrame:
    """All rules over the given pages."""
    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.lit(""))
    own = table(spark, d, "pages").select(host.alias("repo"), F.col("page_id").alias("file_id"), F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).alias("content"))
    return rules.scan(own)


#: The patch of each derived file as a text of its own, a line of it being a line of the file with its sign.
PATCHED = CODE.replace("code_lines AS (", "source_lines AS (").replace("code_files AS (", """code_lines AS (SELECT repo, file_id, path, ord, '+' || line AS line FROM source_lines UNION ALL SELECT DISTINCT repo, file_id, path, '', '@@ -1,1 +1,1 @@' FROM source_lines),
code_files AS (""")


def patch_texts(spark: SparkSession, d: str) -> DataFrame:
    lines = numbered(spark, d).select("repo", "file_id", "path", "line_no", "line")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(F.lit("+"), x["line"]))
    return lines.groupBy("repo", "file_id", "path").agg(F.concat(F.lit("@@ -1,1 +1,1 @@\n"), F.array_join(rows, "\n")).alias("content"))


REVIEW = """, c AS (SELECT repo, file_id, path, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low FROM f GROUP BY ALL)
SELECT *, CAST(least(100, 25 * critical + 15 * high + 6 * medium + low) AS INTEGER) AS risk_score FROM c"""


def reviewed(findings: DataFrame) -> DataFrame:
    """Counts by severity and the risk of each text with findings."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    rows = findings.groupBy("repo", "file_id", "path").agg(*map(count, ("Critical", "High", "Medium", "Low")))
    return rows.withColumn("risk_score", scores.risk(*map(F.col, ("critical", "high", "medium", "low"))).cast("int"))


@query(scan_oracle(PATCHED))
def patch_findings(spark: SparkSession, d: str) -> DataFrame:
    """All rules on raw patch texts; lines are lines of the patch."""
    return rules.scan(patch_texts(spark, d))


@query(f"WITH f AS ({scan_oracle(PATCHED)}){REVIEW}")
def pr_review(spark: SparkSession, d: str) -> DataFrame:
    return reviewed(rules.scan(patch_texts(spark, d)))


@query(f"SELECT * FROM ({scan_oracle()}) WHERE line % 3 <> 0")
def pr_scan(spark: SparkSession, d: str) -> DataFrame:
    """Findings of whole files that stand on lines which a patch adds; patches leave every third line as it was."""
    lines = numbered(spark, d).select("file_id", "line_no", "line")
    sign = F.when(F.col("line_no") % 3 == 0, " ").otherwise("+")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.concat(sign, "line").alias("t")))), lambda x: x["t"])
    made = lines.groupBy(F.col("file_id").alias("patch_id")).agg(F.concat(F.lit("@@ -1,1 +1,1 @@\n"), F.array_join(rows, "\n")).alias("patch"))
    found = rules.scan(code_files(spark, d)).withColumn("patch_id", F.col("file_id"))
    return patches.on_modified_lines(found, made).select("repo", "file_id", "path", "kind", "line", "name", "severity", "issue")


@query(f"WITH f AS (SELECT * FROM ({scan_oracle()}) WHERE kind = 'security') SELECT repo, file_id, path, CASE WHEN count(*) FILTER (severity = 'Critical') > 0 THEN count(*) FILTER (severity = 'Critical') || ' critical security pattern(s) detected in the added code.' WHEN count(*) FILTER (severity = 'High') > 0 THEN count(*) FILTER (severity = 'High') || ' high-severity security pattern(s) detected in the added code.' WHEN count(*) FILTER (severity = 'Medium') > 0 THEN count(*) FILTER (severity = 'Medium') || ' medium-severity security pattern(s) detected in the added code.' ELSE count(*) || ' low-severity security pattern(s) detected in the added code.' END AS security_impact FROM f GROUP BY ALL")
def commit_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The sentence on the impact of each commit's added lines."""
    return rules.impact(rules.scan(outside.added_text(spark, d)))


#: What a patch adds is here the whole file, so these have the same rows.
ORACLE["commit_findings"], ORACLE["commit_impact"] = ORACLE["scan_findings"], ORACLE["commit_analysis"]
_AVERAGE = "CAST(trunc(avg({0})) AS INTEGER)"


@query(f"""WITH f AS ({scan_oracle()}), c AS (SELECT repo, file_id, count(*) FILTER (severity = 'Critical') AS c, count(*) FILTER (severity = 'High') AS h, count(*) FILTER (severity = 'Medium') AS m, count(*) FILTER (severity = 'Low') AS l FROM f GROUP BY ALL)
SELECT repo, {_AVERAGE.format('greatest(0, least(100, 100 - 50 * c - 30 * h - 12 * m - 2 * l))')} AS security, {_AVERAGE.format('greatest(0, least(100, 100 - 20 * c - 15 * h - 8 * m - 3 * l))')} AS maintainability, {_AVERAGE.format('greatest(0, least(100, 100 - 15 * c - 10 * h - 6 * m - 2 * l))')} AS performance FROM c GROUP BY repo""")
def averaged_scores(spark: SparkSession, d: str) -> DataFrame:
    """Whole means of the files' scores."""
    n = reviewed(rules.scan(code_files(spark, d)))
    counts = [F.col(x) for x in ("critical", "high", "medium", "low")]
    weights = {"security": (50, 30, 12, 2), "maintainability": (20, 15, 8, 3), "performance": (15, 10, 6, 2)}
    return n.groupBy("repo").agg(*[F.avg(scores.weighted(*counts, w)).cast("int").alias(k) for k, w in weights.items()])


EVIDENCE = """, f AS (SELECT repo, file_id, path, line_no, line, stripped, max(line_no) OVER (PARTITION BY file_id) AS n, line_no + CASE WHEN line_no % 5 = 0 THEN 100 ELSE 0 END AS claimed, CASE line_no % 4 WHEN 0 THEN '' WHEN 1 THEN upper(stripped) WHEN 2 THEN 'nothing like it' ELSE 'x' || stripped END AS before, 'issue with timeout value' AS issue FROM numbered),
t AS (SELECT *, lower(regexp_replace(trim(stripped), '\\s+', ' ', 'g')) AS actual, lower(regexp_replace(trim(before), '\\s+', ' ', 'g')) AS said FROM f),
k AS (SELECT *, contains(actual, 'issue') OR contains(actual, 'with') OR contains(actual, 'timeout') OR contains(actual, 'value') AS word FROM t)
SELECT repo, file_id, line_no, CASE WHEN claimed > n THEN false WHEN before <> '' THEN contains(actual, said) OR contains(said, actual) OR word OR NOT (regexp_matches(stripped, '^(#|//|/\\*|\\*|import |from |package )') OR stripped = '') ELSE word OR NOT (regexp_matches(stripped, '^(#|//|/\\*|\\*)') OR stripped = '') END AS holds FROM k"""


@query(f"WITH {CODE}{EVIDENCE}")
def evidence_checks(spark: SparkSession, d: str) -> DataFrame:
    """Claims about lines of the derived files, held against the lines."""
    stripped, n = text.strip(F.col("line")), F.col("line_no")
    before = F.when(n % 4 == 0, "").when(n % 4 == 1, F.upper(stripped)).when(n % 4 == 2, "nothing like it").otherwise(F.concat(F.lit("x"), stripped))
    claims = numbered(spark, d).select("repo", "file_id", "path", "line_no", (n + F.when(n % 5 == 0, 100).otherwise(0)).alias("claimed"), before.alias("before_code"), F.lit("Issue with timeout value").alias("issue"))
    lines = code_files(spark, d).select("file_id", text.split_lines(F.col("content")).alias("lines"))
    joined = claims.join(lines, "file_id")
    return joined.select("repo", "file_id", "line_no", external.evidence_holds(F.col("lines"), F.col("claimed"), F.col("before_code"), F.col("issue")).alias("holds"))


@query(f"""WITH {CODE}, n AS (SELECT file_id, max(line_no) AS n FROM numbered GROUP BY file_id), m AS (SELECT a.file_id, count(*) FILTER (a.line = b.line) AS same FROM numbered a JOIN numbered b ON b.file_id = a.file_id + 1 AND a.line_no = b.line_no GROUP BY a.file_id)
SELECT a.file_id, CAST(round_even(100.0 * coalesce(same, 0) / greatest(a.n, b.n), 0) AS INTEGER) AS similarity FROM n a JOIN n b ON b.file_id = a.file_id + 1 LEFT JOIN m ON m.file_id = a.file_id""")
def file_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each file against the next one, line by line."""
    own = code_files(spark, d).select("file_id", F.explode(F.array(text.split_lines(F.col("content")))).alias("lines"))
    other = own.select((F.col("file_id") - 1).alias("file_id"), F.col("lines").alias("others"))
    return own.join(other, "file_id").select("file_id", clones.similarity_pct(F.col("lines"), F.col("others")).alias("similarity"))


BOTH = f"both_scripts AS (SELECT a.repo, a.path AS path_a, b.path AS path_b FROM repo_files a JOIN repo_files b ON a.repo = b.repo WHERE a.t = {NUMBER['api/server.js']} AND b.t = {NUMBER['web/view_§.tsx']})"


@query(f"""WITH {REPOS}, {BOTH} SELECT repo, CAST(k + 1 AS INTEGER) AS place, path_a, path_b, CAST(k + 1 AS INTEGER) AS start_line_a, CAST(8 AS INTEGER) AS end_line_a, CAST(k + 1 AS INTEGER) AS start_line_b, CAST(8 - k AS INTEGER) AS duplicated_lines, CAST(100 AS INTEGER) AS similarity, CAST(3 AS BIGINT) AS total, CAST(21 AS BIGINT) AS total_lines,
  CAST(8 - k AS INTEGER) AS shown FROM both_scripts, (SELECT unnest(range(3)) AS k)""")
def clone_report(spark: SparkSession, d: str) -> DataFrame:
    """Clones of repositories: eight lines that two scripts share make three overlapping ones."""
    own = repo_files(spark, d).where(~tree.is_ignored(F.col("path")))
    rows = clones.clone_report(tree.source_paths(own).select("repo", "file_id", "path", "content"))
    return rows.select("repo", "place", "path_a", "path_b", "start_line_a", "end_line_a", "start_line_b", "duplicated_lines", "similarity", "total", "total_lines", F.size(F.split("snippet", "\n")).alias("shown"))


_N = "file_id % 50 NOT IN (0, 1, 2, 10)"
#: In a name such as ``run_17`` the second digit counts as a number.
_DIGIT = "file_id % 50 >= 10 AND file_id % 10 > 2"
DEBT = f"""WITH {REPOS}, {BOTH}, {FUNCTIONS}, {REPORT.removeprefix(', ')}, src AS (SELECT * FROM repo_files WHERE {at(SOURCES)}),
py AS (SELECT * FROM src WHERE {at(('app/main.py', 'core/util_§.py'))}), js AS (SELECT * FROM src WHERE {at(('api/server.js', 'web/view_§.tsx'))}), db AS (SELECT * FROM src WHERE {at(('services/db.py',))}),
f AS (SELECT repo, path, 'security' AS kind, 'Critical' AS severity FROM py, range(3) UNION ALL SELECT repo, path, 'security', 'High' FROM js
  UNION ALL SELECT repo, path, 'smell', 'Medium' FROM py UNION ALL SELECT repo, path, 'smell', 'Medium' FROM py UNION ALL SELECT repo, path, 'smell', 'Medium' FROM js WHERE {_N}
  UNION ALL SELECT repo, path, 'smell', 'Medium' FROM src WHERE {at(('web/components/list_§.jsx', 'scripts/tool_§.rb'))} AND {_N} UNION ALL SELECT repo, path, 'smell', 'Medium' FROM db UNION ALL SELECT repo, path, 'smell', 'High' FROM db
  UNION ALL SELECT repo, path, 'smell', 'Medium' FROM (FROM py UNION ALL FROM db) WHERE {_DIGIT}
  UNION ALL SELECT repo, path, 'smell', 'Low' FROM py, range(2) UNION ALL SELECT repo, path, 'smell', 'Low' FROM src WHERE {at(('tests/test_server.py',))}),
fn AS (SELECT *, line_end - line_start + 1 AS len, CASE WHEN complexity >= 10 OR line_end - line_start + 1 > 100 THEN 'Medium' ELSE 'Low' END AS severity FROM functions),
todo AS (SELECT repo, path FROM py UNION ALL SELECT repo, path FROM src WHERE {at(('setup.py',))}),
items AS (SELECT repo, 'security' AS category, severity, count(*) AS n, count(*) * CASE severity WHEN 'Critical' THEN 4.0 ELSE 3.0 END AS hours, min(path) AS file, count(*) || ' ' || severity || ' severity security finding(s) requiring remediation' AS title FROM f WHERE kind = 'security' GROUP BY repo, severity
  UNION ALL SELECT repo, 'code_smells', 'High', count(*), count(*) * 2.0, min(path), count(*) || ' high-severity code smell(s)' FROM f WHERE kind = 'smell' AND severity = 'High' GROUP BY repo
  UNION ALL SELECT repo, 'code_smells', 'Medium', count(*), count(*) * 1.0, min(path), count(*) || ' medium-severity code smell(s)' FROM f WHERE kind = 'smell' AND severity = 'Medium' GROUP BY repo
  UNION ALL SELECT repo, 'duplication', 'Medium', 3, 4.5, path_a, '3 duplicated code block(s) (~21 duplicated lines)' FROM both_scripts
  UNION ALL SELECT repo, 'complexity', 'Medium', count(*), count(*) * 1.5, min(path), count(*) || ' medium-complexity function(s)' FROM fn WHERE severity = 'Medium' GROUP BY repo
  UNION ALL SELECT repo, 'long_functions', 'Medium', count(*), count(*) * 1.0, min(path), count(*) || ' function(s) longer than 80 lines' FROM fn WHERE len > 80 GROUP BY repo
  UNION ALL SELECT repo, 'unfinished_work', 'Low', count(*), count(*) * 0.5, min(path), count(*) || ' TODO/FIXME/HACK marker(s) in source' FROM todo GROUP BY repo
  UNION ALL SELECT repo, 'large_files', 'Low', 1, 2.0, path, '1 source file(s) exceed 100 lines' FROM db
  UNION ALL SELECT repo, 'dependencies', arg_min(severity, (CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, path)), count(*), count(*) * 2.0, min(path), count(*) || ' dependency(ies) with known vulnerabilities' FROM classified WHERE status = 'known_vulnerable' GROUP BY repo
  UNION ALL SELECT repo, 'dependencies', 'Low', count(*), count(*) * 1.0, min(path), count(*) || ' outdated dependency(ies)' FROM classified WHERE status = 'outdated' GROUP BY repo)"""


def debt_inputs(spark: SparkSession, d: str) -> list[DataFrame]:
    """The six inputs of ``debt.items``."""
    own = repo_files(spark, d).where(~tree.is_ignored(F.col("path")))
    sources = tree.source_paths(own).select("repo", "file_id", "path", "content")
    pairs = clones.clone_report(sources, most=1 << 30).select("repo", F.col("path_a").alias("path"), "duplicated_lines")
    shown = complexity.reported(functions(spark, d), least=1, most=1 << 30)
    lines = sources.select("repo", "path", F.size(text.split_lines(F.col("content"))).alias("lines"))
    todos = rules.todo_markers(sources.select("repo", "file_id", "path", F.posexplode(text.split_lines(F.col("content"))).alias("line_no", "line")))
    return [rules.scan(sources), pairs, shown, todos, lines, classified(spark, d)]


def debt_of(spark: SparkSession, d: str) -> DataFrame:
    return debt.items(*debt_inputs(spark, d), large_file=100)


@query(DEBT + """, gf AS (SELECT repo, count(*) FILTER (kind = 'security') AS security, count(*) FILTER (kind = 'security' AND severity = 'Critical') AS critical_security, count(*) FILTER (kind = 'security' AND severity = 'High') AS high_security, count(*) FILTER (kind = 'smell') AS smells FROM f GROUP BY repo),
dep AS (SELECT repo, count(*) AS dependencies, count(*) FILTER (status = 'known_vulnerable') AS vulnerable FROM classified GROUP BY repo), cp AS (SELECT repo, CAST(3 AS BIGINT) AS duplicates FROM both_scripts), it AS (SELECT repo, count(*) AS debt FROM items GROUP BY repo), cx AS (SELECT repo, count(*) AS complexity FROM fn GROUP BY repo),
nf AS (SELECT repo, count(*) AS files FROM src GROUP BY repo), av AS (SELECT repo, files, coalesce(security, 0) AS security, coalesce(critical_security, 0) AS critical_security, coalesce(high_security, 0) AS high_security, coalesce(smells, 0) AS smells, coalesce(dependencies, 0) AS dependencies, coalesce(vulnerable, 0) AS vulnerable,
  coalesce(duplicates, 0) AS duplicates, coalesce(debt, 0) AS debt, coalesce(complexity, 0) AS complexity, CAST(0 AS BIGINT) AS high_complexity FROM nf LEFT JOIN gf USING (repo) LEFT JOIN dep USING (repo) LEFT JOIN cp USING (repo) LEFT JOIN it USING (repo) LEFT JOIN cx USING (repo))
SELECT *, concat_ws(' ', 'The latest scan analyzed ' || files || ' file(s) and recorded ' || security || ' security finding(s), ' || smells || ' code smell(s), ' || dependencies || ' tracked dependenc(ies), ' || duplicates || ' duplicate code block(s), ' || debt || ' technical debt item(s), and ' || high_complexity || ' high-complexity function(s).',
  CASE WHEN vulnerable > 0 THEN vulnerable || ' dependenc(y/ies) match known vulnerability advisories.' END, CASE WHEN critical_security + high_security > 0 THEN (critical_security + high_security) || ' security finding(s) are rated Critical or High and should be reviewed first.' END,
  CASE WHEN security = 0 AND smells = 0 AND duplicates = 0 THEN 'The deterministic scanners reported no issues for this scan.' END) AS summary FROM av""")
def repository_overview(spark: SparkSession, d: str) -> DataFrame:
    """What a scan counted in each repository, and the sentence on it."""
    found, pairs, shown, todos, lines, packages = debt_inputs(spark, d)
    return debt.overview(lines, found, pairs, shown, packages, debt.items(found, pairs, shown, todos, lines, packages, large_file=100))


@query(DEBT + """ SELECT repo, category, severity, CAST(n AS BIGINT) AS n, round(hours, 1)::DOUBLE AS hours, file, title FROM items""")
def technical_debt(spark: SparkSession, d: str) -> DataFrame:
    """Items of all eleven kinds; functions of any complexity and files over a hundred lines, for every kind to occur."""
    return debt_of(spark, d)


@query(DEBT + """ SELECT repo, category, severity, CAST(n AS BIGINT) AS n, round(hours, 1)::DOUBLE AS hours, file, title, CAST(row_number() OVER (PARTITION BY repo ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, title) AS INTEGER) AS place, count(*) OVER w AS items,
round(sum(hours) OVER w, 1)::DOUBLE AS total_hours, CAST(greatest(0, 100 - sum(CASE severity WHEN 'Critical' THEN 8 WHEN 'High' THEN 5 WHEN 'Medium' THEN 2 ELSE 1 END) OVER w) AS INTEGER) AS score FROM items WHERE category = 'dependencies' WINDOW w AS (PARTITION BY repo)""")
def debt_report(spark: SparkSession, d: str) -> DataFrame:
    """The items of one category with their own summary."""
    return debt.report(debt_of(spark, d), "Dependencies")


@query(DEBT + """, h AS (SELECT repo, file, round(sum(hours), 1)::DOUBLE AS hours FROM items GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY hours DESC, file) AS INTEGER) AS place FROM h QUALIFY place <= 5""")
def debt_areas(spark: SparkSession, d: str) -> DataFrame:
    return debt.top_areas(debt_of(spark, d))

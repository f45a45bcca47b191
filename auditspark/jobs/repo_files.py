"""Queries over whole repositories: trees, manifests, complexity, architecture, health.

The oracles state what each template of ``sources.repos`` must give, worked out by hand, and combine it in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.functions import text
from auditspark.operators import complexity, dependencies, external, health, inventory, manifests, rules, tree
from auditspark.sources.repos import CTE, TEMPLATES, expected, literal, repo_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = f"WITH {CTE}{oracle}"
        return f

    return add


#: Templates on ignored paths, and those that are sources.
IGNORED = ("gradle/build.gradle", "node_modules/x/i_§.js", ".github/workflows/ci_§.yml", "assets/logo_§.png", "web/site_§.min.js", "core/rebuild_§.py")
SOURCES = tuple(p for p, _ in TEMPLATES if p.rsplit(".", 1)[-1] in ("py", "js", "jsx", "tsx", "ts", "java", "go", "rb") and p not in IGNORED)
BLANK = ("tests/conftest.py", "core/__init__.py")
NUMBER = {p: k for k, (p, _) in enumerate(TEMPLATES)}


def at(paths: tuple[str, ...]) -> str:
    return "t IN (" + ", ".join(str(NUMBER[p]) for p in paths) + ")"


@query(" SELECT repo, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, false AS truncated FROM repo_files GROUP BY repo")
def repo_tree(spark: SparkSession, d: str) -> DataFrame:
    return tree.tree_summary(repo_files(spark, d))


@query(f" SELECT repo, path, size, CAST(row_number() OVER (PARTITION BY repo ORDER BY size, path) AS INTEGER) AS place FROM repo_files WHERE {at(SOURCES)}")
def source_paths(spark: SparkSession, d: str) -> DataFrame:
    return tree.source_paths(repo_files(spark, d)).select("repo", "path", "size", "place")


@query(f" SELECT repo, path, {at(IGNORED)} AS ignored FROM repo_files")
def ignored_paths(spark: SparkSession, d: str) -> DataFrame:
    return repo_files(spark, d).select("repo", "path", tree.is_ignored(F.col("path")).alias("ignored"))


@query(""" SELECT repo, path, v.ecosystem FROM repo_files JOIN (VALUES """ + ", ".join(f"({k}, {literal(tree.MANIFESTS[p.rsplit('/', 1)[-1]])})" for p, k in NUMBER.items() if p.rsplit("/", 1)[-1] in tree.MANIFESTS and p not in IGNORED) + ") v(t, ecosystem) USING (t)")
def manifest_paths(spark: SparkSession, d: str) -> DataFrame:
    return tree.manifests(repo_files(spark, d)).select("repo", "path", "ecosystem")


@query(" SELECT repo, path FROM repo_files WHERE path LIKE 'tests/test\\_%.py' ESCAPE '\\' OR path LIKE '%.md'")
def glob_paths(spark: SparkSession, d: str) -> DataFrame:
    own = repo_files(spark, d).select("repo", "path")
    return tree.by_glob(own, "tests/test_*.py").union(tree.by_glob(own, "*.m[dD]"))


@query(f""", s AS (SELECT repo, path, size, content, row_number() OVER (PARTITION BY repo ORDER BY size, path) AS place FROM repo_files WHERE {at(SOURCES)} AND NOT {at(BLANK)} AND size <= 262144)
SELECT repo, path, CAST(least(60, len(string_split(rtrim(content, chr(10)), chr(10)))) AS INTEGER) AS lines FROM s WHERE place <= 8""")
def fetched_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources read within a budget of eight files, each cut to sixty lines."""
    return tree.fetched_sources(repo_files(spark, d), most_files=8, most_lines=60).select("repo", "path", F.size("lines").alias("lines"))


@query(f""", l AS (SELECT repo, CASE regexp_extract(path, '([^.]*)$', 1) WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'jsx' THEN 'JavaScript' WHEN 'ts' THEN 'TypeScript' WHEN 'tsx' THEN 'TypeScript' WHEN 'java' THEN 'Java' WHEN 'go' THEN 'Go' WHEN 'rb' THEN 'Ruby' END AS language FROM repo_files WHERE {at(SOURCES)})
SELECT repo, language, count(*) AS files FROM l GROUP BY ALL""")
def repo_languages(spark: SparkSession, d: str) -> DataFrame:
    return tree.languages(repo_files(spark, d))


@query(f""", c AS (SELECT repo, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS name, count(*) AS file_count FROM repo_files WHERE NOT {at(IGNORED)} GROUP BY ALL)
SELECT repo, name, file_count, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_count DESC, name) AS place FROM c) WHERE place <= 12 AND (file_count >= 2 OR name = '(root)')""")
def repo_components(spark: SparkSession, d: str) -> DataFrame:
    return tree.components(repo_files(spark, d))


@query(f""", e AS (SELECT repo, path, CASE WHEN contains(path, '/') THEN 'package' ELSE 'root' END AS level FROM repo_files WHERE {at(("app/main.py", "api/server.js", "index.js", "core/__init__.py"))})
SELECT repo, path, level, CAST(row_number() OVER (PARTITION BY repo ORDER BY level DESC, path) AS INTEGER) AS place FROM e""")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    return tree.entry_points(repo_files(spark, d))


@query(f""", o AS (SELECT * FROM repo_files WHERE NOT {at(IGNORED)} AND split_part(path, '/', 1) NOT IN ('web', 'api')),
c AS (SELECT repo, count(*) FILTER (path LIKE '%.ts' OR path LIKE '%.tsx' OR path LIKE '%.jsx' OR path LIKE '%.py' AND t % 2 = 0) AS scripts, count(*) FILTER (path LIKE '%.py') AS pythons FROM o GROUP BY repo)
SELECT repo, scripts, pythons FROM c WHERE scripts > 0 AND pythons > 0""")
def mixed_stack(spark: SparkSession, d: str) -> DataFrame:
    """Repositories without their web and api directories; every second Python file stands for a script as well."""
    own = repo_files(spark, d).where(~F.substring_index("path", "/", 1).isin("web", "api"))
    extra = own.where(F.col("path").endswith(".py") & (F.col("t") % 2 == 0)).withColumn("path", F.concat("path", F.lit(".tsx")))
    return tree.mixed_stack(own.unionByName(extra))


@query(f""", n AS (SELECT repo, split_part(path, '/', 1) AS name, bool_or(contains(path, '/')) AS is_dir, count(*) AS files FROM repo_files WHERE NOT {at(IGNORED)} GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY name) AS INTEGER) AS place FROM n QUALIFY place <= 12""")
def folder_tree(spark: SparkSession, d: str) -> DataFrame:
    return tree.folder_tree(repo_files(spark, d), 12)


TESTS = ("tests/test_util_§.py", "tests/test_server.py", "tests/conftest.py", "web/vitest.config.ts")
STEMS = f""", n AS (SELECT *, regexp_replace(parse_filename(path, false, '/'), '\\.[^.]*$', '') AS stem FROM repo_files WHERE NOT {at(IGNORED)}),
src AS (SELECT * FROM n WHERE {at(tuple(p for p in SOURCES if p not in TESTS))}), tst AS (SELECT * FROM n WHERE {at(TESTS)}),
untested AS (SELECT repo, path FROM src WHERE stem NOT IN ('setup', 'manage', 'wsgi', 'asgi', '__init__', 'app', 'main') AND NOT EXISTS (SELECT 1 FROM tst WHERE tst.repo = src.repo AND (contains(tst.stem, src.stem) OR contains(src.stem, tst.stem))))"""


@query(STEMS + " SELECT * FROM untested")
def untested_sources(spark: SparkSession, d: str) -> DataFrame:
    return tree.untested_sources(repo_files(spark, d))


@query(STEMS + """, f AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS p FROM src QUALIFY p <= 5)
SELECT repo, count(*) AS checked, CAST(round_even(100 * avg(CASE WHEN contains(content, '\"\"\"') OR contains(content, '/*') THEN 1 ELSE 0 END), 0) AS INTEGER) AS percent FROM f GROUP BY repo""")
def docstring_coverage(spark: SparkSession, d: str) -> DataFrame:
    return tree.docstring_coverage(repo_files(spark, d))


@query(f" SELECT repo, path, round(size / 1024, 2) AS size_kb FROM repo_files WHERE {at(('services/db.py', 'web/jest.config.js'))}")
def security_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """Paths with a telling word of their own; in ``auth_7`` the word goes on."""
    return tree.hotspots(repo_files(spark, d))


@query(STEMS + f""", u AS (SELECT repo, count(*) AS missing FROM untested GROUP BY repo),
c AS (SELECT repo, count(*) FILTER (path = 'README.md') AS readmes, count(*) FILTER ({at(TESTS)}) AS tests, count(*) FILTER ({at(tuple(p for p in SOURCES if p not in TESTS))}) AS sources,
  count(*) FILTER ({at(tuple(p for p in SOURCES if p not in TESTS))} AND size > 512000) AS large FROM repo_files WHERE NOT {at(IGNORED)} GROUP BY repo)
SELECT repo, readmes, tests, sources, large, coalesce(missing, 0) AS missing, CAST(greatest(0, 100 - CASE WHEN readmes = 0 THEN 20 ELSE 0 END - CASE WHEN tests = 0 THEN 20 WHEN coalesce(missing, 0) > 0.5 * sources THEN 10 ELSE 0 END - least(15, 5 * large)) AS INTEGER) AS score,
  concat_ws('; ', CASE WHEN readmes = 0 THEN 'Missing README.md (-20)' END, CASE WHEN tests = 0 THEN 'No test files detected (-20)' WHEN coalesce(missing, 0) > 0.5 * sources THEN 'Over 50% of source files lack test cases (-10)' END,
    CASE WHEN large > 0 THEN large || ' large files detected (-' || least(15, 5 * large) || ')' END) AS deductions FROM c LEFT JOIN u USING (repo)""")
def repository_health(spark: SparkSession, d: str) -> DataFrame:
    return health.health_report(repo_files(spark, d))


@query(", " + expected("m", "line_count, imports, functions, classes, exports", {
    "app/main.py": [(17, "import os, core.util|from services import api", "get|run_§", "Box", "")],
    "core/util_§.py": [(17, "import os, core.util|from services import api", "get|run_§", "Box", "")],
    "services/auth_§.py": [(5, "", "login", "", "")],
    "services/db.py": [(122, "", "long_§", "", "")],
    "api/server.js": [(10, "import React from 'react';|import { a } from './core/x';", "load|pick_§", "View", "export function load(a, b) {|export class View { }")],
    "web/view_§.tsx": [(10, "import React from 'react';|import { a } from './core/x';", "load|pick_§", "View", "export function load(a, b) {|export class View { }")],
    "web/components/list_§.jsx": [(1, "", "", "", "export const items = [§];")],
    "svc/App_§.java": [(4, "import java.util.List;", "", "App|Other", "")],
    "svc/run_§.go": [(7, "import (", "Run", "", "")],
    "index.js": [(2, "", "", "", "")],
    "web/vitest.config.ts": [(1, "", "", "", "export default {}")],
    "tests/test_util_§.py": [(5, "", "test_a|test_b", "", "")],
    "setup.py": [(3, "from setuptools import setup", "", "", "")],
}) + " SELECT repo, path, CAST(line_count AS INTEGER) AS line_count, imports, functions, classes, exports FROM m")
def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Sources of the templates whose metadata the oracle lists."""
    known = ("app/main.py", "core/util_", "services/", "api/server.js", "web/view_", "web/components/", "svc/App_", "svc/run_", "index.js", "web/vitest", "tests/test_util_", "setup.py")
    own = repo_files(spark, d).where(F.col("path").rlike("^(" + "|".join(known) + ")"))
    joined = [F.array_join(c, "|").alias(c) for c in ("imports", "functions", "classes", "exports")]
    return tree.file_metadata(own).select("repo", "path", "line_count", *joined)


PACKAGES = expected("packages", "ecosystem, pos, name, spec, resolved", {
    "requirements.txt": [("pip", 0, "flask", "==0.12.§", "0.12.§"), ("pip", 1, "requests", ">=2.19", None), ("pip", 2, "celery", "~=1.§", "1.§"), ("pip", 3, "pandas", None, None), ("pip", 4, "Django", "== 2.1", "2.1")],
    "app/pyproject.toml": [("pip", 0, "fastapi", ">=0.§.1", "0.§.1"), ("pip", 1, "redis", "==4.§", "4.§"), ("pip", 2, "plain", None, None), ("pip", 3, "sqlalchemy", "~1.4.§", "1.4.§"), ("pip", 4, "local", "*", None)],
    "web/package.json": [("npm", 0, "react", "^17.0.§", "17.0.§"), ("npm", 1, "lodash", "4.17.§", "4.17.§"), ("npm", 2, "jest", "26.x", None)],
    "svc/go.mod": [("go", 0, "github.com/gin-gonic/gin", "v1.§.0", "1.§.0"), ("go", 1, "golang.org/x/net", "v0.0.1", "0.0.1")],
    "Gemfile": [("bundler", 0, "rails", "~> 6.§", "6.§"), ("bundler", 1, "rack", None, None), ("bundler", 2, "puma", "x§", None)],
    "Gemfile.lock": [("bundler", 0, "rack", "2.2.§", "2.2.§"), ("bundler", 1, "rails", "6.1", "6.1")],
    "poetry.lock": [("pip", 0, "attrs", "21.§.0", "21.§.0"), ("pip", 1, "idna", "3.1", "3.1")],
    "Pipfile.lock": [("pip", 0, "flask", "1.0.§", "1.0.§"), ("pip", 1, "six", None, None), ("pip", 2, "pytest", "6.§", "6.§")],
    "core/Cargo.toml": [("cargo", 0, "serde", "1.0.§", "1.0.§"), ("cargo", 1, "tokio", None, None), ("cargo", 2, "rand", "^0.8", "0.8")],
    "core/Cargo.lock": [("cargo", 0, "serde", "1.0.§", "1.0.§"), ("cargo", 1, "rand", "0.8.5", "0.8.5")],
    "svc/pom.xml": [("maven", 0, "org.x:core§", "2.§.1", "2.§.1"), ("maven", 1, "a.b:c", "${v}", None)],
    "composer.json": [("composer", 0, "monolog/monolog", "^2.§", "2.§"), ("composer", 1, "phpunit/phpunit", "9.5.§", "9.5.§")],
    "gradle/build.gradle": [("gradle", 0, "com.x:lib", "1.§", "1.§"), ("gradle", 1, "junit:junit", "4.13", "4.13"), ("gradle", 2, "a:b", "$v", None)],
})
SHOWN = "repo, path, ecosystem, CAST(pos AS INTEGER) AS pos, name, coalesce(spec, '') AS spec, coalesce(resolved, '') AS resolved"


def filled(df: DataFrame) -> DataFrame:
    return df.withColumn("spec", F.coalesce("spec", F.lit(""))).withColumn("resolved", F.coalesce("resolved", F.lit("")))


@query(f", {PACKAGES} SELECT {SHOWN} FROM packages")
def manifest_parse(spark: SparkSession, d: str) -> DataFrame:
    """Packages of all manifests, those on ignored paths too."""
    return filled(manifests.manifest_rows(repo_files(spark, d), ignored=True)).select("repo", "path", "ecosystem", "pos", "name", "spec", "resolved")


@query(f", {PACKAGES} SELECT {SHOWN} FROM packages QUALIFY row_number() OVER (PARTITION BY repo, ecosystem, lower(name), coalesce(resolved, spec, '') ORDER BY path, pos) = 1")
def unique_packages(spark: SparkSession, d: str) -> DataFrame:
    own = manifests.unique_packages(manifests.manifest_rows(repo_files(spark, d), ignored=True))
    return filled(own).select("repo", "path", "ecosystem", "pos", "name", "spec", "resolved")


#: ecosystem, name, order, range, advisory, severity; and the newest major version of some packages. Examples, not a feed.
ADVISORIES = (("pip", "flask", 1, "<0.12.3", "CVE-2018-1000656", "High"), ("pip", "flask", 2, "<1.0", "PYSEC-1", "Medium"), ("npm", "lodash", 1, "<4.17.19", "GHSA-p6mc", "Critical"), ("cargo", "serde", 1, "<=1.0.5", "RUSTSEC-1", "Low"))
LATEST = (("pip", "celery", 5), ("npm", "react", 18), ("bundler", "rails", 8), ("composer", "phpunit/phpunit", 12))


def classified(spark: SparkSession, d: str) -> DataFrame:
    own = manifests.unique_packages(manifests.manifest_rows(repo_files(spark, d))).withColumn("id", F.concat_ws("\t", F.col("repo").cast("string"), "path", F.col("pos").cast("string")))
    advisories = spark.createDataFrame(ADVISORIES, "ecosystem string, name string, ord int, range string, advisory string, advisory_severity string")
    latest = spark.createDataFrame(LATEST, "ecosystem string, name string, latest_major int")
    done = dependencies.classify(own, advisories, latest).withColumn("path", F.element_at(F.split("id", "\t"), 2))
    return done.withColumn("repo", F.element_at(F.split("id", "\t"), 1).cast("long")).withColumn("url", manifests.advisory_url(F.col("advisory")))


REPORT = f""", {PACKAGES}, u AS (SELECT *, coalesce(TRY_CAST(split_part(resolved, '.', 1) AS INTEGER), 0) AS a, coalesce(TRY_CAST(split_part(resolved, '.', 2) AS INTEGER), 0) AS b, coalesce(TRY_CAST(split_part(resolved, '.', 3) AS INTEGER), 0) AS c
  FROM packages WHERE path <> 'gradle/build.gradle' QUALIFY row_number() OVER (PARTITION BY repo, ecosystem, lower(name), coalesce(resolved, spec, '') ORDER BY path, pos) = 1),
k AS (SELECT *, CASE WHEN resolved IS NULL THEN '' WHEN name = 'flask' AND (a, b, c) < (0, 12, 3) THEN 'CVE-2018-1000656' WHEN name = 'flask' AND (a, b, c) < (1, 0, 0) THEN 'PYSEC-1' WHEN name = 'lodash' AND (a, b, c) < (4, 17, 19) THEN 'GHSA-p6mc' WHEN name = 'serde' AND (a, b, c) <= (1, 0, 5) THEN 'RUSTSEC-1' ELSE '' END AS advisory FROM u),
s AS (SELECT *, CASE WHEN advisory <> '' THEN 'known_vulnerable' WHEN resolved IS NOT NULL AND (name = 'celery' AND a < 4 OR name = 'react' AND a < 17 OR name = 'rails' AND a < 7 OR name = 'phpunit/phpunit' AND a < 11) THEN 'outdated' ELSE 'unknown' END AS status,
  CASE advisory WHEN 'CVE-2018-1000656' THEN 'High' WHEN 'PYSEC-1' THEN 'Medium' WHEN 'GHSA-p6mc' THEN 'Critical' WHEN 'RUSTSEC-1' THEN 'Low' ELSE '' END AS severity FROM k),
classified AS (SELECT *, count(*) OVER w AS total, count(*) FILTER (status = 'known_vulnerable') OVER w AS vulnerable, count(*) FILTER (status = 'outdated') OVER w AS outdated,
  CASE WHEN advisory LIKE 'CVE-%' THEN 'https://nvd.nist.gov/vuln/detail/' || advisory WHEN advisory LIKE 'GHSA-%' OR advisory LIKE 'PYSEC-%' THEN 'https://github.com/advisories/' || advisory ELSE '' END AS url FROM s WINDOW w AS (PARTITION BY repo))"""


@query(REPORT + """ SELECT repo, path, name, status, severity, advisory, url, total, vulnerable, outdated FROM classified WHERE status = 'known_vulnerable'""")
def dependency_report(spark: SparkSession, d: str) -> DataFrame:
    """The vulnerable packages, beside counts of all."""
    return manifests.report(classified(spark, d), status="Known_Vulnerable").select("repo", "path", "name", "status", "severity", "advisory", "url", "total", "vulnerable", "outdated")


@query(REPORT + """ SELECT repo, string_agg(DISTINCT path, ',' ORDER BY path) AS manifests, string_agg(DISTINCT ecosystem, ',' ORDER BY ecosystem) AS ecosystems, count(*) FILTER (status <> 'unknown') AS issues FROM classified GROUP BY repo""")
def dependency_sources(spark: SparkSession, d: str) -> DataFrame:
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return classified(spark, d).groupBy("repo").agg(listed("path").alias("manifests"), listed("ecosystem").alias("ecosystems"), F.count_if(F.col("status") != "unknown").alias("issues"))


FUNCTIONS = expected("functions", "name, line_start, line_end, complexity, nesting", {
    "app/main.py": [("Box.get", 6, 13, 10, 5), ("run_§", 15, 17, 2, 0)],
    "core/util_§.py": [("Box.get", 6, 13, 10, 5), ("run_§", 15, 17, 2, 0)],
    "services/auth_§.py": [("login", 3, 5, 1, 0)],
    "services/db.py": [("long_§", 1, 122, 1, 0)],
    "api/server.js": [("load", 4, 8, 8, 4), ("pick_§", 9, 9, 4, 2)],
    "web/view_§.tsx": [("load", 4, 8, 8, 4), ("pick_§", 9, 9, 4, 2)],
    "tests/test_util_§.py": [("test_a", 1, 2, 2, 0), ("test_b", 4, 5, 1, 0)],
    "index.js": [("f", 2, 2, 2, 1)],
})


def functions(spark: SparkSession, d: str) -> DataFrame:
    own = repo_files(spark, d)
    return complexity.file_complexity(own.where(~tree.is_ignored(F.col("path"))).select("repo", "file_id", "path", "content"))


@query(f", {FUNCTIONS} SELECT repo, path, name, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, CAST(complexity AS INTEGER) AS complexity, CAST(nesting AS INTEGER) AS nesting FROM functions")
def complexity_by_function(spark: SparkSession, d: str) -> DataFrame:
    return functions(spark, d).drop("file_id")


@query(f""", {FUNCTIONS}, r AS (SELECT *, line_end - line_start + 1 AS length_lines, CASE WHEN complexity >= 10 THEN 'Medium' ELSE 'Low' END AS severity FROM functions WHERE complexity >= 8)
SELECT repo, path, name, CAST(complexity AS INTEGER) AS complexity, CAST(length_lines AS INTEGER) AS length_lines, severity, CASE WHEN path LIKE '%.py' THEN 'Python' WHEN path LIKE '%.tsx' THEN 'TypeScript' ELSE 'JavaScript' END AS language,
  CAST(row_number() OVER (PARTITION BY repo ORDER BY complexity DESC, length_lines DESC, path, line_start, name) AS INTEGER) AS place FROM r QUALIFY place <= 3""")
def complexity_report(spark: SparkSession, d: str) -> DataFrame:
    return complexity.reported(functions(spark, d), 8, 3).select("repo", "path", "name", "complexity", "length_lines", "severity", "language", "place")


@query(f""", {FUNCTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY complexity DESC, line_end - line_start DESC, path, line_start, name) AS place FROM functions WHERE complexity >= 8 QUALIFY place <= 3),
s AS (SELECT repo, count(*) AS reported, count(*) FILTER (complexity >= 10) AS medium, string_agg(DISTINCT CASE WHEN path LIKE '%.py' THEN 'Python' WHEN path LIKE '%.tsx' THEN 'TypeScript' ELSE 'JavaScript' END, ',' ORDER BY CASE WHEN path LIKE '%.py' THEN 'Python' WHEN path LIKE '%.tsx' THEN 'TypeScript' ELSE 'JavaScript' END) AS languages FROM r GROUP BY repo)
SELECT repo, count(*) AS functions, round(avg(complexity), 2) AS average_complexity, coalesce(any_value(reported), 0) AS reported, CAST(0 AS BIGINT) AS high, coalesce(any_value(medium), 0) AS medium, coalesce(any_value(languages), '') AS languages, count(*) FILTER (complexity >= 8) > 3 AS capped FROM functions LEFT JOIN s USING (repo) GROUP BY repo""")
def complexity_summary(spark: SparkSession, d: str) -> DataFrame:
    return complexity.report_summary(functions(spark, d), 8, 3)


@query(f""" SELECT repo, path, 1 AS line, 'long_' || (file_id % 50) AS name, 121 AS length, 'High' AS severity FROM repo_files WHERE {at(('services/db.py',))}""")
def long_functions(spark: SparkSession, d: str) -> DataFrame:
    return rules.long_functions(repo_files(spark, d).where(~tree.is_ignored(F.col("path")))).select("repo", "path", "line", "name", "length", "severity")


@query(", " + expected("p", "line, name, params", {"app/main.py": [(6, "get", 7)], "core/util_§.py": [(6, "get", 7)]}) + " SELECT repo, path, CAST(line AS INTEGER) AS line, name, CAST(params AS INTEGER) AS params FROM p")
def parameter_lists(spark: SparkSession, d: str) -> DataFrame:
    """Parameter lists by the pattern of each language."""
    return rules.parameter_lists(repo_files(spark, d).where(~tree.is_ignored(F.col("path")))).select("repo", "path", "line", "name", "params")


IMPORTS = expected("named", "src, name", {
    "app/main.py": [("app", "os"), ("app", "services")],
    "core/util_§.py": [("core", "os"), ("core", "services")],
    "api/server.js": [("api", "react"), ("api", "lodash")],
    "web/view_§.tsx": [("web", "react"), ("web", "lodash")],
    "tests/test_server.py": [("tests", "server")],
    "svc/run_§.go": [("svc", "fmt"), ("svc", "util")],
    "setup.py": [("(root)", "setuptools")],
})
EDGES = f""", {IMPORTS}, tops AS (SELECT DISTINCT repo, split_part(path, '/', 1) AS name FROM repo_files WHERE contains(path, '/') AND NOT {at(IGNORED)}),
edges AS (SELECT n.repo, n.src, n.name AS dst, t.name IS NOT NULL AS internal, count(*) AS n FROM named n LEFT JOIN tops t ON t.repo = n.repo AND t.name = n.name WHERE t.name IS NULL OR n.src <> n.name GROUP BY ALL)"""


@query(EDGES + " SELECT * FROM edges")
def repo_import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Imports of Python, script and Go files between top directories, and of outside packages."""
    return rules.import_edges(repo_files(spark, d).where(~tree.is_ignored(F.col("path"))))


@query(EDGES + """, i AS (SELECT repo, 'internal' AS kind, src, dst, n, row_number() OVER (PARTITION BY repo ORDER BY n DESC, src, dst) AS place FROM edges WHERE internal),
x AS (SELECT repo, 'external' AS kind, '' AS src, dst, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (PARTITION BY repo ORDER BY sum(n) DESC, dst) AS place FROM edges WHERE NOT internal GROUP BY repo, dst)
SELECT repo, kind, src, dst, n, CAST(place AS INTEGER) AS place FROM (FROM i WHERE place <= 2 UNION ALL FROM x WHERE place <= 3)""")
def import_report(spark: SparkSession, d: str) -> DataFrame:
    return rules.import_report(rules.import_edges(repo_files(spark, d).where(~tree.is_ignored(F.col("path")))), 2, 3)


FRAME = {"flask": ("Flask", "Backend framework"), "celery": ("Celery", "Background jobs"), "Django": ("Django", "Backend framework"), "fastapi": ("FastAPI", "Backend framework"), "redis": ("Redis client", "Cache/Datastore"), "sqlalchemy": ("SQLAlchemy", "Database layer"), "react": ("React", "Frontend framework")}


@query(f""", {PACKAGES}, k(package, name, category) AS (VALUES {", ".join(f"({literal(p)}, {literal(n)}, {literal(c)})" for p, (n, c) in FRAME.items())}),
a AS (SELECT repo, k.name, category, 'Declared in ' || min(path) AS evidence FROM packages JOIN k ON k.package = packages.name WHERE path IN ('requirements.txt', 'app/pyproject.toml', 'web/package.json') GROUP BY ALL),
b AS (SELECT repo, CASE WHEN path = 'Dockerfile' THEN 'Docker' WHEN path LIKE '%nginx.conf' THEN 'nginx' ELSE 'Docker Compose' END AS name, CASE WHEN path LIKE '%nginx.conf' THEN 'Web server config' ELSE 'Containerization' END AS category, 'Found config file: ' || lower(path) AS evidence FROM repo_files WHERE {at(('Dockerfile', 'deploy/docker-compose.yml', 'deploy/nginx.conf'))}),
c AS (SELECT repo, CASE WHEN path LIKE 'tests/%' THEN 'pytest' WHEN path LIKE '%jest%' THEN 'Jest' ELSE 'Vitest' END AS name, 'Testing' AS category, CASE WHEN path LIKE 'tests/%' THEN 'Found: ' || path WHEN path LIKE '%jest%' THEN 'Found jest.config' ELSE 'Found vitest.config' END AS evidence FROM repo_files WHERE {at(('tests/conftest.py', 'web/jest.config.js', 'web/vitest.config.ts'))}),
d AS (SELECT repo, unnest(['PostgreSQL', 'Redis']) AS name, unnest(['Database', 'Cache/Broker']) AS category, unnest(['postgres', 'redis']) || ' service in ' || path AS evidence FROM repo_files WHERE {at(('deploy/docker-compose.yml',))})
FROM a UNION ALL FROM b UNION ALL FROM c UNION ALL FROM d""")
def frameworks(spark: SparkSession, d: str) -> DataFrame:
    own = repo_files(spark, d)
    named = ("package.json", "requirements.txt", "pyproject.toml", "go.mod", "Cargo.toml", "composer.json")
    declared = manifests.manifest_rows(own.where(F.substring_index("path", "/", -1).isin(*named)))
    return tree.frameworks(own, declared, own.select("repo", "path", "content"))


@query(f""", l AS (SELECT repo, count(DISTINCT CASE split_part(path, '/', 1) WHEN 'web' THEN 'f' WHEN 'api' THEN 'b' WHEN 'services' THEN 's' WHEN 'core' THEN 's' WHEN 'tests' THEN 't' WHEN 'scripts' THEN 'x' WHEN 'docs' THEN 'd' WHEN 'deploy' THEN 'i' END) AS layers, count(*) AS files, count(DISTINCT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END) AS tops,
  count(*) FILTER ({at(("app/main.py", "api/server.js", "index.js", "core/__init__.py"))}) AS entries FROM repo_files WHERE NOT {at(IGNORED)} GROUP BY repo){EDGES},
m AS (SELECT a.repo, count(*) AS cycles FROM edges a JOIN edges b ON a.repo = b.repo AND a.src = b.dst AND a.dst = b.src WHERE a.internal AND b.internal AND a.src < a.dst GROUP BY a.repo)
SELECT repo, files, tops, layers, entries, coalesce(cycles, 0) AS cycles FROM l LEFT JOIN m USING (repo)""")
def architecture_report(spark: SparkSession, d: str) -> DataFrame:
    """One row for each repository: files, top directories, layers, entry points and mutual imports."""
    own = repo_files(spark, d).where(~tree.is_ignored(F.col("path")))
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("(root)")
    facts = own.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.count_distinct(top).alias("tops"))
    counted = [external.layers(own).groupBy("repo").agg(F.count(F.lit(1)).alias("layers")), tree.entry_points(own).groupBy("repo").agg(F.count(F.lit(1)).alias("entries")), rules.mutual_imports(rules.import_edges(own)).groupBy("repo").agg(F.count(F.lit(1)).alias("cycles"))]
    for part in counted:
        facts = facts.join(part, "repo", "left")
    return facts.select("repo", "files", "tops", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("layers", "entries", "cycles")])


@query(f""", n AS (SELECT repo, path, string_split(path, '/') AS parts FROM repo_files WHERE NOT {at(IGNORED)}), e AS (SELECT repo, array_to_string(parts[:i], '/') AS node, i AS depth, i < len(parts) AS is_dir FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM n))
SELECT repo, node, parse_filename(node, false, '/') AS name, CASE WHEN contains(node, '/') THEN regexp_replace(node, '/[^/]*$', '') ELSE '' END AS parent, CAST(depth AS INTEGER) AS depth, is_dir, count(*) AS files FROM e GROUP BY ALL""")
def explorer_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All directories and files with their parents, ignored ones left out."""
    parts = F.split("path", "/")
    own = repo_files(spark, d).where(~tree.is_ignored(F.col("path")))
    nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("node"), F.element_at(parts, i).alias("name"), F.array_join(F.slice(parts, 1, i - 1), "/").alias("parent"), i.alias("depth"), (i < F.size(parts)).alias("is_dir")))
    return own.select("repo", F.explode(nodes).alias("n")).select("repo", "n.*").groupBy("repo", "node", "name", "parent", "depth", "is_dir").agg(F.count(F.lit(1)).alias("files"))


@query(f""" SELECT repo, path, CASE WHEN contains(content, 'def test_') THEN (length(content) - length(replace(content, 'def test_', ''))) // 9 WHEN trim(content, ' ' || chr(10)) <> '' THEN 1 ELSE 0 END AS tests FROM repo_files WHERE {at(TESTS)}""")
def test_counts(spark: SparkSession, d: str) -> DataFrame:
    own = repo_files(spark, d).where(~tree.is_ignored(F.col("path")) & inventory.is_test(F.col("path")))
    n = text.occurrences(F.col("content"), "def test_").cast("long")
    return own.select("repo", "path", F.when(n > 0, n).when(text.strip(F.col("content")) != "", 1).otherwise(0).alias("tests"))


@query(f""", l AS (SELECT repo, path, CASE WHEN path LIKE '%.py' THEN 'Python' WHEN path LIKE '%.js' OR path LIKE '%.jsx' THEN 'JavaScript' WHEN path LIKE '%.ts' OR path LIKE '%.tsx' THEN 'TypeScript' WHEN path LIKE '%.java' THEN 'Java' WHEN path LIKE '%.go' THEN 'Go' ELSE 'Ruby' END AS language,
  len(string_split(CASE WHEN content[-1:] = chr(10) THEN content[:-2] ELSE content END, chr(10))) - CASE WHEN content = '' THEN 1 ELSE 0 END AS lines FROM repo_files WHERE {at(SOURCES)})
SELECT repo, language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, arg_max(path, (lines, path)) AS largest FROM l GROUP BY ALL""")
def language_lines(spark: SparkSession, d: str) -> DataFrame:
    """Files, lines and the longest file of each language."""
    own = tree.source_paths(repo_files(spark, d))
    rows = own.select("repo", "path", inventory.language(F.col("path")).alias("language"), F.size(text.split_lines(F.col("content"))).alias("n"))
    return rows.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("lines"), F.max(F.struct("n", "path"))["path"].alias("largest"))


def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    return language_lines(spark, d).groupBy("repo").agg(F.sort_array(F.collect_list(F.struct((-F.col("files")).alias("f"), "language", "files", "lines"))).alias("l"), F.sum("files").alias("files"), F.sum("lines").alias("lines"))


@query(ORACLE["language_lines"].removeprefix(f"WITH {CTE}").replace("SELECT repo, language, count(*)", ", g AS (SELECT repo, language, count(*)").rstrip() + """)
SELECT repo, 'Files: ' || CAST(sum(files) AS BIGINT) || ', lines: ' || CAST(sum(lines) AS BIGINT) || '. Languages: ' || string_agg(language || ' ' || files || ' (' || lines || ' lines)', ', ' ORDER BY files DESC, language) AS summary FROM g GROUP BY repo""")
def repository_summary(spark: SparkSession, d: str) -> DataFrame:
    """A compact text on each repository."""
    parts = F.array_join(F.transform("l", lambda x: F.format_string("%s %d (%d lines)", x["language"], x["files"], x["lines"])), ", ")
    return summary_lines(spark, d).select("repo", F.concat(F.lit("Files: "), F.col("files").cast("string"), F.lit(", lines: "), F.col("lines").cast("string"), F.lit(". Languages: "), parts).alias("summary"))

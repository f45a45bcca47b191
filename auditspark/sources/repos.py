"""Whole repositories derived from the parts: sources, manifests, tests, documents, generated and ignored files.

Part ``k`` is one file: a repository takes ``len(TEMPLATES)`` parts in a row, each with the path and content of one
template, ``§`` standing for a number of the part; one file in seven is missing, other ones in each repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.sources.adapters import spread, table

PYTHON = '''"""Module §."""
import os, core.util
from services import api

class Box:
    def get(self, a, b, c, d, e, f):
        if a and b or c:
            for i in range(§):
                while d:
                    if e:
                        if f:
                            return [x for x in a if x]
        return eval(a)

def run_§(name):
    # TODO: case §
    return os.system("ls " + name) if name else None
'''
SCRIPT = '''import React from 'react';
import { a } from './core/x';
const y = require("lodash/fp");
export function load(a, b) {
  if (a && b) { return a ?? b; }
  for (const x of a) { while (x) { if (x.y) { el.innerHTML = x; } } }
  return a ? 1 : 2; // if
}
const pick_§ = async (q) => { switch (q) { case 1: return "{"; default: return q || §; } };
export class View { }
'''
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("README.md", "# Project §\n"),
    ("requirements.txt", "# pinned\nflask==0.12.§\nrequests>=2.19\n-r dev.txt\ncelery~=1.§\npandas\nDjango == 2.1\nbad[extra]==1.0\n"),
    ("app/pyproject.toml", '[project]\nname = "p§"\ndependencies = ["fastapi>=0.§.1", "redis==4.§", "plain"]\n[tool.poetry.dependencies]\npython = "^3.9"\nFastAPI = "^9.9"\nsqlalchemy = "~1.4.§"\nlocal = "*"\n[tool.x]\nz = "1"\n'),
    ("web/package.json", '{"dependencies": {"react": "^17.0.§", "lodash": "4.17.§"}, "devDependencies": {"jest": "26.x", "tool": {"version": "1.0.0"}}}'),
    ("svc/go.mod", "module x§\nrequire (\n\tgithub.com/gin-gonic/gin v1.§.0\n\tgolang.org/x/net v0.0.1\n)\n"),
    ("Gemfile", "source 'https://rubygems.org'\ngem 'rails', '~> 6.§'\ngem \"rack\"\n  gem 'puma', 'x§'\n"),
    ("Gemfile.lock", "GEM\n  specs:\n    rack (2.2.§)\n    rails (6.1)\n"),
    ("poetry.lock", '[[package]]\nname = "attrs"\nversion = "21.§.0"\n\n[[package]]\nname = "idna"\nversion = "3.1"\n'),
    ("Pipfile.lock", '{"default": {"flask": {"version": "==1.0.§"}, "six": {}}, "develop": {"pytest": {"version": "==6.§"}}}'),
    ("core/Cargo.toml", '[package]\nname = "c§"\n[dependencies]\nserde = "1.0.§"\n# note\ntokio = { version = "1" }\nrand = "^0.8"\n[features]\nx = "1"\n'),
    ("core/Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.§"\n\n[[package]]\nname = "rand"\nversion = "0.8.5"\n'),
    ("svc/pom.xml", "<x><dependency><groupId>org.x</groupId><artifactId>core§</artifactId><version>2.§.1</version></dependency>\n<dependency><groupId> a.b </groupId><artifactId>c</artifactId><version>${v}</version></dependency><dependency><groupId>z</groupId></dependency></x>"),
    ("composer.json", '{"require": {"php": ">=7.4", "monolog/monolog": "^2.§"}, "require-dev": {"phpunit/phpunit": "9.5.§"}}'),
    ("gradle/build.gradle", "dependencies {\n  implementation 'com.x:lib:1.§'\n  testImplementation \"junit:junit:4.13\"\n  api 'a:b:$v'\n}\n"),
    ("app/main.py", PYTHON),
    ("core/util_§.py", PYTHON),
    ("services/auth_§.py", '"""Auth."""\n\ndef login(user):\n    """Check."""\n    return user\n'),
    ("services/db.py", "def long_§():\n" + "    x = 1\n" * 120 + "    return x\n"),
    ("api/server.js", SCRIPT),
    ("web/view_§.tsx", SCRIPT),
    ("web/components/list_§.jsx", "export const items = [§];\n"),
    ("tests/test_util_§.py", "def test_a():\n    assert True\n\ndef test_b():\n    pass\n"),
    ("tests/test_server.py", "import server\n"),
    ("tests/conftest.py", ""),
    ("docs/guide_§.md", "Guide §\n"),
    ("node_modules/x/i_§.js", "module.exports = §\n"),
    ("Dockerfile", "FROM python:3.§\n"),
    ("deploy/docker-compose.yml", "services:\n  db: Postgres:§\n  cache: redis\n"),
    (".github/workflows/ci_§.yml", "on: push\n"),
    ("svc/App_§.java", "import java.util.List;\npublic class App { void go(int a) { } }\nfinal class Other {\n}\n"),
    ("svc/run_§.go", 'package run\nimport (\n"fmt"\n\t"x/core/util"\n)\nfunc Run(a int) {\n}\n'),
    ("assets/logo_§.png", ""),
    ("web/site_§.min.js", "x=§"),
    ("core/rebuild_§.py", "def rebuild():\n    pass\n"),
    ("index.js", 'const server = require("../api/server");\nvar f = function(a) { return a ? 1 : 2; }\n'),
    ("core/__init__.py", "   \n\n"),
    ("web/vitest.config.ts", "export default {}\n"),
    ("web/jest.config.js", "module.exports = {}\n"),
    ("deploy/nginx.conf", "server { }\n"),
    ("scripts/tool_§.rb", "puts §\n"),
    ("setup.py", "from setuptools import setup\n# FIXME pin\nsetup(name='p§')\n"),
)
N = len(TEMPLATES)
#: The factor of the size that the tree reports for one file in nine.
LARGE = 6000


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, file_id, t (template), path, content, size. A few bytes of a part make a whole file, so the parts are spread."""
    key = F.col("p_partkey")
    t, repo = (key % N).cast("int"), F.floor(key / N)
    pick = lambda k: F.replace(F.get(F.array(*[F.lit(x[k]) for x in TEMPLATES]), F.col("t")), F.lit("§"), (F.col("file_id") % 50).cast("string"))
    rows = spread(table(spark, sf_dir, "part").select("p_partkey")).select(repo.cast("long").alias("repo"), key.cast("long").alias("file_id"), t.alias("t")).where(F.col("file_id") % 7 != F.col("repo") % 7)
    size = F.octet_length("content").cast("long") * F.when(F.col("file_id") % 9 == 0, LARGE).otherwise(1)
    return rows.select("*", pick(0).alias("path"), pick(1).alias("content")).withColumn("size", size)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CTE = f"""repo_files AS (SELECT repo, file_id, t, path, content, octet_length(encode(content)) * CASE WHEN file_id % 9 = 0 THEN {LARGE} ELSE 1 END AS size FROM (SELECT p_partkey // {N} AS repo, CAST(p_partkey AS BIGINT) AS file_id, CAST(p_partkey % {N} AS INTEGER) AS t,
  replace(([{", ".join(literal(x[0]) for x in TEMPLATES)}])[p_partkey % {N} + 1], '§', CAST(p_partkey % 50 AS VARCHAR)) AS path,
  replace(([{", ".join(literal(x[1]) for x in TEMPLATES)}])[p_partkey % {N} + 1], '§', CAST(p_partkey % 50 AS VARCHAR)) AS content FROM part) WHERE file_id % 7 <> repo % 7)"""


def expected(name: str, columns: str, rows: dict[str, list[tuple]]) -> str:
    """SQL of rows that are known for each template, ``§`` standing for the file's number: repo, file_id, path and ``columns``."""
    at = {path: k for k, (path, _) in enumerate(TEMPLATES)}

    def value(v: object) -> str:
        return "NULL" if v is None else literal(v) if isinstance(v, str) else str(v)

    values = ", ".join(f"({at[path]}, {', '.join(map(value, row))})" for path, found in rows.items() for row in found)
    names = columns.split(", ")
    text = [isinstance(next(r[k] for found in rows.values() for r in found if r[k] is not None), str) for k in range(len(names))]
    shown = ", ".join(f"replace({c}, '§', CAST(file_id % 50 AS VARCHAR)) AS {c}" if is_text else c for c, is_text in zip(names, text))
    return f"{name} AS (SELECT repo, file_id, path, {shown} FROM repo_files JOIN (VALUES {values}) v(t, {columns}) USING (t))"

"""Source files derived from the order tables: a file for each order, a line for each of its items.

An item's numbers choose the line from ``LINES`` and the number that stands in it (for ``~``), so the corpus grows with the
tables and holds every construct that the rules look for, in ever new combinations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.sources.adapters import table

LINES = [
    "import os, json as js~", "from core import util", "import services.api", "x~ = os.system('ls ' + name)", "subprocess.run(cmd, shell=True)", "eval(code~)",
    "api_key = 'abcdefghijklmnop~'", "api_key = os.getenv('KEY')", "password: \"hunter@secret\"", "token_secret = 'changeme-please-now'", "db = 'postgresql://root:pw@host/db'", "cursor.execute('SELECT ' + col)",
    "cursor.execute(f\"SELECT {col~}\")", "el.innerHTML = value~;", "document.write(html)", "@csrf_exempt", "@app.get('/items/~')", "def list_items(user, a, b, c, d, e~):",
    "    return get_current_user()", "# TODO: fix case ~", "timeout = ~", "RETRIES = ~", "data = pickle.loads(raw)", "cfg = yaml.load(stream)",
    "requests.get(url=target~)", "path = os.path.join(base, user)", "localStorage.setItem('jwt', t~)", "alg = 'HS256'", "for i in range(~):", "                    deep = ~",
    "if a and b or c:", "    total = total + 1 if ok else 0", "const util = require('core/util')", "// FIXME handle ~", "value = js~ + util", "jwt.decode(tok, verify=False)",
    "exec(code~)", "set_cookie('jwt', t~)",
]


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, file_id, path, ord, line; the lines of a file stand in one partition, to which only their numbers were sent."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("l_quantity")).repartition("file_id")
    pick = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % len(LINES)
    key = F.col("file_id")
    line = F.replace(F.get(F.array(*map(F.lit, LINES)), pick.cast("int")), F.lit("~"), (F.col("l_partkey") % 500).cast("string"))
    top = F.get(F.array(*map(F.lit, ["core", "services", "web", "tools"])), (F.floor(key / 50) % 4).cast("int"))
    order = F.concat(F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0"), F.lpad(F.col("l_quantity").cast("string"), 3, "0"))
    path = F.concat(top, F.lit("/mod_"), key.cast("string"), F.when(key % 3 == 2, ".js").otherwise(".py"))
    return own.select((key % 50).alias("repo"), "file_id", path.alias("path"), order.alias("ord"), line.alias("line"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, file_id, path, content. A file has the items of one order, a handful of lines."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    return code_lines(spark, sf_dir).groupBy("repo", "file_id", "path").agg(F.array_join(lines, "\n").alias("content"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CTE = f"""code_lines AS (SELECT l_orderkey % 50 AS repo, l_orderkey AS file_id, (['core', 'services', 'web', 'tools'])[l_orderkey // 50 % 4 + 1] || '/mod_' || l_orderkey || CASE WHEN l_orderkey % 3 = 2 THEN '.js' ELSE '.py' END AS path,
  lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 3, '0') AS ord,
  replace(([{", ".join(map(_literal, LINES))}])[(l_partkey * 7 + l_suppkey * 3 + l_linenumber) % {len(LINES)} + 1], '~', CAST(l_partkey % 500 AS VARCHAR)) AS line FROM lineitem),
code_files AS (SELECT repo, file_id, path, string_agg(line, chr(10) ORDER BY ord) AS content FROM code_lines GROUP BY ALL),
numbered AS (SELECT repo, file_id, path, line, trim(line) AS stripped, CAST(row_number() OVER (PARTITION BY file_id ORDER BY ord) AS INTEGER) AS line_no FROM code_lines)"""

"""Queries over patches, dependencies and function complexity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions import text
from auditspark.operators import complexity, dependencies, patches, segments
from auditspark.sources.adapters import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def patch_table(spark: SparkSession, d: str) -> DataFrame:
    """The lines (patch_id, pos, line) of a patch for each user: a hunk for each fifteen events in time, a line for each event."""
    sign = F.when(F.col("event_type") == "click", "+").when(F.col("event_type") == "error", "-").when(F.col("event_type") == "view", "+").otherwise(" ")
    own = table(spark, d, "events").select(F.col("user_id").alias("patch_id"), "ts", "event_id", F.concat(sign, F.lit("line "), F.col("event_id").cast("string")).alias("line"))
    n, part = F.col("n"), F.floor(F.col("n") / 15)
    start = (n * 4 + 10).cast("string")
    header = F.concat(F.lit("@@ -"), start, F.lit(",15 +"), start, F.lit(",15 @@ part"))
    shown = F.struct((n + part + 1).alias("pos"), "line")
    rows = F.when(n % 15 == 0, F.array(F.struct((n + part).alias("pos"), header.alias("line")), shown)).otherwise(F.array(shown))
    return segments.positions(own, ["patch_id"], ["ts", "event_id"]).select("patch_id", F.explode(rows).alias("r")).select("patch_id", "r.*")


PATCH = """WITH e AS (SELECT user_id AS patch_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
s AS (SELECT *, n // 15 AS part, n // 15 * 60 + 10 AS start, CASE WHEN event_type = 'error' THEN '-' WHEN event_type IN ('click', 'view') THEN '+' ELSE ' ' END AS sign FROM e),
numbered AS (SELECT patch_id, event_id, n, part, sign, CAST(start + coalesce(sum(CASE WHEN sign = '-' THEN 0 ELSE 1 END) OVER (PARTITION BY patch_id, part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS number FROM s)"""


@query(PATCH + " SELECT patch_id, number, 'line ' || event_id AS text FROM numbered WHERE sign = '+'")
def patch_modified_lines(spark: SparkSession, d: str) -> DataFrame:
    return patches.added_lines(patch_table(spark, d))


@query(PATCH + """, t AS (SELECT DISTINCT patch_id, unnest([10, 12, 72, 75]) AS target FROM numbered)
SELECT t.patch_id, CAST(target AS INTEGER) AS target, CAST(coalesce(min(n + 2 + part), -1) AS INTEGER) AS position FROM t LEFT JOIN numbered m ON m.patch_id = t.patch_id AND m.number = target AND sign <> '-' GROUP BY ALL""")
def diff_position(spark: SparkSession, d: str) -> DataFrame:
    own = patch_table(spark, d)
    targets = own.select("patch_id").distinct().select("patch_id", F.explode(F.array(*map(F.lit, (10, 12, 72, 75)))).alias("target"))
    return patches.diff_position(own, targets).select("patch_id", "target", F.coalesce("position", F.lit(-1)).alias("position"))


@query(PATCH + """, f AS (SELECT user_id AS patch_id, event_id, CAST(10 + event_id % 80 AS INTEGER) AS line FROM events WHERE event_type = 'purchase')
SELECT f.* FROM f WHERE EXISTS (SELECT 1 FROM numbered m WHERE m.patch_id = f.patch_id AND m.number = f.line AND sign = '+') OR NOT EXISTS (SELECT 1 FROM numbered m WHERE m.patch_id = f.patch_id AND sign = '+')""")
def findings_on_modified_lines(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "events").where(F.col("event_type") == "purchase").select(F.col("user_id").alias("patch_id"), "event_id", (10 + F.col("event_id") % 80).cast("int").alias("line"))
    return patches.on_modified_lines(found, patch_table(spark, d)).select("patch_id", "event_id", "line")


def packages(spark: SparkSession, d: str) -> DataFrame:
    """Each part as a package of its name, in the version that its numbers make."""
    key = F.col("p_partkey")
    number = lambda n, m: (F.floor(key / n) % m).cast("string")
    resolved = F.when(key % 6 != 0, F.concat(number(1, 7), F.lit("."), number(7, 13), F.lit("."), number(3, 9)))
    return table(spark, d, "part").select(key.alias("id"), F.lower("p_type").alias("ecosystem"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"), resolved.alias("resolved"))


def advisories(spark: SparkSession, d: str) -> DataFrame:
    """For each name, three ranges whose bounds its letters make: derived from the parts."""
    names = packages(spark, d).select("ecosystem", "name").distinct()
    bound = F.length("name") % 5
    ranges = F.array(
        F.struct(F.lit(1).alias("ord"), F.concat(F.lit("<"), bound.cast("string"), F.lit(".3")).alias("range"), F.lit("Critical").alias("advisory_severity")),
        F.struct(F.lit(2).alias("ord"), F.concat(F.lit("<="), (bound + 1).cast("string"), F.lit(".5.2")).alias("range"), F.lit("High").alias("advisory_severity")),
        F.struct(F.lit(3).alias("ord"), F.lit("<9.0b1").alias("range"), F.lit("Low").alias("advisory_severity")),
    )
    return names.select("ecosystem", "name", F.explode(ranges).alias("r")).select("ecosystem", "name", "r.*", F.concat(F.lit("ADV-"), "name", F.lit("-"), F.col("r.ord").cast("string")).alias("advisory"))


DEPS = """WITH p AS (SELECT p_partkey AS id, lower(p_type) AS ecosystem, replace(p_name, ' ', '-') AS name, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 7 || '.' || p_partkey // 7 % 13 || '.' || p_partkey // 3 % 9 END AS resolved,
  p_partkey % 7 AS a, p_partkey // 7 % 13 AS b, p_partkey // 3 % 9 AS c, length(p_name) % 5 AS k FROM part),
s AS (SELECT *, CASE WHEN resolved IS NULL THEN 'unknown' WHEN (a, b, c) < (k, 3, 0) THEN 'c' WHEN (a, b, c) <= (k + 1, 5, 2) THEN 'h' WHEN a < 5 - 1 THEN 'outdated' ELSE 'unknown' END AS s FROM p),
done AS (SELECT id, ecosystem, name, resolved, CASE WHEN s IN ('c', 'h') THEN 'known_vulnerable' ELSE s END AS status, CASE s WHEN 'c' THEN 'Critical' WHEN 'h' THEN 'High' ELSE '' END AS severity, CASE s WHEN 'c' THEN 'ADV-' || name || '-1' WHEN 'h' THEN 'ADV-' || name || '-2' ELSE '' END AS advisory FROM s)"""


def classified(spark: SparkSession, d: str) -> DataFrame:
    own = packages(spark, d)
    latest = own.select("ecosystem", "name").distinct().withColumn("latest_major", F.lit(5))
    return dependencies.classify(own, advisories(spark, d), latest)


@query(DEPS + " SELECT id, ecosystem, name, coalesce(resolved, '') AS resolved, status, severity, advisory FROM done")
def dependency_classify(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).withColumn("resolved", F.coalesce("resolved", F.lit("")))


@query(DEPS + """ SELECT ecosystem, count(*) AS packages, count(*) FILTER (status = 'known_vulnerable') AS vulnerable, count(*) FILTER (status = 'outdated') AS outdated, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (severity = 'Critical') AS critical FROM done GROUP BY ecosystem""")
def dependency_summary(spark: SparkSession, d: str) -> DataFrame:
    count = lambda c, v: F.count_if(F.col(c) == v)
    return classified(spark, d).groupBy("ecosystem").agg(F.count(F.lit(1)).alias("packages"), count("status", "known_vulnerable").alias("vulnerable"), count("status", "outdated").alias("outdated"), count("status", "unknown").alias("unknown"), count("severity", "Critical").alias("critical"))


@query("""WITH i AS (SELECT o_custkey AS manifest_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, o_orderkey AS k FROM orders)
SELECT manifest_id, CAST(n AS INTEGER) AS pos, 'pkg_' || k % 97 AS name, CASE k % 5 WHEN 0 THEN '==' || k % 9 || '.1' WHEN 1 THEN '>=2,<3' WHEN 2 THEN '~=1.' || k % 9 ELSE '' END AS spec, CASE k % 5 WHEN 0 THEN k % 9 || '.1' WHEN 2 THEN '1.' || k % 9 ELSE '' END AS resolved FROM i WHERE k % 5 <> 4""")
def requirements_parse(spark: SparkSession, d: str) -> DataFrame:
    """Requirement files of each customer, a line for each order; one line in five is a comment, an option or has extras."""
    key = F.col("o_orderkey")
    n, kind = (key % 9).cast("string"), key % 5
    spec = F.when(kind == 0, F.concat(F.lit("=="), n, F.lit(".1"))).when(kind == 1, ">=2,<3").when(kind == 2, F.concat(F.lit(" ~=1."), n, F.lit(" "))).otherwise("")
    name = F.concat(F.lit("pkg_"), (key % 97).cast("string"))
    other = F.when(key % 3 == 0, "# comment").when(key % 3 == 1, "-r other.txt").otherwise(F.concat(name, F.lit("[extra]==1.0")))
    line = F.when(kind == 4, other).otherwise(F.concat(name, spec))
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("manifest_id"), "o_orderkey", line.alias("line"))
    manifests = segments.positions(own, ["manifest_id"], ["o_orderkey"], "pos").withColumn("pos", F.col("pos").cast("int"))
    return dependencies.requirements(manifests).withColumn("resolved", F.coalesce("resolved", F.lit("")))


@query("""SELECT s_suppkey AS manifest_id, CAST(0 AS INTEGER) AS pos, 'lib-' || s_nationkey AS name, '^' || s_suppkey % 5 || '.2.3' AS spec, s_suppkey % 5 || '.2.3' AS resolved FROM supplier
UNION ALL SELECT s_suppkey, 1, 'tool', '*', '' FROM supplier""")
def package_json_parse(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "supplier")
    content = F.concat(F.lit('{"dependencies": {"lib-'), F.col("s_nationkey").cast("string"), F.lit('": "^'), (F.col("s_suppkey") % 5).cast("string"), F.lit('.2.3"}, "devDependencies": {"tool": "*", "odd": {"version": "1.0.0"}}}'))
    found = dependencies.package_json(own.select(F.col("s_suppkey").alias("manifest_id"), content.alias("content")))
    return found.withColumn("resolved", F.coalesce("resolved", F.lit("")))


@query("""WITH c AS (SELECT l_orderkey AS file_id, count(*) AS n, 1 + sum(1 + CASE l_partkey % 6 WHEN 0 THEN 3 WHEN 3 THEN 0 WHEN 4 THEN 3 ELSE 1 END) AS cc FROM lineitem GROUP BY l_orderkey)
SELECT file_id % 50 AS repo, file_id, 'f' AS name, CAST(1 AS INTEGER) AS line_start, CAST(1 + 2 * n AS INTEGER) AS line_end, CAST(cc AS INTEGER) AS complexity, CAST(1 AS INTEGER) AS nesting,
  CASE WHEN cc >= 15 OR 1 + 2 * n > 150 THEN 'High' WHEN cc >= 10 OR 1 + 2 * n > 100 THEN 'Medium' ELSE 'Low' END AS severity FROM c""")
def complexity_python(spark: SparkSession, d: str) -> DataFrame:
    """Functions of source files made of each order's items, with a branch for each item by its numbers."""
    kind = F.col("l_partkey") % 6
    indent = F.lit("    ")
    branch = (
        F.when(kind == 0, "if a and b or c:").when(kind == 1, "for i in x:").when(kind == 2, "while x:").when(kind == 3, "with x:").when(kind == 4, "if [y for y in x if y]:").otherwise("if not a:")
    )
    block = F.concat(F.repeat(indent, F.lit(1)), branch, F.lit("\n"), F.repeat(indent, F.lit(2)), F.lit("x = a if b else c"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", block.alias("t"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["t"]), "\n")
    files = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.concat(F.lit("def f(a, b, c, x):\n"), body, F.lit("\n")).alias("content")).withColumn("repo", F.col("file_id") % 50)
    found = complexity.python_complexity(files)
    return found.withColumn("severity", complexity.severity(F.col("complexity"), F.col("line_end") - F.col("line_start") + 1))

"""The given tables as the entities of a code-audit service: repositories, scans, findings, files, events.

Each entity is a DataFrame for the operators; ``CTE`` has the same mapping in SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where a few unsplittable files would leave most of them idle; large inputs are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    connected = F.when(F.col("c_mktsegment") == "BUILDING", None).otherwise(F.col("c_mktsegment") != "MACHINERY")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("user_id"), connected.alias("is_connected"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each scan."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        key.alias("analysis_id"),
        F.col("o_custkey").alias("repo_id"),
        F.col("o_orderdate").alias("scanned_at"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"),
        F.when(priority == "5-LOW", None).otherwise(priority == "1-URGENT").alias("is_deleted"),
        F.when(key % 3 == 0, F.floor(key / 3)).alias("pull_request_id"),
        F.when(priority != "4-NOT SPECIFIED", F.lower(F.substring(priority, 3, 20))).alias("model"),
        (key % 1000).alias("prompt_tokens"),
        (key % 300).alias("completion_tokens"),
        (F.floor("o_totalprice") % 600).alias("duration"),
    )


def severity_of(quantity: Column) -> Column:
    return F.when(quantity >= 46, "Critical").when(quantity >= 36, "High").when(quantity >= 21, "Medium").when(quantity >= 6, "Low").otherwise("Info")


def file_of_part() -> Column:
    return F.concat(F.lit("src/part_"), (F.col("l_partkey") % 40).cast("string"), F.lit(".py"))


def findings(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """One row for each finding of a scan. ``ord`` is the order in which a scan reports them. ``items``: those of the table
    that count, else all."""
    flag = F.col("l_returnflag")
    category = F.when(flag == "R", "security").when(flag == "A", "code_smell").when(F.col("l_linestatus") == "O", "security").otherwise("style")
    items = table(spark, sf_dir, "lineitem") if items is None else items
    return items.select(
        F.col("l_orderkey").alias("analysis_id"),
        (file_of_part() if "file" not in items.columns else F.col("file")).alias("file"),
        F.col("l_linenumber").alias("line"),
        category.alias("category"),
        severity_of(F.col("l_quantity")).alias("severity"),
        F.concat(F.lit("issue "), F.col("l_linestatus"), F.lit(" "), (F.col("l_suppkey") % 10).cast("string")).alias("issue"),
        F.concat(F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0")).alias("ord"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the repository ``source``."""
    return spread(table(spark, sf_dir, "documents")).select(F.coalesce("source", F.lit("")).alias("repo"), F.col("doc_id").alias("file_id"), F.concat(F.coalesce("source", F.lit("")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


CTE = """
repositories AS (SELECT c_custkey AS repo_id, c_name AS name, c_nationkey AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN false ELSE true END AS is_connected FROM customer),
analyses AS (SELECT o_orderkey AS analysis_id, o_custkey AS repo_id, o_orderdate AS scanned_at, CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'completed' END AS status,
  CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN true ELSE false END AS is_deleted, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 3 END AS pull_request_id,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN lower(substr(o_orderpriority, 3)) END AS model, o_orderkey % 1000 AS prompt_tokens, o_orderkey % 300 AS completion_tokens,
  CAST(floor(o_totalprice) AS BIGINT) % 600 AS duration FROM orders),
findings AS (SELECT l_orderkey AS analysis_id, 'src/part_' || (l_partkey % 40) || '.py' AS file, l_linenumber AS line,
  CASE WHEN l_returnflag = 'R' THEN 'security' WHEN l_returnflag = 'A' THEN 'code_smell' WHEN l_linestatus = 'O' THEN 'security' ELSE 'style' END AS category,
  CASE WHEN l_quantity >= 46 THEN 'Critical' WHEN l_quantity >= 36 THEN 'High' WHEN l_quantity >= 21 THEN 'Medium' WHEN l_quantity >= 6 THEN 'Low' ELSE 'Info' END AS severity,
  'issue ' || l_linestatus || ' ' || (l_suppkey % 10) AS issue,
  lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 3, '0') AS ord FROM lineitem),
files AS (SELECT coalesce(source, '') AS repo, doc_id AS file_id, coalesce(source, '') || '/doc_' || doc_id || '.txt' AS path, coalesce(text, '') AS content FROM documents)"""


def sql(body: str) -> str:
    """An oracle over the entities."""
    return f"WITH {CTE.strip()}{body if body.lstrip().startswith(',') else ' ' + body}"

"""Reports and sinks: CSV, JSON lines, Markdown by file, routed findings, an idempotent snapshot append."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.sources.keyed_table import KeyedTable

HEADER = ("File", "Line", "Severity", "Category", "Issue", "Suggestion", "Why It Matters", "Before Code", "After Code")


def csv_rows(findings: DataFrame) -> DataFrame:
    """The nine columns of the report; what the findings lack is empty."""
    own = {c.lower().replace(" ", "_"): c for c in HEADER}
    return findings.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) if c in findings.columns else F.lit("").alias(name) for c, name in own.items()])


def run_isolated(outputs: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Write each output below ``path``; the failure of one is noted and leaves the others alone."""
    status = {}
    for name, df in outputs.items():
        try:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            status[name] = "completed"
        except Exception as error:
            status[name] = f"failed: {type(error).__name__}"
    return status


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def json_rows(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))


def markdown(findings: DataFrame, key: str = "analysis_id") -> DataFrame:
    """One section for each scan and file, findings under their category in order of line: one text a scan."""
    line = F.format_string("- line %d [%s] %s", "line", "severity", "issue")
    item = F.struct("category", "line", "issue", "severity", line.alias("text"))
    section = findings.groupBy(key, "file").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kinds = F.array_distinct(F.transform("items", lambda x: x["category"]))
    body = F.array_join(F.transform(kinds, lambda c: F.concat(F.lit("### "), c, F.lit("\n"), F.array_join(F.transform(F.filter("items", lambda x: x["category"] == c), lambda x: x["text"]), "\n"))), "\n")
    part = section.select(key, "file", F.concat(F.lit("## "), "file", F.lit("\n"), body).alias("part"))
    return part.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file", "part"))), lambda x: x["part"]), "\n\n").alias("markdown"))


def write_routed(findings: DataFrame, path: str) -> None:
    """Security findings and code smells to tables of their own, each sorted within its files; others are dropped."""
    for category, name in (("security", "security_findings"), ("code_smell", "code_smells")):
        findings.where(F.col("category") == category).sortWithinPartitions("analysis_id", "file", "line", "issue").write.parquet(f"{path}/{name}")


def append_snapshots(batch: DataFrame, path: str, batch_id: object = None) -> None:
    """Append the rows whose analysis is not in the table yet; for ``foreachBatch``, where a batch may come twice. Of rows of
    one analysis the least counts; writers may run at once (see ``KeyedTable``)."""
    name = uuid.uuid4().hex if batch_id is None else batch_id
    KeyedTable(batch.sparkSession, path, batch.schema, ["analysis_id"]).append(batch, name)

"""Technical debt of repositories from all that a scan measures: one item for each kind of debt, with its effort.

Hours and thresholds are fixed values of the service (``health.HOURS``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.operators import health
from auditspark.operators.relational import severity_rank

LONG_FUNCTION, LARGE_FILE = 80, 500
ITEM = ["repo", "category", "severity", "n", "hours", "file", "title"]


def counted(rows: DataFrame, *keys: str, more: dict[str, Column] | None = None) -> DataFrame:
    """repo, the keys, n and the first file; one pass over an input."""
    extra = [c.alias(k) for k, c in (more or {}).items()]
    return rows.groupBy("repo", *keys).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("file"), *extra)


def chosen(key: Column, cases: dict[str, Column]) -> Column:
    """The case that ``key`` names."""
    out = None
    for name, value in cases.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def item(groups: DataFrame, category: Column, weight: Column, severity: Column, title: Column) -> DataFrame:
    return groups.select("repo", category.alias("category"), severity.alias("severity"), "n", F.round(weight * F.col("n"), 1).alias("hours"), "file", title.alias("title"))


def items(findings: DataFrame, clones: DataFrame, functions: DataFrame, todos: DataFrame, lengths: DataFrame, packages: DataFrame, long_function: int = LONG_FUNCTION, large_file: int = LARGE_FILE) -> DataFrame:
    """All items of all repositories; each input is read once.

    findings: repo, path, kind (security, code_smell), severity; clones: repo, path, duplicated_lines; functions: the
    reported ones, with repo, path, severity, length_lines; todos: repo, path, marker; lengths: repo, path, lines;
    packages: repo, path, status, severity."""
    hours, fixed, grade, kind = {k: F.lit(v) for k, v in health.HOURS.items()}, F.lit, F.col("severity"), F.col("item")
    said = lambda form, *columns: F.format_string("%d " + form, "n", *columns)
    by_count = lambda high_at, medium_at: health.severity_from_counts(F.col("n"), high_at, medium_at)

    smell = F.when(grade.isin("Critical", "High"), "major").when(grade == "Medium", "minor")
    marked = findings.withColumn("item", F.when(F.col("kind") == "security", "security").otherwise(smell)).where(F.col("item").isNotNull())
    found = counted(marked.withColumn("severity", chosen(kind, {"security": grade, "major": fixed("High"), "minor": fixed("Medium")})), "item", "severity")
    risk = F.when(grade == "Critical", hours["security_critical"]).when(grade == "High", hours["security_high"]).otherwise(hours["security_other"])
    titles = {"security": said("%s severity security finding(s) requiring remediation", "severity"), "major": said("high-severity code smell(s)"), "minor": said("medium-severity code smell(s)")}
    scanned = item(found, F.when(kind == "security", "security").otherwise("code_smells"), chosen(kind, {"security": risk, "major": hours["code_smell_major"], "minor": hours["code_smell"]}), grade, chosen(kind, titles))

    kinds = F.filter(F.array(F.when(grade == "High", "high"), F.when(grade == "Medium", "medium"), F.when(F.col("length_lines") > long_function, "long")), lambda x: x.isNotNull())
    measured = counted(functions.withColumn("item", F.explode(kinds)), "item")
    titles = {"high": said("high-complexity function(s)"), "medium": said("medium-complexity function(s)"), "long": said(f"function(s) longer than {long_function} lines")}
    weights = {"high": hours["complexity_high"], "medium": hours["complexity_medium"], "long": hours["long_functions"]}
    complex_ = item(measured, F.when(kind == "long", "long_functions").otherwise("complexity"), chosen(kind, weights), F.when(kind == "high", "High").otherwise("Medium"), chosen(kind, titles))

    status, first = F.col("status"), F.min_by("severity", F.struct(severity_rank(grade), "path"))
    dated = counted(packages.where(status.isin("known_vulnerable", "outdated")), "status", more={"worst": first})
    vulnerable = status == "known_vulnerable"
    declared = item(dated, fixed("dependencies"), F.when(vulnerable, hours["dependency_vulnerable"]).otherwise(hours["dependency_outdated"]), F.when(vulnerable, F.coalesce(F.nullif("worst", F.lit("")), F.lit("High"))).otherwise("Low"), F.when(vulnerable, said("dependency(ies) with known vulnerabilities")).otherwise(said("outdated dependency(ies)")))

    copies = item(counted(clones, more={"lines": F.sum("duplicated_lines")}), fixed("duplication"), hours["duplication"], by_count(5, 2), said("duplicated code block(s) (~%d duplicated lines)", "lines"))
    marks = item(counted(todos), fixed("unfinished_work"), hours["todos"], by_count(15, 5), said("TODO/FIXME/HACK marker(s) in source"))
    long_files = lengths.where(F.col("lines") > large_file).groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.max_by("path", F.struct("lines", "path")).alias("file"))
    large = item(long_files, fixed("large_files"), hours["large_files"], by_count(8, 3), said(f"source file(s) exceed {large_file} lines"))
    return reduce(DataFrame.unionByName, (scanned, copies, complex_, marks, large, declared))


def report(rows: DataFrame, category: str | None = None) -> DataFrame:
    """Items by severity with their repository's score, hours and counts; a category chosen here narrows these too."""
    rows = rows if category is None else rows.where(F.lower("category") == category.lower())
    whole = Window.partitionBy("repo")
    cost = F.when(F.col("severity") == "Critical", 8).when(F.col("severity") == "High", 5).when(F.col("severity") == "Medium", 2).when(F.col("severity") == "Low", 1).otherwise(0)
    order = whole.orderBy(severity_rank(F.col("severity")), "category", "title")
    return rows.select(
        *ITEM, F.row_number().over(order).alias("place"), F.count(F.lit(1)).over(whole).alias("items"), F.round(F.sum("hours").over(whole), 1).alias("total_hours"), F.greatest(F.lit(0), 100 - F.sum(cost).over(whole)).cast("int").alias("score")
    )


def top_areas(rows: DataFrame, most: int = 5) -> DataFrame:
    """The files with the most effort."""
    by_file = rows.where(F.col("file").isNotNull()).groupBy("repo", "file").agg(F.round(F.sum("hours"), 1).alias("hours"))
    return by_file.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("hours"), "file"))).where(F.col("place") <= most)


COUNTS = ("files", "security", "critical_security", "high_security", "smells", "dependencies", "vulnerable", "duplicates", "debt", "complexity", "high_complexity")


def overview(files: DataFrame, findings: DataFrame, clones: DataFrame, functions: DataFrame, packages: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each repository: what the last scan counted, and a sentence on it. ``files`` are those analyzed (repo),
    ``rows`` the debt items; the rest is as for ``items``. Each input is counted once and joined by repository."""
    count = F.count_if
    security, grade = F.col("kind") == "security", F.col("severity")
    parts = [
        findings.groupBy("repo").agg(count(security).alias("security"), count(security & (grade == "Critical")).alias("critical_security"), count(security & (grade == "High")).alias("high_security"), count(F.col("kind") == "code_smell").alias("smells")),
        packages.groupBy("repo").agg(F.count(F.lit(1)).alias("dependencies"), count(F.col("status") == "known_vulnerable").alias("vulnerable")),
        clones.groupBy("repo").agg(F.count(F.lit(1)).alias("duplicates")),
        rows.groupBy("repo").agg(F.count(F.lit(1)).alias("debt")),
        functions.groupBy("repo").agg(F.count(F.lit(1)).alias("complexity"), count(grade == "High").alias("high_complexity")),
    ]
    joined = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"))
    for part in parts:
        joined = joined.join(part, "repo", "left")
    joined = joined.select("repo", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])
    first = F.format_string(
        "The latest scan analyzed %d file(s) and recorded %d security finding(s), %d code smell(s), %d tracked dependenc(ies), %d duplicate code block(s), %d technical debt item(s), and %d high-complexity function(s).",
        "files", "security", "smells", "dependencies", "duplicates", "debt", "high_complexity",
    )
    severe = F.col("critical_security") + F.col("high_security")
    more = [
        F.when(F.col("vulnerable") > 0, F.format_string("%d dependenc(y/ies) match known vulnerability advisories.", "vulnerable")),
        F.when(severe > 0, F.format_string("%d security finding(s) are rated Critical or High and should be reviewed first.", severe)),
        F.when((F.col("security") == 0) & (F.col("smells") == 0) & (F.col("duplicates") == 0), F.lit("The deterministic scanners reported no issues for this scan.")),
    ]
    return joined.withColumn("summary", F.concat_ws(" ", first, *more))

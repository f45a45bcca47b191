"""Repository health from inventory facts, and technical debt from findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.operators import inventory, tree
from auditspark.operators.relational import severity_rank

#: Hours for each item of a debt category; fixed values.
HOURS = {
    "security_critical": 4.0, "security_high": 3.0, "security_other": 1.0, "code_smell": 1.0, "code_smell_major": 2.0, "duplication": 1.5, "complexity_high": 3.0, "complexity_medium": 1.5,
    "todos": 0.5, "long_functions": 1.0, "large_files": 2.0, "dependency_vulnerable": 2.0, "dependency_outdated": 1.0,
}


def severity_from_counts(n: Column, high_at: int = 3, medium_at: int = 1) -> Column:
    return F.when(n >= 3 * high_at, "Critical").when(n >= high_at, "High").when(n >= medium_at, "Medium").otherwise("Low")


def repository_health(files: DataFrame) -> DataFrame:
    """repo, score and its parts, from (repo, path, size): one aggregate, no join.

    A README is 20 points, tests are 20, and files over 500 KiB cost 5 each, at most 15."""
    p = F.col("path")
    test, source = inventory.is_test(p), inventory.file_type(p) == "source"
    kept = files.where(~inventory.should_skip(p))
    facts = kept.groupBy("repo").agg(
        F.count_if(inventory.basename(p).isin("readme.md", "readme.txt", "readme")).alias("readmes"),
        F.count_if(test).alias("tests"),
        F.count_if(source & ~test).alias("sources"),
        F.count_if(source & ~test & (F.col("size") > 500 * 1024)).alias("large"),
        F.count_if(source & ~test & p.rlike(tree.HOTSPOT)).alias("hotspots"),
    )
    score = 100 - F.when(F.col("readmes") == 0, 20).otherwise(0) - F.when(F.col("tests") == 0, 20).otherwise(0) - F.least(F.lit(15), 5 * F.col("large"))
    return facts.withColumn("score", F.greatest(F.lit(0), score).cast("int"))


RISKY = ("pycrypto", "requests<2.20.0", "urllib3<1.26.0")


def health_report(files: DataFrame) -> DataFrame:
    """repo, its facts, score and the deductions in words, from (repo, path, size, content).

    No README costs 20 points; no tests cost 20, sources of which more than half are untested 10; each source over
    500 KiB costs 5, at most 15; risky requirements cost 10, in files that name themselves."""
    p = F.col("path")
    own = files.where(~inventory.should_skip(p))
    test, source = inventory.is_test(p), inventory.file_type(p) == "source"
    text = F.lower("content")
    risky = F.array_join(F.filter(F.array(*[F.when(text.contains(x), x) for x in RISKY]), lambda x: x.isNotNull()), ", ")
    named = (inventory.basename(p) == "requirements.txt") & F.col("content").contains("requirements.txt")
    facts = own.groupBy("repo").agg(
        F.count_if(inventory.basename(p).isin("readme.md", "readme.txt", "readme")).alias("readmes"), F.count_if(test).alias("tests"), F.count_if(source & ~test).alias("sources"),
        F.count_if(source & ~test & (F.col("size") > 500 * 1024)).alias("large"), F.max(F.when(named, risky)).alias("risky"),
    )
    missing = tree.untested_sources(files).groupBy("repo").agg(F.count(F.lit(1)).alias("missing"))
    rows = facts.join(missing, "repo", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    large = F.least(F.lit(15), 5 * F.col("large"))
    steps = (
        (F.col("readmes") == 0, F.lit(20), F.lit("Missing README.md (-20)")),
        (F.col("tests") == 0, F.lit(20), F.lit("No test files detected (-20)")),
        ((F.col("tests") > 0) & (2 * F.col("missing") > F.col("sources")), F.lit(10), F.lit("Over 50% of source files lack test cases (-10)")),
        (F.col("large") > 0, large, F.format_string("%d large files detected (-%d)", "large", large)),
        (F.coalesce("risky", F.lit("")) != "", F.lit(10), F.concat(F.lit("Outdated/risky dependencies in requirements.txt: "), "risky", F.lit(" (-10)"))),
    )
    score = F.lit(100)
    for test, cost, _ in steps:
        score = score - F.when(test, cost).otherwise(0)
    said = F.concat_ws("; ", *[F.when(test, words) for test, _, words in steps])
    return rows.select("repo", "readmes", "tests", "sources", "large", "missing", F.greatest(F.lit(0), score).cast("int").alias("score"), said.alias("deductions"))


def debt_items(findings: DataFrame) -> DataFrame:
    """repo, category, severity, n, hours, file, line: security by severity, smells major and minor, each with the first finding."""
    severity = F.col("severity")
    security = F.when(severity == "Critical", "security_critical").when(severity == "High", "security_high").otherwise("security_other")
    smell = F.when(severity.isin("Critical", "High"), "code_smell_major").when(severity == "Medium", "code_smell")
    kind = F.when(F.col("category") == "security", security).when(F.col("category") == "code_smell", smell)
    rows = findings.withColumn("kind", kind).where(F.col("kind").isNotNull())
    shown = F.when(F.col("category") == "security", severity)
    grouped = rows.groupBy("repo", "kind", shown.alias("own")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("analysis_id", "ord", "file", "line")).alias("first"))
    weights = F.create_map(*[F.lit(x) for pair in HOURS.items() for x in pair])
    return grouped.select("repo", F.col("kind").alias("category"), F.coalesce("own", F.when(F.col("kind") == "code_smell_major", "High").otherwise("Medium")).alias("severity"), "n", F.round(F.element_at(weights, F.col("kind")) * F.col("n"), 1).alias("hours"), "first.file", "first.line")


def debt_summary(items: DataFrame) -> DataFrame:
    """repo, items, hours, score and worst severity."""
    weight = F.when(F.col("severity") == "Critical", 8).when(F.col("severity") == "High", 5).when(F.col("severity") == "Medium", 2).when(F.col("severity") == "Low", 1).otherwise(0)
    return items.groupBy("repo").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("hours"), 1).alias("hours"), F.greatest(F.lit(0), 100 - F.sum(weight)).cast("int").alias("score"), F.min(severity_rank(F.col("severity"))).alias("worst"))

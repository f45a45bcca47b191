"""Scores of scans from severity counts, as column expressions and per-scan aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.sources.adapters import SEVERITIES

LETTERS = dict(zip(SEVERITIES, "chmli"))


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def risk(c: Column, h: Column, m: Column, low: Column) -> Column:
    return F.least(F.lit(100), 25 * c + 15 * h + 6 * m + low)


def snapshot_security(c: Column, h: Column, m: Column, low: Column) -> Column:
    return clamp(100 - 25 * c - 15 * h - 6 * m - low)


def snapshot_quality(c: Column, h: Column, m: Column) -> Column:
    """Over code smells; low ones are free."""
    return clamp(100 - 8 * c - 5 * h - 2 * m)


def pull_request_health(c: Column, h: Column, m: Column, major_smells: Column, minor_smells: Column) -> Column:
    return clamp(100 - 15 * c - 10 * h - 5 * m - 3 * major_smells - minor_smells)


def debt_score(c: Column, h: Column, m: Column, low: Column) -> Column:
    return F.greatest(F.lit(0), 100 - (8 * c + 5 * h + 2 * m + low))


def weighted(c: Column, h: Column, m: Column, low: Column, weights: tuple[int, int, int, int]) -> Column:
    return clamp(100 - weights[0] * c - weights[1] * h - weights[2] * m - weights[3] * low)


def improvement_pct(a: Column, b: Column, lower_is_better: bool = True) -> Column:
    """Whole per cent, cut towards zero; from nothing it is all or nothing."""
    gain = (a - b) if lower_is_better else (b - a)
    from_zero = F.when(b > 0, -100 if lower_is_better else 100).otherwise(0)
    return F.when(a == b, 0).when(a == 0, from_zero).otherwise((gain * 100 / a).cast("int")).cast("int")


def label(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 60, "Fair").when(score >= 40, "Needs Work").otherwise("Poor")


def severity_counts(findings: DataFrame, *keys: str, category: str | None = None, prefix: str = "") -> list[Column]:
    """Counts of each severity, for one pass of groupBy().agg()."""
    mine = F.col("category") == category if category else F.lit(True)
    return [F.count_if(mine & (F.col("severity") == s)).alias(prefix + letter) for s, letter in LETTERS.items()]


def scan_counts(findings: DataFrame) -> DataFrame:
    """Of each scan: counts by severity of all findings, of security (s_) and of code smells (q_)."""
    return findings.groupBy("analysis_id").agg(*severity_counts(findings), *severity_counts(findings, category="security", prefix="s_"), *severity_counts(findings, category="code_smell", prefix="q_"))


def scan_scores(findings: DataFrame) -> DataFrame:
    """Of each scan with findings: risk, security, quality, health (where none is stored) and its label."""
    n = scan_counts(findings)
    c = {x: F.col(x) for x in n.columns}
    total = c["s_c"] + c["s_h"] + c["s_m"] + c["s_l"] + c["s_i"]
    health = clamp(100 - 2 * total)
    return n.select(
        "analysis_id",
        risk(c["c"], c["h"], c["m"], c["l"]).cast("int").alias("risk_score"),
        snapshot_security(c["s_c"], c["s_h"], c["s_m"], c["s_l"]).cast("int").alias("security_score"),
        snapshot_quality(c["q_c"], c["q_h"], c["q_m"]).cast("int").alias("quality_score"),
        health.cast("int").alias("health_score"),
        label(health).alias("health_label"),
        (c["c"] + c["h"] + c["m"] + c["l"] + c["i"]).cast("int").alias("total_issues"),
    )

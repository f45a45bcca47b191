"""Relational reads and writes over scans and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.operators import scores
from auditspark.sources.adapters import SEVERITIES


def not_flagged(flag: str) -> Column:
    """False or null: a nullable flag that is not set."""
    return ~F.coalesce(F.col(flag), F.lit(False))


def connected(repos: DataFrame) -> DataFrame:
    return repos.where(F.coalesce(F.col("is_connected"), F.lit(True)))


def live_scans(scans: DataFrame, repos: DataFrame) -> DataFrame:
    """Completed scans, not deleted, of connected repositories, with the repository's name and user."""
    done = scans.where((F.col("status") == "completed") & not_flagged("is_deleted"))
    return done.join(connected(repos).select("repo_id", "name", "user_id"), "repo_id")


def severity_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, rank int")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, s in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == s, i).otherwise(rank)
    return rank


def severity_distribution(findings: DataFrame, keys: DataFrame) -> DataFrame:
    """A row for each key and severity of the fixed domain, zero where there is none; others are ignored."""
    key = keys.columns[0]
    counts = findings.groupBy(key, "severity").agg(F.count(F.lit(1)).alias("n"))
    full = keys.distinct().withColumn("severity", F.explode(F.array(*map(F.lit, SEVERITIES))))
    return full.join(counts, [key, "severity"], "left").select(key, "severity", F.coalesce("n", F.lit(0)).alias("n"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") == 1).drop("_place")


def latest_scan(scans: DataFrame) -> DataFrame:
    """Of each repository its latest completed scan, the larger id of two at a time. One struct for each repository moves."""
    fields = [c for c in scans.columns if c not in ("scanned_at", "analysis_id", "repo_id")]
    latest = scans.where((F.col("status") == "completed") & not_flagged("is_deleted")).groupBy("repo_id").agg(F.max(F.struct("scanned_at", "analysis_id", *fields)).alias("s"))
    return latest.select("repo_id", "s.*")


def last_then_chronological(df: DataFrame, keys: list[str], n: int, time: str, tie: str) -> DataFrame:
    """The last ``n`` rows of each key, numbered from the oldest of them."""
    back = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(tie).desc())
    forth = Window.partitionBy(*keys).orderBy(F.col(time), F.col(tie))
    return df.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n).withColumn("place", F.row_number().over(forth)).drop("_back")


def direction(a: Column, b: Column, lower_is_better: bool = False) -> Column:
    better = F.when(b > a, 1).otherwise(-1)
    return F.when(a.isNull() | b.isNull() | (a == b), 0).otherwise(-better if lower_is_better else better)


def trend(points: DataFrame, key: str, time: str, tie: str, scores_up: list[str], totals_down: list[str]) -> DataFrame:
    """First against last snapshot of each key: a direction for each measure, and the overall status."""
    fields = [*scores_up, *totals_down]
    ends = points.groupBy(key).agg(F.min(F.struct(time, tie, *fields)).alias("a"), F.max(F.struct(time, tie, *fields)).alias("b"), F.count(F.lit(1)).alias("snapshots"))
    ends = ends.withColumns({f"{f}_direction": direction(F.col(f"a.{f}"), F.col(f"b.{f}"), f in totals_down) for f in fields})
    all_of = [F.col(f"{f}_direction") for f in fields]
    up, down = F.greatest(*all_of) > 0, F.least(*all_of) < 0
    status = F.when(F.col("snapshots") < 2, None).when(up & down, "mixed").when(up, "improved").when(down, "declined").otherwise("no_change")
    return ends.select(key, "snapshots", *[F.when(F.col("snapshots") >= 2, c).alias(f"{f}_direction") for f, c in zip(fields, all_of)], status.alias("trend_status"))


def last_per_issue(findings: DataFrame) -> DataFrame:
    """One finding for each scan, file and issue: the last, smells over security."""
    own = findings.where(F.col("category").isin("security", "code_smell"))
    return first_by(own, ["analysis_id", "file", "issue"], (F.col("category") == "code_smell").desc(), F.col("ord").desc())


def scan_pairs(scans: DataFrame) -> DataFrame:
    """Each completed scan with the one before it in its repository: before, after."""
    order = Window.partitionBy("repo_id").orderBy("scanned_at", "analysis_id")
    return scans.where(F.col("status") == "completed").select("repo_id", F.lag("analysis_id").over(order).alias("before"), F.col("analysis_id").alias("after")).where(F.col("before").isNotNull())


def scan_diff(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of each pair of scans by (file, issue): fixed, new or remaining (rows of the later scan)."""
    own = last_per_issue(findings).select("analysis_id", "file", "issue", "line", "severity", "category")
    a = pairs.join(own.withColumnRenamed("analysis_id", "before"), "before").select("before", "after", "file", "issue", F.struct("line", "severity", "category").alias("a"))
    b = pairs.join(own.withColumnRenamed("analysis_id", "after"), "after").select("before", "after", "file", "issue", F.struct("line", "severity", "category").alias("b"))
    both = a.join(b, ["before", "after", "file", "issue"], "full_outer")
    kind = F.when(F.col("b").isNull(), "fixed").when(F.col("a").isNull(), "new").otherwise("remaining")
    return both.select("before", "after", "file", "issue", kind.alias("kind"), F.coalesce("b", "a").alias("f")).select("before", "after", "file", "issue", "kind", "f.line", "f.severity", "f.category")


def resolve(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of the earlier scan that stay after those resolved in the later one are deleted, duplicates included."""
    later = pairs.join(findings.select(F.col("analysis_id").alias("after"), "file", "issue"), "after").select(F.col("before").alias("analysis_id"), "file", "issue")
    return findings.join(pairs.select(F.col("before").alias("analysis_id")), "analysis_id", "left_semi").join(later, ["analysis_id", "file", "issue"], "left_semi")


def keep_first(findings: DataFrame, chars: int) -> DataFrame:
    """Of each scan and file: the first finding for a line and the beginning of its issue."""
    return first_by(findings.withColumn("_head", F.substring("issue", 1, chars)), ["analysis_id", "file", "line", "_head"], F.col("ord")).drop("_head")


def nested_by_file(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Each file with its findings as text, in order of line and issue; empty where it has none."""
    item = F.concat_ws(":", F.lpad(F.col("line").cast("string"), 6, "0"), "issue", "severity")
    grouped = findings.groupBy("analysis_id", "file").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(item)), ";").alias("findings"))
    return files.join(grouped, ["analysis_id", "file"], "left").select("analysis_id", "file", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("findings", F.lit("")).alias("findings"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; old ones that are missing are marked closed."""
    old, new = old.select(*keys, F.col("title").alias("old_title"), F.col("state").alias("old_state")), new.select(*keys, "title", "state")
    state = F.when(F.col("state").isNotNull(), F.col("state")).otherwise("closed")
    action = F.when(F.col("old_state").isNull(), "inserted").when(F.col("state").isNull(), "closed").otherwise("updated")
    return old.join(new, keys, "full_outer").select(*keys, F.coalesce("title", "old_title").alias("title"), state.alias("state"), action.alias("action"))


def oldest_wins(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """Normalise a key: of rows that collide only the oldest takes the normal form; the others keep theirs."""
    marked = rows.withColumn("normal", key)
    place = F.row_number().over(Window.partitionBy("normal").orderBy(*order))
    return marked.withColumn("wins", place == 1)


def cascade(gone: DataFrame, tables: dict[str, DataFrame], scans: DataFrame) -> dict[str, DataFrame]:
    """The rows that stay when repositories are deleted: tables with a repository's id lose its rows, others those of its scans."""
    dead = scans.join(gone, "repo_id", "left_semi").select("analysis_id")
    return {name: df.join(gone, "repo_id", "left_anti") if "repo_id" in df.columns else df.join(dead, "analysis_id", "left_anti") for name, df in tables.items()}


def append_missing(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Idempotent append: rows of ``fresh`` whose key is not stored yet."""
    return fresh.join(stored.select(key).distinct(), key, "left_anti")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of at most 100 rows; pages count from 1."""
    size = max(1, min(size, 100))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def effort(severity: Column) -> Column:
    return F.when(severity == "Critical", 4.0).when(severity == "High", 3.0).when(severity == "Medium", 1.0).otherwise(0.0)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def risk_by_scan(scans: DataFrame, findings: DataFrame) -> DataFrame:
    n = scores.scan_counts(findings)
    joined = scans.join(n, "analysis_id", "left")
    c, h, m, low = (F.coalesce(x, F.lit(0)) for x in "chml")
    return joined.withColumn("risk_score", scores.risk(c, h, m, low).cast("int"))

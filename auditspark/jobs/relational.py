"""Queries over scans and findings, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.operators import relational as rel
from auditspark.operators import scores
from auditspark.sources.adapters import analyses, findings, repositories, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LIVE = """, live AS (SELECT a.*, r.name, r.user_id FROM analyses a JOIN repositories r USING (repo_id) WHERE a.status = 'completed' AND NOT coalesce(a.is_deleted, false) AND coalesce(r.is_connected, true))"""
COUNTS = """, counts AS (SELECT analysis_id, count(*) FILTER (severity = 'Critical') AS c, count(*) FILTER (severity = 'High') AS h, count(*) FILTER (severity = 'Medium') AS m, count(*) FILTER (severity = 'Low') AS l, count(*) AS n,
  count(*) FILTER (category = 'security' AND severity = 'Critical') AS sc, count(*) FILTER (category = 'security' AND severity = 'High') AS sh, count(*) FILTER (category = 'security' AND severity = 'Medium') AS sm,
  count(*) FILTER (category = 'security' AND severity = 'Low') AS sl, count(*) FILTER (category = 'security') AS sn,
  count(*) FILTER (category = 'code_smell' AND severity = 'Critical') AS qc, count(*) FILTER (category = 'code_smell' AND severity = 'High') AS qh, count(*) FILTER (category = 'code_smell' AND severity = 'Medium') AS qm,
  count(*) FILTER (category = 'code_smell' AND severity = 'Low') AS ql, count(*) FILTER (category = 'code_smell') AS qn FROM findings GROUP BY analysis_id)"""
LATEST = """, done AS (SELECT * FROM analyses WHERE status = 'completed' AND NOT coalesce(is_deleted, false)),
latest AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY scanned_at DESC, analysis_id DESC) = 1)"""
PAIRS = """, pairs AS (SELECT * FROM (SELECT repo_id, lag(analysis_id) OVER (PARTITION BY repo_id ORDER BY scanned_at, analysis_id) AS before, analysis_id AS after FROM analyses WHERE status = 'completed') WHERE before IS NOT NULL),
own AS (SELECT * FROM findings WHERE category IN ('security', 'code_smell') QUALIFY row_number() OVER (PARTITION BY analysis_id, file, issue ORDER BY category = 'code_smell' DESC, ord DESC) = 1)"""


def query(oracle: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return add


def live(spark: SparkSession, d: str) -> DataFrame:
    return rel.live_scans(analyses(spark, d), repositories(spark, d))


def security(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).where(F.col("category") == "security")


@query(LIVE + """, n AS (SELECT user_id, severity, count(*) AS n FROM live JOIN findings USING (analysis_id) WHERE category = 'security' GROUP BY ALL)
SELECT u.user_id, s.severity, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM repositories) u CROSS JOIN (VALUES ('Critical'), ('High'), ('Medium'), ('Low'), ('Info')) s(severity) LEFT JOIN n ON n.user_id = u.user_id AND n.severity = s.severity""")  # fmt: skip
def severity_distribution_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    own = security(spark, d).join(live(spark, d).select("analysis_id", "user_id"), "analysis_id")
    return rel.severity_distribution(own, repositories(spark, d).select("user_id"))


@query(COUNTS + " SELECT analysis_id, CAST(least(100, 25 * c + 15 * h + 6 * m + l) AS INTEGER) AS risk_score FROM counts")
def risk_score_by_scan(spark: SparkSession, d: str) -> DataFrame:
    return scores.scan_scores(findings(spark, d)).select("analysis_id", "risk_score")


@query(COUNTS + """ SELECT analysis_id, CAST(greatest(0, least(100, 100 - 25 * sc - 15 * sh - 6 * sm - sl)) AS INTEGER) AS security_score, CAST(greatest(0, 100 - 8 * qc - 5 * qh - 2 * qm) AS INTEGER) AS quality_score,
  CAST(greatest(0, 100 - 2 * sn) AS INTEGER) AS health_score, CAST(n AS INTEGER) AS total_issues,
  CASE WHEN 100 - 2 * sn >= 90 THEN 'Excellent' WHEN 100 - 2 * sn >= 75 THEN 'Good' WHEN 100 - 2 * sn >= 60 THEN 'Fair' WHEN 100 - 2 * sn >= 40 THEN 'Needs Work' ELSE 'Poor' END AS health_label FROM counts""")  # fmt: skip
def snapshot_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores.scan_scores(findings(spark, d)).drop("risk_score")


@query(COUNTS + """ SELECT analysis_id, CAST(greatest(0, 100 - 50 * c - 30 * h - 12 * m - 2 * l) AS INTEGER) AS security, CAST(greatest(0, 100 - 20 * c - 15 * h - 8 * m - 3 * l) AS INTEGER) AS maintainability,
  CAST(greatest(0, 100 - 15 * c - 10 * h - 6 * m - 2 * l) AS INTEGER) AS performance, CAST(100 - least(100, 25 * c + 15 * h + 6 * m + l) AS INTEGER) AS quality, CAST(least(100, 25 * c + 15 * h + 6 * m + l) AS INTEGER) AS debt FROM counts""")  # fmt: skip
def fallback_scores(spark: SparkSession, d: str) -> DataFrame:
    n = scores.scan_counts(findings(spark, d))
    c, h, m, low = (F.col(x) for x in "chml")
    risk = scores.risk(c, h, m, low)
    kinds = {"security": (50, 30, 12, 2), "maintainability": (20, 15, 8, 3), "performance": (15, 10, 6, 2)}
    return n.select("analysis_id", *[scores.weighted(c, h, m, low, w).cast("int").alias(k) for k, w in kinds.items()], (100 - risk).cast("int").alias("quality"), risk.cast("int").alias("debt"))


@query(COUNTS + """ SELECT analysis_id, pull_request_id, CAST(greatest(0, least(100, 100 - 15 * c - 10 * h - 5 * m - 3 * (qc + qh) - (qm + ql))) AS INTEGER) AS health_score
FROM counts JOIN analyses USING (analysis_id) WHERE pull_request_id IS NOT NULL""")  # fmt: skip
def pr_health_score(spark: SparkSession, d: str) -> DataFrame:
    n = scores.scan_counts(findings(spark, d)).join(analyses(spark, d).where(F.col("pull_request_id").isNotNull()).select("analysis_id", "pull_request_id"), "analysis_id")
    c, h, m = (F.col(x) for x in "chm")
    health = scores.pull_request_health(c, h, m, F.col("q_c") + F.col("q_h"), F.col("q_m") + F.col("q_l"))
    return n.select("analysis_id", "pull_request_id", health.cast("int").alias("health_score"))


@query(COUNTS + " SELECT analysis_id, CAST(greatest(0, 100 - (8 * c + 5 * h + 2 * m + l)) AS INTEGER) AS debt_score FROM counts")
def debt_score_by_scan(spark: SparkSession, d: str) -> DataFrame:
    n = scores.scan_counts(findings(spark, d))
    return n.select("analysis_id", scores.debt_score(*(F.col(x) for x in "chml")).cast("int").alias("debt_score"))


@query(LIVE + """ SELECT user_id, strftime(scanned_at, '%Y-%m-%d') AS day, count(*) AS n FROM live JOIN findings USING (analysis_id)
WHERE category = 'security' AND scanned_at >= (SELECT max(scanned_at) FROM analyses) - INTERVAL 30 DAY GROUP BY ALL""")  # fmt: skip
def vulnerability_trend_30d(spark: SparkSession, d: str) -> DataFrame:
    scans = live(spark, d)
    now = analyses(spark, d).agg(F.max("scanned_at").alias("now"))
    recent = scans.join(now, scans.scanned_at >= now.now - F.expr("INTERVAL 30 DAYS")).select("analysis_id", "user_id", F.date_format("scanned_at", "yyyy-MM-dd").alias("day"))
    return security(spark, d).join(recent, "analysis_id").groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))


@query(LIVE + COUNTS + """, scored AS (SELECT live.*, least(100, 25 * coalesce(c, 0) + 15 * coalesce(h, 0) + 6 * coalesce(m, 0) + coalesce(l, 0)) AS risk, coalesce(sn, 0) AS sn FROM live LEFT JOIN counts USING (analysis_id)),
repos AS (SELECT user_id, count(*) FILTER (coalesce(is_connected, true)) AS repositories_count FROM repositories GROUP BY user_id)
SELECT user_id, repositories_count, count(pull_request_id) AS prs_count, CAST(coalesce(sum(sn), 0) AS BIGINT) AS vulnerabilities_count, round(coalesce(avg(duration), 0.0), 4) AS average_duration,
  round(greatest(0.0, 100 - coalesce(avg(risk), 0.0)), 4) AS security_score, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
  CAST(coalesce(sum(prompt_tokens + completion_tokens), 0) AS BIGINT) AS total_tokens FROM repos LEFT JOIN scored USING (user_id) GROUP BY ALL""")  # fmt: skip
def dashboard_scalars(spark: SparkSession, d: str) -> DataFrame:
    scored = rel.risk_by_scan(live(spark, d), findings(spark, d)).withColumn("vulnerabilities", F.coalesce(sum((F.col(f"s_{x}") for x in "hmli"), F.col("s_c")), F.lit(0)))
    per_user = scored.groupBy("user_id").agg(
        F.count("pull_request_id").alias("prs_count"), F.sum("vulnerabilities").alias("vulnerabilities_count"), F.avg("duration").alias("average_duration"), F.avg("risk_score").alias("risk"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")
    )
    repos = repositories(spark, d).groupBy("user_id").agg(F.count_if(F.coalesce("is_connected", F.lit(True))).alias("repositories_count"))
    zero = F.lit(0)
    return repos.join(per_user, "user_id", "left").select(
        "user_id", "repositories_count", *[F.coalesce(c, zero).alias(c) for c in ("prs_count", "vulnerabilities_count", "prompt_tokens", "completion_tokens")], F.round(F.coalesce("average_duration", F.lit(0.0)), 4).alias("average_duration"),
        F.round(F.greatest(F.lit(0.0), 100 - F.coalesce("risk", F.lit(0.0))), 4).alias("security_score"), (F.coalesce("prompt_tokens", zero) + F.coalesce("completion_tokens", zero)).alias("total_tokens"),
    )


@query(LIVE + " SELECT user_id, coalesce(model, 'unknown') AS model, count(*) AS n FROM live GROUP BY ALL")
def model_usage(spark: SparkSession, d: str) -> DataFrame:
    return live(spark, d).groupBy("user_id", F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query(LATEST + " SELECT repo_id, analysis_id, scanned_at FROM latest")
def latest_scan_per_repo(spark: SparkSession, d: str) -> DataFrame:
    return rel.latest_scan(analyses(spark, d)).select("repo_id", "analysis_id", "scanned_at")


@query(LATEST + COUNTS + """ SELECT r.repo_id, r.name, coalesce(s.analysis_id, -1) AS analysis_id, CAST(least(100, 25 * coalesce(c, 0) + 15 * coalesce(h, 0) + 6 * coalesce(m, 0) + coalesce(l, 0)) AS INTEGER) AS risk_score
FROM repositories r LEFT JOIN latest s USING (repo_id) LEFT JOIN counts USING (analysis_id) WHERE coalesce(r.is_connected, true)""")  # fmt: skip
def repository_list_last_risk(spark: SparkSession, d: str) -> DataFrame:
    latest = rel.risk_by_scan(rel.latest_scan(analyses(spark, d)), findings(spark, d)).select("repo_id", "analysis_id", "risk_score")
    return rel.connected(repositories(spark, d)).join(latest, "repo_id", "left").select("repo_id", "name", F.coalesce("analysis_id", F.lit(-1)).alias("analysis_id"), F.coalesce("risk_score", F.lit(0)).alias("risk_score"))


@query(LATEST + COUNTS + """, risk AS (SELECT user_id, repo_id, name, CAST(least(100, 25 * coalesce(c, 0) + 15 * coalesce(h, 0) + 6 * coalesce(m, 0) + coalesce(l, 0)) AS INTEGER) AS risk_score FROM latest JOIN repositories r USING (repo_id) LEFT JOIN counts USING (analysis_id) WHERE coalesce(r.is_connected, true))
SELECT user_id, repo_id, name, risk_score, CAST(row_number() OVER w AS INTEGER) AS place FROM risk WINDOW w AS (PARTITION BY user_id ORDER BY risk_score DESC, repo_id) QUALIFY place <= 5""")  # fmt: skip
def top_risky_repos(spark: SparkSession, d: str) -> DataFrame:
    latest = rel.risk_by_scan(rel.latest_scan(analyses(spark, d)), findings(spark, d)).join(rel.connected(repositories(spark, d)), "repo_id")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("risk_score").desc(), "repo_id"))
    return latest.select("user_id", "repo_id", "name", "risk_score", place.alias("place")).where(F.col("place") <= 5)


@query(LIVE + COUNTS + """, h AS (SELECT user_id, name, analysis_id, scanned_at, CAST(greatest(0, 100 - 2 * sn) AS INTEGER) AS health_score FROM live JOIN counts USING (analysis_id)),
last AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY scanned_at DESC, analysis_id DESC) <= 20)
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY scanned_at, analysis_id) AS INTEGER) AS place FROM last""")  # fmt: skip
def health_history_last20(spark: SparkSession, d: str) -> DataFrame:
    health = live(spark, d).join(scores.scan_scores(findings(spark, d)).select("analysis_id", "health_score"), "analysis_id").select("user_id", "name", "analysis_id", "scanned_at", "health_score")
    return rel.last_then_chronological(health, ["user_id"], 20, "scanned_at", "analysis_id")


@query(COUNTS + """, snap AS (SELECT repo_id, scanned_at, analysis_id, greatest(0, 100 - 2 * sn) AS hs, greatest(0, 100 - 25 * sc - 15 * sh - 6 * sm - sl) AS ss, greatest(0, 100 - 8 * qc - 5 * qh - 2 * qm) AS qs, n AS t
  FROM analyses JOIN counts USING (analysis_id) WHERE status = 'completed'),
ends AS (SELECT repo_id, count(*) AS snapshots, arg_min({'h': hs, 's': ss, 'q': qs, 't': t}, (scanned_at, analysis_id)) AS a, arg_max({'h': hs, 's': ss, 'q': qs, 't': t}, (scanned_at, analysis_id)) AS b FROM snap GROUP BY repo_id),
d AS (SELECT repo_id, snapshots, CAST(sign(b.h - a.h) AS INTEGER) AS h, CAST(sign(b.s - a.s) AS INTEGER) AS s, CAST(sign(b.q - a.q) AS INTEGER) AS q, CAST(sign(a.t - b.t) AS INTEGER) AS t FROM ends)
SELECT repo_id, snapshots, CASE WHEN snapshots >= 2 THEN h ELSE 0 END AS health_score_direction, CASE WHEN snapshots >= 2 THEN s ELSE 0 END AS security_score_direction, CASE WHEN snapshots >= 2 THEN q ELSE 0 END AS quality_score_direction,
  CASE WHEN snapshots >= 2 THEN t ELSE 0 END AS total_issues_direction,
  CASE WHEN snapshots < 2 THEN NULL WHEN greatest(h, s, q, t) > 0 AND least(h, s, q, t) < 0 THEN 'mixed' WHEN greatest(h, s, q, t) > 0 THEN 'improved' WHEN least(h, s, q, t) < 0 THEN 'declined' ELSE 'no_change' END AS trend_status FROM d""")  # fmt: skip
def health_trend_status(spark: SparkSession, d: str) -> DataFrame:
    points = analyses(spark, d).where(F.col("status") == "completed").join(scores.scan_scores(findings(spark, d)), "analysis_id")
    found = rel.trend(points, "repo_id", "scanned_at", "analysis_id", ["health_score", "security_score", "quality_score"], ["total_issues"])
    return found.fillna(0)


@query(LIVE + """ SELECT user_id, analysis_id, name, scanned_at, CAST(row_number() OVER w AS INTEGER) AS place FROM live WINDOW w AS (PARTITION BY user_id ORDER BY scanned_at DESC, analysis_id DESC) QUALIFY place <= 10""")
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("scanned_at").desc(), F.col("analysis_id").desc()))
    return live(spark, d).select("user_id", "analysis_id", "name", "scanned_at", place.alias("place")).where(F.col("place") <= 10)


@query(LATEST + COUNTS + """ SELECT repo_id, analysis_id, coalesce(sn, 0) AS security, coalesce(sc, 0) AS security_critical, coalesce(sh, 0) AS security_high, coalesce(qn, 0) AS smells, coalesce(n, 0) AS total FROM latest LEFT JOIN counts USING (analysis_id)""")
def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    own = rel.latest_scan(analyses(spark, d)).select("repo_id", "analysis_id")
    n = rel.risk_by_scan(own, findings(spark, d))
    total = lambda p: F.coalesce(sum((F.col(p + x) for x in "hmli"), F.col(p + "c")), F.lit(0))
    return n.select("repo_id", "analysis_id", total("s_").alias("security"), F.coalesce("s_c", F.lit(0)).alias("security_critical"), F.coalesce("s_h", F.lit(0)).alias("security_high"), total("q_").alias("smells"), total("").alias("total"))


@query(""", changed AS (SELECT DISTINCT analysis_id, file FROM findings), item AS (SELECT analysis_id, file, lpad(CAST(line AS VARCHAR), 6, '0') || ':' || issue || ':' || severity AS t FROM findings WHERE category = 'security')
SELECT analysis_id, file, count(t) AS n, coalesce(string_agg(t, ';' ORDER BY t), '') AS findings FROM changed LEFT JOIN item USING (analysis_id, file) GROUP BY ALL""")
def findings_by_file_nested(spark: SparkSession, d: str) -> DataFrame:
    return rel.nested_by_file(findings(spark, d).select("analysis_id", "file").distinct(), security(spark, d))


def _diff(kind: str) -> str:
    a, b = ("before", "after") if kind == "fixed" else ("after", "before")
    test = "NOT EXISTS" if kind in ("fixed", "new") else "EXISTS"
    return PAIRS + f""" SELECT p.before, p.after, x.file, x.issue, x.line, x.severity, x.category FROM pairs p JOIN own x ON x.analysis_id = p.{a}
WHERE {test} (SELECT 1 FROM own y WHERE y.analysis_id = p.{b} AND y.file = x.file AND y.issue = x.issue)"""


def _scan_diff(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return rel.scan_diff(rel.scan_pairs(analyses(spark, d)), findings(spark, d)).where(F.col("kind") == kind).drop("kind")


@query(_diff("fixed"))
def scan_diff_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _scan_diff(spark, d, "fixed")


@query(_diff("new"))
def scan_diff_new(spark: SparkSession, d: str) -> DataFrame:
    return _scan_diff(spark, d, "new")


@query(_diff("remaining"))
def scan_diff_remaining(spark: SparkSession, d: str) -> DataFrame:
    return _scan_diff(spark, d, "remaining")


@query(PAIRS + COUNTS + """, v AS (SELECT before, after, coalesce(a.sn, 0) AS sa, coalesce(b.sn, 0) AS sb, coalesce(a.qn, 0) AS qa, coalesce(b.qn, 0) AS qb, least(100, coalesce(25 * a.c + 15 * a.h + 6 * a.m + a.l, 0)) AS ra, least(100, coalesce(25 * b.c + 15 * b.h + 6 * b.m + b.l, 0)) AS rb
  FROM pairs LEFT JOIN counts a ON a.analysis_id = before LEFT JOIN counts b ON b.analysis_id = after)
SELECT before, after, CASE WHEN rb < ra THEN 'Improved' WHEN rb > ra THEN 'Regressed' ELSE 'Unchanged' END AS status,
  CAST(CASE WHEN sa = sb THEN 0 WHEN sa = 0 THEN -100 ELSE trunc((sa - sb) * 100 / sa) END AS INTEGER) AS security_pct, CAST(CASE WHEN qa = qb THEN 0 WHEN qa = 0 THEN -100 ELSE trunc((qa - qb) * 100 / qa) END AS INTEGER) AS smells_pct FROM v""")  # fmt: skip
def scan_compare_improvement(spark: SparkSession, d: str) -> DataFrame:
    n = rel.risk_by_scan(analyses(spark, d).select("analysis_id"), findings(spark, d))
    total = lambda p: F.coalesce(sum((F.col(p + x) for x in "hmli"), F.col(p + "c")), F.lit(0))
    n = n.select("analysis_id", total("s_").alias("s"), total("q_").alias("q"), F.col("risk_score").alias("r"))
    both = rel.scan_pairs(analyses(spark, d)).join(n.withColumnsRenamed({"analysis_id": "before", "s": "sa", "q": "qa", "r": "ra"}), "before").join(n.withColumnsRenamed({"analysis_id": "after", "s": "sb", "q": "qb", "r": "rb"}), "after")
    status = F.when(F.col("rb") < F.col("ra"), "Improved").when(F.col("rb") > F.col("ra"), "Regressed").otherwise("Unchanged")
    return both.select("before", "after", status.alias("status"), scores.improvement_pct(F.col("sa"), F.col("sb")).alias("security_pct"), scores.improvement_pct(F.col("qa"), F.col("qb")).alias("smells_pct"))


@query(PAIRS + """ SELECT f.* EXCLUDE (ord) FROM findings f JOIN pairs p ON f.analysis_id = p.before WHERE EXISTS (SELECT 1 FROM findings g WHERE g.analysis_id = p.after AND g.file = f.file AND g.issue = f.issue)""")
def delete_resolved(spark: SparkSession, d: str) -> DataFrame:
    return rel.resolve(rel.scan_pairs(analyses(spark, d)), findings(spark, d)).drop("ord")


@query(""" SELECT * EXCLUDE (ord) FROM findings QUALIFY row_number() OVER (PARTITION BY analysis_id, file, line, substr(issue, 1, 7) ORDER BY ord) = 1""")
def merge_dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return rel.keep_first(findings(spark, d), 7).drop("ord")


@query(""" SELECT analysis_id, category, file, line, issue, severity, CAST(row_number() OVER (PARTITION BY analysis_id, category ORDER BY file, line, issue, ord) AS INTEGER) AS place FROM findings WHERE category IN ('security', 'code_smell')""")
def persist_findings_sorted(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("analysis_id", "category").orderBy("file", "line", "issue", "ord"))
    return findings(spark, d).where(F.col("category").isin("security", "code_smell")).select("analysis_id", "category", "file", "line", "issue", "severity", place.alias("place"))


@query(""", f AS (SELECT DISTINCT analysis_id, file FROM findings), n AS (SELECT analysis_id, file, count(*) AS n FROM findings WHERE category <> 'style' GROUP BY ALL)
SELECT analysis_id, file, coalesce(n, 0) AS findings, CASE WHEN a.status = 'failed' THEN 'Failed' WHEN n > 0 THEN 'Analyzed' ELSE 'Inventoried' END AS file_status FROM f JOIN analyses a USING (analysis_id) LEFT JOIN n USING (analysis_id, file)""")
def file_log(spark: SparkSession, d: str) -> DataFrame:
    all_findings = findings(spark, d)
    n = all_findings.where(F.col("category") != "style").groupBy("analysis_id", "file").agg(F.count(F.lit(1)).alias("n"))
    log = all_findings.select("analysis_id", "file").distinct().join(analyses(spark, d).select("analysis_id", "status"), "analysis_id").join(n, ["analysis_id", "file"], "left")
    status = F.when(F.col("status") == "failed", "Failed").when(F.col("n") > 0, "Analyzed").otherwise("Inventoried")
    return log.select("analysis_id", "file", F.coalesce("n", F.lit(0)).alias("findings"), status.alias("file_status"))


@query(" SELECT analysis_id, repo_id, scanned_at, status FROM analyses ORDER BY scanned_at DESC, analysis_id LIMIT 100 OFFSET 200")
def audit_page(spark: SparkSession, d: str) -> DataFrame:
    return rel.page(analyses(spark, d).select("analysis_id", "repo_id", "scanned_at", "status"), [F.col("scanned_at").desc(), F.col("analysis_id")], 3, 250)


@query(" SELECT * FROM (SELECT analysis_id, repo_id, status FROM analyses ORDER BY analysis_id DESC LIMIT 50 OFFSET 50) WHERE status = 'failed'")
def dlq_page_then_filter(spark: SparkSession, d: str) -> DataFrame:
    """The page is cut before its rows are filtered, so it may come out short."""
    return rel.page(analyses(spark, d).select("analysis_id", "repo_id", "status"), [F.col("analysis_id").desc()], 2, 50).where(F.col("status") == "failed")


@query(LATEST + """ SELECT repo_id, analysis_id, severity, file, issue, CAST(row_number() OVER w AS INTEGER) AS place FROM latest JOIN findings USING (analysis_id) WHERE category = 'security' WINDOW w AS (PARTITION BY repo_id ORDER BY severity, file, ord) QUALIFY place <= 8""")
def chat_context(spark: SparkSession, d: str) -> DataFrame:
    """Eight findings of the latest scan by severity as text, then file."""
    own = rel.latest_scan(analyses(spark, d)).select("repo_id", "analysis_id").join(security(spark, d), "analysis_id")
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("severity", "file", "ord"))
    return own.select("repo_id", "analysis_id", "severity", "file", "issue", place.alias("place")).where(F.col("place") <= 8)


@query(""", o AS (SELECT repo_id, pull_request_id % 50 AS number, 'title ' || max(analysis_id) AS title FROM analyses WHERE pull_request_id IS NOT NULL AND scanned_at < '1998-01-01' GROUP BY ALL),
n AS (SELECT repo_id, pull_request_id % 50 AS number, 'title ' || max(analysis_id) AS title FROM analyses WHERE pull_request_id IS NOT NULL AND scanned_at >= '1998-01-01' GROUP BY ALL)
SELECT repo_id, number, coalesce(n.title, o.title) AS title, CASE WHEN n.title IS NULL THEN 'closed' ELSE 'open' END AS state, CASE WHEN o.title IS NULL THEN 'inserted' WHEN n.title IS NULL THEN 'closed' ELSE 'updated' END AS action FROM o FULL JOIN n USING (repo_id, number)""")  # fmt: skip
def pr_upsert(spark: SparkSession, d: str) -> DataFrame:
    prs = analyses(spark, d).where(F.col("pull_request_id").isNotNull()).withColumn("number", F.col("pull_request_id") % 50)
    cut = F.col("scanned_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    of = lambda rows: rows.groupBy("repo_id", "number").agg(F.concat(F.lit("title "), F.max("analysis_id").cast("string")).alias("title")).withColumn("state", F.lit("open"))
    return rel.upsert(of(prs.where(cut)), of(prs.where(~cut)), ["repo_id", "number"])


@query(""", e AS (SELECT c_custkey AS id, c_nationkey, ' ' || CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END || c_nationkey || '@Mail ' AS email FROM customer), k AS (SELECT *, lower(trim(email)) AS normal FROM e)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY normal ORDER BY id) = 1 THEN normal ELSE email END AS email FROM k""")  # fmt: skip
def email_oldest_wins(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), name, F.col("c_nationkey").cast("string"), F.lit("@Mail ")).alias("email"))
    marked = rel.oldest_wins(rows, F.lower(F.trim("email")), F.col("id"))
    return marked.select("id", F.when(F.col("wins"), F.col("normal")).otherwise(F.col("email")).alias("email"))


@query(COUNTS + """, snap AS (SELECT analysis_id, n FROM counts JOIN analyses USING (analysis_id) WHERE status = 'completed') SELECT analysis_id, n AS total_issues FROM snap WHERE analysis_id % 2 = 1""")
def snapshot_append(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots that an append would add where those of even scans are stored already."""
    fresh = findings(spark, d).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("total_issues")).join(analyses(spark, d).where(F.col("status") == "completed").select("analysis_id"), "analysis_id")
    return rel.append_missing(fresh.where(F.col("analysis_id") % 2 == 0), fresh, "analysis_id")


@query(""" SELECT analysis_id, t AS report_type FROM analyses CROSS JOIN (VALUES ('PDF', 0), ('Markdown', 1), ('JSON', 2), ('CSV', 3)) v(t, i) WHERE status = 'completed' AND analysis_id % 4 <> i""")
def missing_reports(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("PDF", "Markdown", "JSON", "CSV")))
    done = analyses(spark, d).where(F.col("status") == "completed")
    wanted = done.select("analysis_id", F.explode(kinds).alias("report_type"))
    return wanted.join(done.select("analysis_id", F.get(kinds, (F.col("analysis_id") % 4).cast("int")).alias("report_type")), ["analysis_id", "report_type"], "left_anti")


@query(""", k AS (SELECT *, sha256(concat_ws('|', repo_id, analysis_id % 3, 'v1', coalesce(model, 'unknown'))) AS cache_key FROM analyses WHERE status = 'completed')
SELECT cache_key, min(analysis_id) AS stored_id, count(*) - 1 AS hit_count, max(scanned_at) AS last_at FROM k GROUP BY cache_key""")  # fmt: skip
def result_cache(spark: SparkSession, d: str) -> DataFrame:
    """Scans of the same content identity: the first is stored, the others are hits."""
    key = rel.cache_key(F.col("repo_id").cast("string"), (F.col("analysis_id") % 3).cast("string"), F.lit("v1"), F.coalesce("model", F.lit("unknown")))
    rows = analyses(spark, d).where(F.col("status") == "completed").groupBy(key.alias("cache_key"))
    return rows.agg(F.min("analysis_id").alias("stored_id"), (F.count(F.lit(1)) - 1).alias("hit_count"), F.max("scanned_at").alias("last_at"))


@query(""", gone AS (SELECT analysis_id FROM analyses WHERE repo_id % 10 = 3) SELECT 'repositories' AS child, count(*) AS n, CAST(sum(repo_id) AS BIGINT) AS ids FROM repositories WHERE repo_id % 10 <> 3 UNION ALL SELECT 'analyses', count(*), CAST(sum(analysis_id) AS BIGINT) FROM analyses WHERE repo_id % 10 <> 3
UNION ALL SELECT 'findings', count(*), CAST(sum(analysis_id) AS BIGINT) FROM findings WHERE analysis_id NOT IN (SELECT analysis_id FROM gone) UNION ALL SELECT 'cache', count(*), CAST(sum(analysis_id) AS BIGINT) FROM analyses WHERE status = 'completed' AND repo_id % 10 <> 3""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each table when repositories whose id ends in 3 are deleted with all that hangs on them."""
    repos, scans = repositories(spark, d), analyses(spark, d)
    tables = {"repositories": (repos, "repo_id"), "analyses": (scans, "analysis_id"), "findings": (findings(spark, d), "analysis_id"), "cache": (scans.where(F.col("status") == "completed").select("repo_id", "analysis_id"), "analysis_id")}
    left = rel.cascade(repos.where(F.col("repo_id") % 10 == 3).select("repo_id"), {k: v for k, (v, _) in tables.items()}, scans.select("repo_id", "analysis_id"))
    return reduce(DataFrame.unionByName, [left[k].agg(F.count(F.lit(1)).alias("n"), F.sum(key).cast("long").alias("ids")).select(F.lit(k).alias("child"), "n", "ids") for k, (_, key) in tables.items()])


@query(""" SELECT analysis_id, repo_id, CASE WHEN repo_id % 7 = 0 THEN true WHEN repo_id % 7 = 1 THEN false ELSE is_deleted END AS is_deleted FROM analyses""")
def soft_delete_restore(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("repo_id") % 7
    return analyses(spark, d).select("analysis_id", "repo_id", F.when(kind == 0, True).when(kind == 1, False).otherwise(F.col("is_deleted")).alias("is_deleted"))


@query(LATEST + """, e AS (SELECT repo_id, analysis_id, file, CASE severity WHEN 'Critical' THEN 4.0 WHEN 'High' THEN 3.0 WHEN 'Medium' THEN 1.0 ELSE 0.0 END AS hours FROM latest JOIN findings USING (analysis_id) WHERE category = 'security'),
g AS (SELECT repo_id, file, round(CAST(sum(hours) AS DOUBLE), 1) AS hours FROM e GROUP BY ALL) SELECT repo_id, file, hours, CAST(row_number() OVER w AS INTEGER) AS place FROM g WINDOW w AS (PARTITION BY repo_id ORDER BY hours DESC, file) QUALIFY place <= 5""")  # fmt: skip
def effort_hours_by_file(spark: SparkSession, d: str) -> DataFrame:
    own = rel.latest_scan(analyses(spark, d)).select("repo_id", "analysis_id").join(security(spark, d), "analysis_id")
    hours = own.groupBy("repo_id", "file").agg(F.round(F.sum(rel.effort(F.col("severity"))), 1).alias("hours"))
    return hours.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.col("hours").desc(), "file"))).where(F.col("place") <= 5)


@query(COUNTS + """ SELECT repo_id, analysis_id, name, status, CAST(least(100, 25 * coalesce(c, 0) + 15 * coalesce(h, 0) + 6 * coalesce(m, 0) + coalesce(l, 0)) AS INTEGER) AS risk_score, coalesce(n, 0) AS n
FROM analyses JOIN repositories USING (repo_id) LEFT JOIN counts USING (analysis_id) WHERE NOT coalesce(is_deleted, false)""")  # fmt: skip
def scan_list(spark: SparkSession, d: str) -> DataFrame:
    n = rel.risk_by_scan(analyses(spark, d).where(rel.not_flagged("is_deleted")), findings(spark, d)).join(repositories(spark, d), "repo_id")
    return n.select("repo_id", "analysis_id", "name", "status", "risk_score", F.coalesce(sum((F.col(x) for x in "hmli"), F.col("c")), F.lit(0)).alias("n"))

"""Queries over answers of a code host and over lists of scans, pull requests and commits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.operators import relational, scores, service
from auditspark.sources.adapters import analyses, findings, repositories, sql, table
from auditspark.sources.repos import CTE as REPOS
from auditspark.sources.repos import repo_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None, own: bool = True) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle if own else sql(oracle)
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Events as commits of twenty repositories."""
    key = F.col("event_id")
    message = F.concat(F.repeat(F.concat("event_type", F.lit(" ")), (key % 60).cast("int")), key.cast("string"), F.lit("\n\nbody"))
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("repo"), F.sha1(key.cast("string").cast("binary")).alias("sha"), F.when(key % 11 != 0, F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("author"), F.col("ts").alias("date"), message.alias("message"))


COMMITS = "c AS (SELECT user_id % 20 AS repo, sha1(CAST(event_id AS VARCHAR)) AS sha, CASE WHEN event_id % 11 <> 0 THEN 'user' || user_id END AS author, ts AS date, repeat(event_type || ' ', event_id % 60) || event_id || chr(10) || chr(10) || 'body' AS message FROM events)"


@query(f"WITH {COMMITS} SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY date DESC, sha DESC) AS INTEGER) AS place, sha[:8] AS short_sha, coalesce(author, 'unknown') AS author, date, split_part(message, chr(10), 1)[:200] AS message FROM c QUALIFY place <= 30")
def commit_list(spark: SparkSession, d: str) -> DataFrame:
    return service.recent_commits(commits(spark, d))


@query(f"WITH {COMMITS} SELECT repo, sha FROM c WHERE contains(lower(message), 'click 1') OR contains(lower(coalesce(author, '')), 'user7') OR contains(sha, 'abcd')")
def commit_search(spark: SparkSession, d: str) -> DataFrame:
    """Commits whose message, author or id holds a text, in any case."""
    found = F.lit(False)
    for c, words in (("message", "CLICK 1"), ("author", "User7"), ("sha", "ABCD")):
        found = found | F.lower(F.coalesce(c, F.lit(""))).contains(words.lower())
    return commits(spark, d).where(found).select("repo", "sha")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """A JSON answer for each order: a commit with its items as files; one in three has no totals."""
    n = F.col("l_orderkey")
    file = F.struct(
        F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("filename"), F.when(F.col("l_linenumber") % 3 == 0, "removed").otherwise("modified").alias("status"), F.col("l_quantity").cast("long").alias("additions"),
        F.col("l_linenumber").cast("long").alias("deletions"), (F.col("l_quantity") + F.col("l_linenumber")).cast("long").alias("changes"), F.lit("@@").alias("patch"), F.concat(F.lit("raw/"), F.col("l_partkey").cast("string")).alias("raw_url"),
    )
    made = table(spark, d, "lineitem").groupBy(n.alias("id")).agg(F.collect_list(file).alias("files"))
    stats = F.when(F.col("id") % 3 != 0, F.struct((F.col("id") * 2).cast("long").alias("additions"), F.lit(5).cast("long").alias("deletions")))
    parents = F.when(F.col("id") % 4 != 0, F.array(F.concat(F.lit("p"), F.col("id").cast("string")))).otherwise(F.array().cast("array<string>"))
    return made.select("id", F.to_json(F.struct(F.sha1(F.col("id").cast("string").cast("binary")).alias("sha"), parents.alias("parents"), F.lit("m").alias("message"), stats.alias("stats"), "files")).alias("json"))


@query("""SELECT l_orderkey AS id, sha1(CAST(l_orderkey AS VARCHAR)) AS sha, CASE WHEN l_orderkey % 4 <> 0 THEN 'p' || l_orderkey END AS parent_sha, CASE WHEN l_orderkey % 3 <> 0 THEN l_orderkey * 2 ELSE CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) END AS additions,
CASE WHEN l_orderkey % 3 <> 0 THEN 5 ELSE CAST(sum(l_linenumber) AS BIGINT) END AS deletions, CAST(count(*) AS INTEGER) AS files FROM lineitem GROUP BY l_orderkey""")
def commit_detail(spark: SparkSession, d: str) -> DataFrame:
    return service.commit_details(answers(spark, d))


@query("SELECT l_orderkey AS id, 'f' || l_partkey AS filename, CASE WHEN l_linenumber % 3 = 0 THEN 'removed' ELSE 'modified' END AS status, CAST(l_quantity AS BIGINT) AS additions, CAST(l_linenumber AS BIGINT) AS deletions, CAST(l_quantity + l_linenumber AS BIGINT) AS changes, '@@' AS patch, 'raw/' || l_partkey AS raw_url FROM lineitem")
def pr_files(spark: SparkSession, d: str) -> DataFrame:
    return service.changed_files(answers(spark, d))


def pulls(spark: SparkSession, d: str) -> DataFrame:
    """A JSON answer for each order that is a pull request of its customer."""
    key = F.col("o_orderkey")
    own = F.struct(key.cast("long").alias("number"), F.concat(F.lit("PR "), key.cast("string")).alias("title"), F.lower("o_orderpriority").alias("author"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"), (key % 70).cast("long").alias("additions"), (key % 30).cast("long").alias("deletions"))
    return table(spark, d, "orders").where(key % 3 == 0).select(F.col("o_custkey").alias("repo"), F.to_json(own).alias("json"))


PULLS = "p AS (SELECT o_custkey AS repo, CAST(o_orderkey AS BIGINT) AS number, 'PR ' || o_orderkey AS title, lower(o_orderpriority) AS author, CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS state, CAST(o_orderkey % 70 AS BIGINT) AS additions, CAST(o_orderkey % 30 AS BIGINT) AS deletions FROM orders WHERE o_orderkey % 3 = 0)"


@query(f"WITH {PULLS} SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY number DESC) AS INTEGER) AS place FROM p WHERE state = 'open'")
def open_prs(spark: SparkSession, d: str) -> DataFrame:
    return service.pull_requests(pulls(spark, d), "open").drop("head_sha", "base_sha")


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of pull requests: items of their orders, with a date and a risk."""
    return table(spark, d, "lineitem").where(F.col("l_orderkey") % 6 == 0).select(F.col("l_orderkey").cast("long").alias("number"), F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").cast("long").alias("review_id"), (F.col("l_quantity").cast("int") * 2).alias("risk_score"))


REVIEWS = "v AS (SELECT CAST(l_orderkey AS BIGINT) AS number, l_shipdate AS created_at, CAST(l_linenumber AS BIGINT) AS review_id, CAST(l_quantity AS INTEGER) * 2 AS risk_score FROM lineitem WHERE l_orderkey % 6 = 0), latest AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY number ORDER BY created_at DESC, review_id DESC, risk_score DESC) = 1)"


@query(f"WITH {PULLS}, {REVIEWS} SELECT p.repo, p.number, p.title, p.state, coalesce(review_id, -1) AS review_id, coalesce(risk_score, -1) AS risk_score FROM p LEFT JOIN latest USING (number)")
def pr_list(spark: SparkSession, d: str) -> DataFrame:
    """Pull requests with their newest review."""
    newest = relational.first_by(reviews(spark, d), ["number"], F.desc("created_at"), F.desc("review_id"), F.desc("risk_score"))
    rows = service.pull_requests(pulls(spark, d)).join(newest, "number", "left")
    return rows.select("repo", "number", "title", "state", F.coalesce("review_id", F.lit(-1)).alias("review_id"), F.coalesce("risk_score", F.lit(-1)).alias("risk_score"))


@query(f"WITH {REVIEWS} SELECT * FROM latest")
def latest_reviews(spark: SparkSession, d: str) -> DataFrame:
    return relational.first_by(reviews(spark, d), ["number"], F.desc("created_at"), F.desc("review_id"), F.desc("risk_score"))


@query(f"WITH {COMMITS} SELECT repo, sha, repo % 3 = 0 AND sha < '8' AS analyzed FROM c")
def commits_analyzed(spark: SparkSession, d: str) -> DataFrame:
    """Commits with a mark where an analysis of them exists."""
    known = commits(spark, d).where((F.col("repo") % 3 == 0) & (F.col("sha") < "8")).select("repo", "sha", F.lit(True).alias("known"))
    return commits(spark, d).select("repo", "sha").join(known, ["repo", "sha"], "left").select("repo", "sha", F.col("known").isNotNull().alias("analyzed"))


@query("""WITH m AS (SELECT c_custkey AS repo, CAST(c_custkey % 100 AS BIGINT) AS stars, CAST(c_nationkey AS BIGINT) AS forks, CAST(c_custkey % 7 AS BIGINT) AS issues, c_nationkey * 10 AS py, c_custkey % 90 AS go FROM customer)
SELECT repo, stars, forks, issues, CASE WHEN repo % 5 = 0 THEN NULL WHEN py > go THEN 'Python' WHEN go > py THEN 'Go' ELSE 'Python' END AS language, CASE WHEN repo % 5 = 0 THEN 0 ELSE CAST(py + go AS BIGINT) END AS bytes FROM m""")
def repo_metadata(spark: SparkSession, d: str) -> DataFrame:
    own = F.struct(
        (F.col("c_custkey") % 100).alias("stars"), F.col("c_nationkey").alias("forks"), (F.col("c_custkey") % 7).alias("issues"),
        F.when(F.col("c_custkey") % 5 != 0, F.create_map(F.lit("Python"), F.col("c_nationkey").cast("long") * 10, F.lit("Go"), (F.col("c_custkey") % 90).cast("long"))).alias("languages"),
    )
    return service.repository_metadata(table(spark, d, "customer").select(F.col("c_custkey").alias("repo"), F.to_json(own).alias("json")))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 3 THEN 'b/c' || s_suppkey ELSE 'own' || s_nationkey || '/proj' || s_suppkey END AS repository FROM supplier""")
def repo_urls(spark: SparkSession, d: str) -> DataFrame:
    """Links in several forms, and what they name."""
    key, owner, name = F.col("s_suppkey"), F.concat(F.lit("own"), F.col("s_nationkey").cast("string")), F.concat(F.lit("proj"), F.col("s_suppkey").cast("string"))
    host = F.lit(service.HOST)
    url = F.when(key % 6 == 0, F.concat(F.lit(" https://"), host, F.lit("/"), owner, F.lit("/"), name, F.lit(".git "))).when(key % 6 == 1, F.concat(F.lit("git@"), host, F.lit(":"), owner, F.lit("/"), name)).when(key % 6 == 2, F.concat(owner, F.lit("/"), name, F.lit("/")))
    url = url.when(key % 6 == 3, F.concat(F.lit("https://a.org/b/c"), key.cast("string"))).when(key % 6 == 4, name)
    return table(spark, d, "supplier").select(key.alias("id"), service.repository_name(url).alias("repository"))


#: Full scans, by repository the newest.
FULL = ", full_latest AS (SELECT * FROM analyses WHERE status = 'completed' AND NOT coalesce(is_deleted, false) AND pull_request_id IS NULL QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY scanned_at DESC, analysis_id DESC) = 1)"


def full_latest(spark: SparkSession, d: str) -> DataFrame:
    return relational.latest_scan(analyses(spark, d).where(F.col("pull_request_id").isNull()))


@query(FULL + " SELECT r.repo_id, CASE WHEN f.analysis_id IS NULL THEN 'head' ELSE 'c' || f.analysis_id END AS ref, count(DISTINCT g.file) AS files FROM repositories r LEFT JOIN full_latest f USING (repo_id) LEFT JOIN findings g USING (analysis_id) GROUP BY ALL", own=False)
def pinned_files(spark: SparkSession, d: str) -> DataFrame:
    """What each repository's files are read at, its newest full scan or the branch's head, and how many were found."""
    pinned = repositories(spark, d).select("repo_id").join(full_latest(spark, d).select("repo_id", "analysis_id"), "repo_id", "left")
    found = findings(spark, d).select("analysis_id", "file").distinct().groupBy("analysis_id").agg(F.count(F.lit(1)).alias("files"))
    ref = F.coalesce(F.concat(F.lit("c"), F.col("analysis_id").cast("string")), F.lit("head"))
    return pinned.join(found, "analysis_id", "left").select("repo_id", ref.alias("ref"), F.coalesce("files", F.lit(0)).alias("files"))


@query(FULL + """ SELECT r.repo_id, coalesce(f.analysis_id, -1) AS last_scan, coalesce(CASE WHEN f.analysis_id % 2 = 0 THEN 'c' || f.analysis_id % 3 ELSE 's' || f.analysis_id % 3 END, '') AS last_commit,
coalesce(CASE WHEN f.analysis_id % 2 = 0 THEN 'c' || f.analysis_id % 3 ELSE 's' || f.analysis_id % 3 END = 'c' || r.repo_id % 3, false) AS same_state FROM repositories r LEFT JOIN full_latest f USING (repo_id)""", own=False)
def scan_identity(spark: SparkSession, d: str) -> DataFrame:
    """Is the head of each repository what its newest full scan saw? The scan's own commit counts, else its snapshot's."""
    n = F.col("analysis_id")
    own = F.when(n % 2 == 0, F.concat(F.lit("c"), (n % 3).cast("string")))
    snapshots = analyses(spark, d).select("analysis_id", F.concat(F.lit("s"), (n % 3).cast("string")).alias("snapshot_commit"))
    scanned = full_latest(spark, d).select("repo_id", "analysis_id", own.alias("commit")).join(snapshots, "analysis_id")
    joined = repositories(spark, d).select("repo_id").join(scanned, "repo_id", "left")
    last, head = F.coalesce("commit", "snapshot_commit"), F.concat(F.lit("c"), (F.col("repo_id") % 3).cast("string"))
    return joined.select("repo_id", F.coalesce("analysis_id", F.lit(-1)).alias("last_scan"), F.coalesce(last, F.lit("")).alias("last_commit"), F.coalesce(last == head, F.lit(False)).alias("same_state"))


@query(" SELECT user_id, analysis_id, coalesce(model, 'default') AS model, prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens, duration FROM analyses JOIN repositories USING (repo_id)", own=False)
def scan_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = analyses(spark, d).join(repositories(spark, d).select("repo_id", "user_id"), "repo_id")
    return rows.select("user_id", "analysis_id", F.coalesce("model", F.lit("default")).alias("model"), "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), "duration")


@query(" SELECT user_id, analysis_id, name, scanned_at FROM analyses JOIN repositories USING (repo_id) WHERE is_deleted", own=False)
def deleted_scans(spark: SparkSession, d: str) -> DataFrame:
    return analyses(spark, d).where(F.col("is_deleted")).join(repositories(spark, d), "repo_id").select("user_id", "analysis_id", "name", "scanned_at")


@query(" SELECT user_id, analysis_id, category, count(*) AS n, min(file) AS first_file FROM findings JOIN analyses USING (analysis_id) JOIN repositories USING (repo_id) WHERE category IN ('security', 'code_smell') AND NOT coalesce(is_deleted, false) GROUP BY ALL", own=False)
def findings_by_scan(spark: SparkSession, d: str) -> DataFrame:
    """Security findings and smells of the scans that a user owns."""
    owned = analyses(spark, d).where(relational.not_flagged("is_deleted")).join(repositories(spark, d).select("repo_id", "user_id"), "repo_id").select("user_id", "analysis_id")
    own = findings(spark, d).where(F.col("category").isin("security", "code_smell")).groupBy("analysis_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first_file"))
    return own.join(owned, "analysis_id").select("user_id", "analysis_id", "category", "n", "first_file")


CACHE = ", k AS (SELECT analysis_id, repo_id, first_value(analysis_id) OVER (PARTITION BY repo_id, analysis_id % 3 ORDER BY scanned_at, analysis_id) AS source_id FROM analyses WHERE status = 'completed')"


@query(CACHE + " SELECT k.analysis_id, f.file, f.line, f.issue, f.severity FROM k JOIN findings f ON f.analysis_id = k.source_id WHERE k.source_id <> k.analysis_id", own=False)
def cached_results(spark: SparkSession, d: str) -> DataFrame:
    """Scans of a state that was scanned before get the first scan's findings under their own id."""
    done = analyses(spark, d).where(F.col("status") == "completed").withColumn("state", F.col("analysis_id") % 3)
    first = done.groupBy("repo_id", "state").agg(F.min(F.struct("scanned_at", "analysis_id"))["analysis_id"].alias("source_id"))
    hits = done.join(first, ["repo_id", "state"]).where(F.col("source_id") != F.col("analysis_id")).select("source_id", "analysis_id")
    cached = findings(spark, d).select(F.col("analysis_id").alias("source_id"), "file", "line", "issue", "severity")
    return service.rematerialised(hits, cached)


@query("""SELECT event_id, user_id, event_type AS action, '{"k":' || CAST(json_extract(props, '$.k') AS INTEGER) || ',"event":' || event_id || '}' AS details FROM events WHERE event_type IN ('click', 'purchase')
UNION ALL SELECT event_id, user_id, 'login', '{"k":0,"event":' || event_id || '}' FROM events WHERE event_type = 'view'""")
def audit_append(spark: SparkSession, d: str) -> DataFrame:
    """An audit log with new actions appended, details as JSON."""
    rows = table(spark, d, "events")
    details = lambda k: F.to_json(F.struct(k.alias("k"), F.col("event_id").alias("event")))
    log = rows.where(F.col("event_type").isin("click", "purchase")).select("event_id", "user_id", F.col("event_type").alias("action"), details(F.get_json_object("props", "$.k").cast("int")).alias("details"))
    fresh = rows.where(F.col("event_type") == "view").select("event_id", "user_id", F.lit("login").alias("action"), details(F.lit(0)).alias("details"))
    return log.unionByName(fresh)


@query("""WITH s AS (SELECT event_id, (event_id * 37 % 400000) - 100000 AS n FROM events), a AS (SELECT *, abs(n) AS b FROM s), l AS (SELECT *, CASE WHEN b < 60 THEN 'just now' WHEN b < 3600 THEN (b // 60) || ' minute' || CASE WHEN b // 60 = 1 THEN '' ELSE 's' END
WHEN b < 86400 THEN (b // 3600) || ' hour' || CASE WHEN b // 3600 = 1 THEN '' ELSE 's' END ELSE (b // 86400) || ' day' || CASE WHEN b // 86400 = 1 THEN '' ELSE 's' END END AS t FROM a)
SELECT event_id, CASE WHEN b < 60 THEN t WHEN n >= 0 THEN t || ' ago' ELSE 'in ' || t END AS label FROM l""")
def relative_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", service.relative_label(F.col("event_id") * 37 % 400000 - 100000).alias("label"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END AS utc FROM events""")
def utc_times(spark: SparkSession, d: str) -> DataFrame:
    """Times as text without a zone, two hours ahead, or with Z: all as UTC."""
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(local, F.when(F.col("event_id") % 3 == 1, "+02:00").when(F.col("event_id") % 3 == 2, "Z").otherwise(""))
    return table(spark, d, "events").select("event_id", service.utc_time(text).alias("utc"))


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') || ' “x” – → ✔ ⚙️ 📁 ж ⭐' AS s FROM documents)
SELECT doc_id, sha256(regexp_replace({"replace(" * len(service.PRINTED)}s{"".join(f", {quoted(k)}, {quoted(v)})" for k, v in service.PRINTED.items())}, '[^\\x00-\\x{{FF}}]', '?', 'g')) AS digest FROM t""")
def printable_texts(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.coalesce("text", F.lit("")), F.lit(" “x” – → ✔ ⚙️ \U0001f4c1 ж ⭐"))
    return table(spark, d, "documents").select("doc_id", F.sha2(service.printable(own), 256).alias("digest"))


@query(f"""WITH {REPOS}, b AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext, length(content) - length(replace(content, '{{', '')) - length(content) + length(replace(content, '}}', '')) AS braces, length(content) - length(replace(content, '(', '')) - length(content) + length(replace(content, ')', '')) AS parens FROM repo_files)
SELECT file_id AS id, CASE WHEN ext IN ('.py', '') THEN ext = '.py' OR path IN ('none') WHEN ext IN ('.js', '.ts', '.jsx', '.tsx') THEN braces = 0 AND parens = 0 ELSE trim(content, ' ' || chr(10)) <> '' END AS ok FROM b WHERE ext <> ''""")
def fix_checks(spark: SparkSession, d: str) -> DataFrame:
    """Files as proposed fixes: all Python ones of the templates parse."""
    own = repo_files(spark, d).where(F.col("path").rlike(r"\.[^./]*$"))
    return service.fix_checks(own.select(F.col("file_id").alias("id"), "path", F.col("content").alias("code"))).select("id", "ok")


@query(" SELECT repo_id, name FROM repositories WHERE contains(lower(name), '00012')", own=False)
def repository_search(spark: SparkSession, d: str) -> DataFrame:
    return repositories(spark, d).where(F.lower("name").contains("00012")).select("repo_id", "name")


DASH = """, live AS (SELECT a.*, r.user_id, r.name FROM analyses a JOIN repositories r USING (repo_id) WHERE status = 'completed' AND NOT coalesce(is_deleted, false) AND coalesce(is_connected, true)),
cnt AS (SELECT analysis_id, count(*) FILTER (severity = 'Critical') AS c, count(*) FILTER (severity = 'High') AS h, count(*) FILTER (severity = 'Medium') AS m, count(*) FILTER (severity = 'Low') AS l, count(*) FILTER (category = 'security') AS s FROM findings GROUP BY analysis_id),
d AS (SELECT user_id, count(*) AS scans, count(pull_request_id) AS pr_scans, CAST(sum(coalesce(s, 0)) AS BIGINT) AS vulnerabilities, avg(least(100, 25 * coalesce(c, 0) + 15 * coalesce(h, 0) + 6 * coalesce(m, 0) + coalesce(l, 0))) AS risk, avg(greatest(0, 100 - 2 * coalesce(s, 0))) AS health, avg(duration) AS duration,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, max(scanned_at) AS last_at, arg_max(name, (scanned_at, analysis_id)) AS last_name FROM live LEFT JOIN cnt USING (analysis_id) GROUP BY user_id),
u AS (SELECT n_nationkey AS user_id FROM nation UNION ALL SELECT 9999), o AS (SELECT user_id, count(*) AS repositories FROM repositories GROUP BY user_id)"""


@query(DASH + """ SELECT u.user_id, coalesce(repositories, 0) AS repositories, coalesce(scans, 0) AS scans, coalesce(pr_scans, 0) AS pr_scans, coalesce(vulnerabilities, 0) AS vulnerabilities, round(coalesce(risk, 0.0), 6) AS average_risk, round(coalesce(health, 0.0), 6) AS average_health,
round(coalesce(greatest(0, 100 - risk), 0.0), 6) AS security_score, round(coalesce(duration, 0.0), 6) AS average_duration, coalesce(tokens, 0) AS tokens, coalesce(last_name, '') AS last_repository FROM u LEFT JOIN o USING (user_id) LEFT JOIN d USING (user_id)""", own=False)
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """The scalar metrics of each user in one row, zero for users without repositories or scans."""
    repos = repositories(spark, d)
    users = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("user_id")).union(spark.range(9999, 10000).toDF("user_id"))
    n = scores.scan_counts(findings(spark, d))
    rows = relational.live_scans(analyses(spark, d), repos).join(n, "analysis_id", "left")
    of = lambda x: F.coalesce(F.col(x), F.lit(0))
    security = sum((of(f"s_{x}") for x in "hmli"), of("s_c"))
    risk = scores.risk(of("c"), of("h"), of("m"), of("l"))
    facts = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("scans"), F.count("pull_request_id").alias("pr_scans"), F.sum(security).alias("vulnerabilities"), F.avg(risk).alias("risk"), F.avg(scores.clamp(100 - 2 * security)).alias("health"), F.avg("duration").alias("duration"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.max(F.struct("scanned_at", "analysis_id", "name"))["name"].alias("last_repository"),
    )
    owned = repos.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("repositories"))
    joined = users.join(owned, "user_id", "left").join(facts.withColumn("user_id", F.col("user_id").cast("long")), "user_id", "left")
    mean = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    return joined.select(
        "user_id", *[of(x).alias(x) for x in ("repositories", "scans", "pr_scans", "vulnerabilities")], mean(F.col("risk"), "average_risk"), mean(F.col("health"), "average_health"), mean(F.when(F.col("risk").isNotNull(), F.greatest(F.lit(0.0), 100 - F.col("risk"))), "security_score"),
        mean(F.col("duration"), "average_duration"), of("tokens").alias("tokens"), F.coalesce("last_repository", F.lit("")).alias("last_repository"),
    )

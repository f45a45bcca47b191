"""Queries over events: the batch forms of the stateful flows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.operators import service
from auditspark.sources.adapters import analyses, sql, table
from auditspark.sources.keyed_table import KeyedTable
from auditspark.sources.shared import shared_folder
from auditspark.streaming import events as ev
from auditspark.streaming import stateful, webhooks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and user group, with seconds since the epoch."""
    return table(spark, d, "events").select((F.col("user_id") % 40).alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id", "event_type", "value", (F.col("event_type") == "error").alias("terminal"))


def rate_limit_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Three requests an hour and key: the same rule as 300 a minute, at the pace of this table."""
    return ev.limited(keyed(spark, d), 3, 3600.0)


def reset_throttle(spark: SparkSession, d: str) -> DataFrame:
    """Requests to reset a password, the clicks of an account: three in a quarter of an hour pass."""
    clicks = keyed(spark, d).where(F.col("event_type") == "click")
    return ev.limited(clicks.withColumn("key", F.col("key") % 4), ev.RESETS, ev.RESET_WINDOW_S)


def scan_events(spark: SparkSession, d: str) -> DataFrame:
    """Starts and ends of scans: each event starts one, which ends after a while, errors without a result."""
    begun = table(spark, d, "events").select((F.col("user_id") % 40).alias("repo"), (F.col("event_id") % 3).alias("commit"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("scan"), (F.col("event_type") != "error").alias("good"))
    ended = begun.withColumn("at", F.col("at") + 600 + F.col("scan") * 7919 % 9000).withColumn("ended", F.lit(True))
    return begun.withColumn("ended", F.lit(False)).unionByName(ended)


def in_flight_guard(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each scan where others of its content run: an hour of waiting, two until a scan counts as lost."""
    return stateful.guarded(scan_events(spark, d), 3600.0, 7200.0)


def progress_throttle(spark: SparkSession, d: str) -> DataFrame:
    return ev.throttled(keyed(spark, d), 1800.0)


def monotone_counters(spark: SparkSession, d: str) -> DataFrame:
    return ev.running_maximum(keyed(spark, d).select("key", "at", "event_id", F.floor("value").alias("n")), "n").select("key", "event_id", "shown")


def webhook_routing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "pull_request").when(F.col("event_type") == "view", "push").otherwise("ping")
    number = F.get_json_object("props", "$.k").cast("int")
    action = F.when(number % 3 == 0, "opened").when(number % 3 == 1, "closed").otherwise("synchronize")
    branch = F.when(number % 2 == 0, "main").otherwise("dev")
    hooks = rows.select("event_id", F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("repo_name"), kind.alias("kind"), action.alias("action"), branch.alias("branch"))
    connected = F.when(F.col("c_mktsegment") == "BUILDING", None).otherwise(F.col("c_mktsegment") != "MACHINERY")
    repos = table(spark, d, "customer").select(F.col("c_name").alias("repo_name"), connected.alias("is_connected"), F.lit("main").alias("default_branch"))
    return ev.route_webhooks(hooks, repos).select("event_id", "repo_name", "kind", "starts")


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Webhook deliveries with JSON bodies and signatures, some broken, of the repositories of ``connected``."""
    n, text = F.col("event_id"), lambda x: F.lit(x)
    event = F.when(n % 5 == 4, "ping").when(n % 5 == 3, "issues").when(n % 2 == 0, "push").otherwise("pull_request")
    action = F.when(n % 3 == 0, "opened").when(n % 3 == 1, "closed").otherwise("synchronize")
    name = F.concat(text("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    parts = [text('{"action":"'), action, text('","ref":"refs/heads/'), F.when(n % 4 == 0, "dev").otherwise("main"), text('","repository":{"full_name":"'), F.when(n % 19 == 0, "").otherwise(name), text('"},"pull_request":{"number":')]
    parts += [(n % 50).cast("string"), text(',"head":{"sha":"h'), n.cast("string"), text('"},"user":{"login":"u'), F.col("user_id").cast("string"), text('"}}}')]
    body = F.when(n % 11 == 0, '{"action": broken').otherwise(F.concat(*parts))
    signature = F.when(n % 13 == 0, None).when(n % 17 == 0, "sha256=00").otherwise(F.concat(text("sha256="), service.hmac_sha256(F.col("body"), SECRET)))
    rows = table(spark, d, "events").select(n.cast("string").alias("delivery_id"), "event_id", event.alias("event"), body.alias("body"), F.col("ts").cast("timestamp").alias("received"))
    return rows.withColumn("signature", signature)


def connected(spark: SparkSession, d: str) -> DataFrame:
    known = F.when(F.col("c_mktsegment") == "BUILDING", None).otherwise(F.col("c_mktsegment") != "MACHINERY")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("name"), F.lit("main").alias("default_branch"), known.alias("is_connected"))


def webhook_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What each delivery starts, or why it starts nothing."""
    found = webhooks.outcomes(deliveries(spark, d), connected(spark, d), SECRET)
    return found.select("delivery_id", "event", "outcome", F.when(F.col("outcome").isin("review", "scan"), F.col("repo_id")).alias("repo_id"))


def webhook_pulls(spark: SparkSession, d: str) -> DataFrame:
    """The pull requests that deliveries have made, as first seen and with their last commits."""
    found = webhooks.outcomes(deliveries(spark, d), connected(spark, d), SECRET)
    return webhooks.newest_pulls(found.where(F.col("outcome") == "review"))


def webhook_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same deliveries received as a stream of files: what each has started, read from the table of outcomes."""
    folder = shared_folder(spark)
    deliveries(spark, d).drop("event_id").write.json(f"{folder}/in")
    receiver = webhooks.Receiver(spark, f"{folder}/tables", lambda: connected(spark, d), SECRET)
    receiver.start(f"{folder}/in", f"{folder}/checkpoint").awaitTermination()
    found = receiver.deliveries.read().select("delivery_id", "event", "outcome")
    started = receiver.analyses.read().select("delivery_id", "repo_id", "status")
    return found.join(started, "delivery_id", "left")


def keyed_appends(spark: SparkSession, d: str) -> DataFrame:
    """One scan of each repository, from two batches that each come twice: of the first batch with any the earliest."""
    scans = analyses(spark, d).select("repo_id", F.col("scanned_at").cast("timestamp").alias("scanned_at"), "analysis_id")
    table_ = KeyedTable(spark, f"{shared_folder(spark)}/scans", scans.schema, ["repo_id"], ["scanned_at"])
    for batch in (0, 0, 1, 1):
        table_.append(scans.where(F.col("analysis_id") % 2 == batch), batch)
    return table_.read().select("repo_id", "analysis_id", "batch")


def dead_letter_replay(spark: SparkSession, d: str) -> DataFrame:
    """Failed events by their JSON argument: how often each is due for replay, and the last one."""
    rows = table(spark, d, "events").where(F.col("event_type") == "error")
    key = F.get_json_object("props", "$.k").cast("int")
    return rows.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


def duplicate_scans(spark: SparkSession, d: str) -> DataFrame:
    """Scans of the same content within two hours of one that was let through are dropped."""
    scans = table(spark, d, "events").select((F.col("user_id") % 40).alias("repo"), (F.col("event_id") % 3).alias("commit"), "ts", "event_id")
    return ev.guard_duplicates(scans, 7200.0).select("repo", "commit", "event_id")


def dead_letter_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Failed tasks with their arguments as JSON; the scan's id is one of them."""
    rows = table(spark, d, "events").where(F.col("event_type") == "error")
    arguments = F.to_json(F.struct((F.col("event_id") * 7 % 5000).alias("analysis_id"), F.lit("scan").alias("task")))
    return rows.select("event_id", "ts", arguments.alias("arguments"), (F.col("event_id") % 4 == 0).alias("resolved"))


def dead_letter_retry(spark: SparkSession, d: str) -> DataFrame:
    """Open tasks of known scans: the newest of each scan is replayed, which sets the scan to pending; all are resolved."""
    return ev.replay(dead_letter_tasks(spark, d), analyses(spark, d)).select("event_id", "analysis_id", "was", "status", "replayed", "resolved")


def progress_heartbeats(spark: SparkSession, d: str) -> DataFrame:
    rows = service.heartbeats(keyed(spark, d), 1800.0)
    return rows.select("key", "event_id", F.round("at", 3).alias("at"))


def webhook_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Webhook bodies with a signature, wrong for every third one; those that stand the test."""
    body = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))
    claimed = F.concat(F.lit("sha256="), F.when(F.col("event_id") % 3 == 0, F.sha2(body, 256)).otherwise(service.hmac_sha256(body, SECRET)))
    rows = table(spark, d, "events").select("event_id", body.alias("body"), claimed.alias("signature"))
    return service.signed(rows, SECRET).select("event_id", "signature")


SECRET = b"example-key"
QUERIES = {f.__name__: f for f in (rate_limit_decisions, reset_throttle, in_flight_guard, webhook_outcomes, webhook_pulls, webhook_stream, keyed_appends, progress_throttle, monotone_counters, webhook_routing, dead_letter_replay, duplicate_scans, dead_letter_retry, progress_heartbeats, webhook_signatures)}
_HOOKS = """WITH h AS (SELECT event_id AS n, user_id, ts, CASE WHEN event_id % 5 = 4 THEN 'ping' WHEN event_id % 5 = 3 THEN 'issues' WHEN event_id % 2 = 0 THEN 'push' ELSE 'pull_request' END AS event FROM events),
o AS (SELECT h.*, c_custkey, CASE WHEN n % 13 = 0 THEN 'signature missing' WHEN n % 17 = 0 THEN 'signature mismatch' WHEN n % 11 = 0 THEN 'invalid body' WHEN event = 'ping' THEN 'pong'
  WHEN event = 'issues' OR (event = 'pull_request' AND n % 3 = 1) THEN 'ignored' WHEN n % 19 = 0 OR (event = 'pull_request' AND n % 50 = 0) THEN 'incomplete' WHEN c_custkey IS NULL THEN 'not connected'
  WHEN event = 'pull_request' THEN 'review' WHEN n % 4 <> 0 THEN 'scan' ELSE 'ignored' END AS outcome
  FROM h LEFT JOIN customer ON c_name = 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AND c_mktsegment <> 'MACHINERY')
"""
#: Events of a key in order, with seconds; and the same events of a pair of repository and commit.
ORDERED = "WITH RECURSIVE e AS (SELECT user_id % 40 AS key, epoch_us(ts) / 1e6 AS t, event_id, event_type = 'error' AS terminal, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS rn FROM events)"
_PADS = ["".join(f"\\x{b ^ x:02X}" for b in SECRET.ljust(64, b"\0")) for x in (0x36, 0x5C)]
ORACLE = {
    "rate_limit_decisions": ORDERED + """, r AS (SELECT key, rn, t, event_id, [t] AS held, true AS admitted FROM e WHERE rn = 1
UNION ALL SELECT key, rn, t, event_id, CASE WHEN len(f) < 3 THEN list_append(f, t) ELSE f END, len(f) < 3 FROM (SELECT e.key, e.rn, e.t, e.event_id, list_filter(r.held, lambda h: e.t - h < 3600.0) AS f FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1))
SELECT key, t AS "at", event_id, admitted FROM r""",
    "webhook_outcomes": _HOOKS + "SELECT CAST(n AS VARCHAR) AS delivery_id, event, outcome, CASE WHEN outcome IN ('review', 'scan') THEN c_custkey END AS repo_id FROM o",
    "webhook_stream": _HOOKS + "SELECT CAST(n AS VARCHAR) AS delivery_id, event, outcome, CASE WHEN outcome IN ('review', 'scan') THEN c_custkey END AS repo_id, CASE WHEN outcome IN ('review', 'scan') THEN 'pending' END AS status FROM o",
    "keyed_appends": sql(""" SELECT repo_id, arg_min(analysis_id, (analysis_id % 2, scanned_at, analysis_id)) AS analysis_id, CAST(min(analysis_id % 2) AS VARCHAR) AS batch FROM analyses GROUP BY repo_id"""),
    "webhook_pulls": _HOOKS + """SELECT c_custkey AS repo_id, n % 50 AS number, 'PR #' || (n % 50) AS title, 'u' || min(user_id) AS author, 'h' || arg_max(n, (ts, CAST(n AS VARCHAR))) AS head_sha, '' AS base_sha FROM o WHERE outcome = 'review' GROUP BY ALL""",
    "reset_throttle": """WITH RECURSIVE e AS (SELECT user_id % 40 % 4 AS key, epoch_us(ts) / 1e6 AS t, event_id, row_number() OVER (PARTITION BY user_id % 40 % 4 ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'click'),
r AS (SELECT key, rn, t, event_id, [t] AS held, true AS admitted FROM e WHERE rn = 1
UNION ALL SELECT key, rn, t, event_id, CASE WHEN len(f) < 3 THEN list_append(f, t) ELSE f END, len(f) < 3 FROM (SELECT e.key, e.rn, e.t, e.event_id, list_filter(r.held, lambda h: e.t - h < 900) AS f FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1))
SELECT key, t AS "at", event_id, admitted FROM r""",
    "in_flight_guard": """WITH RECURSIVE b AS (SELECT user_id % 40 AS repo, event_id % 3 AS c, epoch_us(ts) / 1e6 AS t, event_id AS scan, event_type <> 'error' AS good FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY repo, c ORDER BY t, ended DESC, scan) AS rn, count(*) OVER (PARTITION BY repo, c) AS n FROM (SELECT *, false AS ended FROM b UNION ALL SELECT repo, c, t + 600 + scan * 7919 % 9000, scan, good, true FROM b)),
r AS (SELECT repo, c, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS holder, CAST([] AS STRUCT(s BIGINT, t DOUBLE)[]) AS run, CAST([] AS STRUCT(s BIGINT, t DOUBLE)[]) AS wait, CAST([] AS STRUCT(s BIGINT, o VARCHAR, t DOUBLE, r BIGINT)[]) AS said FROM b GROUP BY repo, c
UNION ALL SELECT repo, c, rn,
  CASE WHEN ended THEN nullif(holder, scan) ELSE coalesce(holder, scan) END,
  CASE WHEN ended THEN list_filter(run, lambda x: x.s <> scan) WHEN holder IS NULL THEN list_append(run, {'s': scan, 't': t}) ELSE run END,
  CASE WHEN ended THEN CASE WHEN good AND runs THEN [] ELSE wait END WHEN holder IS NULL THEN wait ELSE list_append(wait, {'s': scan, 't': t + 3600}) END,
  list_concat(list_transform(due, lambda x: {'s': x.s, 'o': 'scans after waiting', 't': x.t, 'r': CAST(NULL AS BIGINT)}),
    CASE WHEN ended THEN CASE WHEN good AND runs THEN list_transform(wait, lambda x: {'s': x.s, 'o': 'reuses', 't': t, 'r': scan}) ELSE [] END
      WHEN holder IS NULL THEN [{'s': scan, 'o': 'scans', 't': t, 'r': CAST(NULL AS BIGINT)}] ELSE [] END,
    CASE WHEN rn < n THEN [] ELSE list_transform(CASE WHEN ended AND good AND runs THEN [] WHEN ended OR holder IS NULL THEN wait ELSE list_append(wait, {'s': scan, 't': t + 3600}) END, lambda x: {'s': x.s, 'o': 'scans after waiting', 't': x.t, 'r': CAST(NULL AS BIGINT)}) END)
  FROM (SELECT *, len(list_filter(run, lambda x: x.s = scan)) > 0 AS runs, CASE WHEN len(list_filter(run, lambda x: x.s = held)) > 0 THEN held END AS holder FROM (
    SELECT e.repo, e.c, e.rn, e.n, e.t, e.scan, e.good, e.ended, r.holder AS held, list_filter(r.wait, lambda x: x.t <= e.t) AS due, list_filter(r.wait, lambda x: x.t > e.t) AS wait,
      list_filter(list_concat(r.run, list_filter(r.wait, lambda x: x.t <= e.t)), lambda x: e.t - x.t < 7200) AS run FROM r JOIN e ON e.repo = r.repo AND e.c = r.c AND e.rn = r.rn + 1)))
SELECT repo, c AS "commit", x.s AS scan, x.o AS outcome, x.t AS "at", x.r AS result_of FROM (SELECT repo, c, unnest(said) AS x FROM r)""",
    "progress_throttle": ORDERED + """, r AS (SELECT key, rn, t, event_id, t AS last, true AS written FROM e WHERE rn = 1
UNION ALL SELECT e.key, e.rn, e.t, e.event_id, CASE WHEN e.terminal OR e.t - r.last >= 1800.0 THEN e.t ELSE r.last END, e.terminal OR e.t - r.last >= 1800.0 FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1)
SELECT key, t AS "at", event_id, written FROM r""",
    "duplicate_scans": """WITH RECURSIVE e AS (SELECT user_id % 40 AS repo, event_id % 3 AS c, epoch_us(ts) / 1e6 AS t, event_id, row_number() OVER (PARTITION BY user_id % 40, event_id % 3 ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT repo, c, rn, event_id, t AS last, true AS kept FROM e WHERE rn = 1 UNION ALL SELECT e.repo, e.c, e.rn, e.event_id, CASE WHEN e.t - r.last >= 7200 THEN e.t ELSE r.last END, e.t - r.last >= 7200 FROM r JOIN e ON e.repo = r.repo AND e.c = r.c AND e.rn = r.rn + 1)
SELECT repo, c AS commit, event_id FROM r WHERE kept""",
    "dead_letter_retry": sql(""", t AS (SELECT event_id, ts, event_id * 7 % 5000 AS analysis_id FROM events WHERE event_type = 'error' AND event_id % 4 <> 0)
SELECT event_id, analysis_id, a.status AS was, 'pending' AS status, row_number() OVER (PARTITION BY analysis_id ORDER BY ts DESC, event_id DESC) = 1 AS replayed, true AS resolved FROM t JOIN analyses a USING (analysis_id)"""),
    "progress_heartbeats": ORDERED.replace("WITH RECURSIVE", "WITH") + """, n AS (SELECT *, lead(t) OVER (PARTITION BY key ORDER BY t, event_id) AS nxt FROM e) SELECT key, event_id, round(t + 1800, 3) AS "at" FROM n WHERE NOT terminal AND (nxt IS NULL OR nxt - t > 1800)""",
    "webhook_signatures": f"""SELECT event_id, 'sha256=' || sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(event_type || ':' || event_id)))) AS signature FROM events WHERE event_id % 3 <> 0""",
    "monotone_counters": "SELECT user_id % 40 AS key, event_id, max(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS shown FROM events",
    "webhook_routing": """WITH h AS (SELECT event_id, 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS repo_name, CASE event_type WHEN 'click' THEN 'pull_request' WHEN 'view' THEN 'push' ELSE 'ping' END AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, repo_name, kind, CASE kind WHEN 'push' THEN 'scan' ELSE 'review' END AS starts FROM h JOIN customer ON c_name = repo_name WHERE c_mktsegment <> 'MACHINERY' AND ((kind = 'pull_request' AND k % 3 IN (0, 2)) OR (kind = 'push' AND k % 2 = 0))""",
    "dead_letter_replay": "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_id FROM events WHERE event_type = 'error' GROUP BY 1",
}

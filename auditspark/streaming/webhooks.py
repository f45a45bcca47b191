"""Webhook deliveries: what each starts, as a batch rule and as a stream into routed tables.

A delivery (delivery_id, event, signature, body, received) has one outcome: it starts a review or a scan of a connected
repository, or is refused, ignored or incomplete. ``outcomes`` is the rule; ``Receiver.start`` runs it on a stream of
files of JSON lines. Repositories are read anew for each batch, so one that is connected meanwhile counts from the next
batch on. The outcomes of a batch are stored first, under the batch's name, and the tables of reviews, scans and pull
requests are made of what is stored: a batch that comes again after a crash finds its outcomes and adds what is missing,
and a delivery that is sent again, in the same batch or another, starts nothing more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditspark.operators.service import hmac_sha256
from auditspark.sources.keyed_table import KeyedTable

DELIVERY = "delivery_id string, event string, signature string, body string, received timestamp"
PAYLOAD = (
    "action string, ref string, repository struct<full_name: string>, "
    "pull_request struct<number: long, title: string, user: struct<login: string>, head: struct<sha: string>, base: struct<sha: string>>"
)
OUTCOME = "delivery_id string, event string, outcome string, repo_name string, repo_id long, number long, title string, author string, head_sha string, base_sha string, received timestamp"
#: Actions that start a review.
ACTIONS = ("opened", "synchronize", "reopened")


def outcomes(deliveries: DataFrame, repositories: DataFrame, secret: bytes | None) -> DataFrame:
    """OUTCOME of each delivery. ``repositories``: repo_id, name, default_branch, is_connected (null counts as connected).

    Without a secret no signature is asked for. Tests come in the service's order: signature, body, event, contents,
    repository, branch. An empty body is an empty object."""
    body = F.when(F.coalesce("body", F.lit("")) == "", "{}").otherwise(F.col("body"))
    parsed = deliveries.withColumn("_j", F.from_json(body, PAYLOAD)).withColumn("_valid", F.try_parse_json(body).isNotNull())
    parsed = parsed.withColumn("repo_name", F.col("_j.repository.full_name")).withColumn("number", F.col("_j.pull_request.number"))
    known = repositories.where(F.coalesce("is_connected", F.lit(True))).groupBy(F.col("name").alias("repo_name")).agg(F.min(F.struct("repo_id", "default_branch")).alias("_repo"))
    joined = parsed.join(known, "repo_name", "left").withColumn("repo_id", F.col("_repo.repo_id"))
    review, push = F.col("event") == "pull_request", F.col("event") == "push"
    outcome = F.when(F.lit(False), "")
    if secret is not None:
        fits = F.col("signature") == F.concat(F.lit("sha256="), hmac_sha256(F.coalesce("body", F.lit("")), secret))
        outcome = F.when(F.coalesce("signature", F.lit("")) == "", "signature missing").when(~fits, "signature mismatch")
    lacks = F.coalesce("repo_name", F.lit("")) == ""
    outcome = outcome.when(~F.col("_valid"), "invalid body").when(F.col("event") == "ping", "pong")
    outcome = outcome.when(~(review | push) | F.col("event").isNull(), "ignored").when(review & ~F.coalesce(F.col("_j.action").isin(*ACTIONS), F.lit(False)), "ignored")
    outcome = outcome.when(lacks | (review & (F.coalesce("number", F.lit(0)) == 0)) | (push & (F.coalesce("_j.ref", F.lit("")) == "")), "incomplete")
    outcome = outcome.when(F.col("repo_id").isNull(), "not connected").when(review, "review")
    outcome = outcome.when(F.col("_j.ref") == F.concat(F.lit("refs/heads/"), "_repo.default_branch"), "scan").otherwise("ignored")
    title = F.coalesce("_j.pull_request.title", F.concat(F.lit("PR #"), F.col("number").cast("string")))
    return joined.select(
        "delivery_id", "event", outcome.alias("outcome"), "repo_name", "repo_id", "number", title.alias("title"),
        F.when(F.col("_j.pull_request").isNotNull(), F.coalesce("_j.pull_request.user.login", F.lit("unknown"))).alias("author"),
        F.col("_j.pull_request.head.sha").alias("head_sha"), F.col("_j.pull_request.base.sha").alias("base_sha"), "received",
    )


def newest_pulls(changes: DataFrame) -> DataFrame:
    """repo_id, number, title, author, head_sha, base_sha: each pull request as first seen, with its last known commits."""
    place = F.struct("received", "delivery_id")
    sha = [F.coalesce(F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", place)), F.lit("")).alias(c) for c in ("head_sha", "base_sha")]
    return changes.groupBy("repo_id", "number").agg(F.min_by("title", place).alias("title"), F.min_by("author", place).alias("author"), *sha)


class Receiver:
    """The tables below ``path`` that deliveries are routed to."""

    def __init__(self, spark: SparkSession, path: str, repositories: Callable[[], DataFrame], secret: bytes | None) -> None:
        self.repositories, self.secret, order = repositories, secret, ["received", "event"]
        self.deliveries = KeyedTable(spark, f"{path}/deliveries", OUTCOME, ["delivery_id"], order)
        self.analyses = KeyedTable(spark, f"{path}/analyses", "delivery_id string, repo_id long, kind string, number long, status string", ["delivery_id"])
        self.pulls = KeyedTable(spark, f"{path}/pull_requests", "delivery_id string, repo_id long, number long, title string, author string, head_sha string, base_sha string, received timestamp", ["delivery_id"])

    def receive(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        self.deliveries.append(outcomes(batch, self.repositories(), self.secret), batch_id)
        own = self.deliveries.read().where(F.col("batch") == str(batch_id))
        started = own.where(F.col("outcome").isin("review", "scan"))
        pull = F.when(F.col("outcome") == "review", F.col("number")).alias("number")
        self.analyses.append(started.select("delivery_id", "repo_id", F.col("outcome").alias("kind"), pull, F.lit("pending").alias("status")), batch_id)
        self.pulls.append(own.where(F.col("outcome") == "review").select(*self.pulls.schema.names), batch_id)

    def pull_requests(self) -> DataFrame:
        return newest_pulls(self.pulls.read())

    def start(self, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Receive the deliveries that come into ``folder`` as files of JSON lines."""
        source = self.deliveries.spark.readStream.schema(DELIVERY).json(folder)
        return source.writeStream.foreachBatch(self.receive).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

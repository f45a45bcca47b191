"""Webhook deliveries as a stream: routed, each once, through crashes and changes of the repositories."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import json

import pytest

from auditspark.streaming import webhooks

SECRET = b"some secret"
START = datetime.datetime(2024, 1, 1)


def sign(body):
    return "sha256=" + hmac.new(SECRET, body.encode(), hashlib.sha256).hexdigest()


def push(repo, branch="main"):
    return {"ref": f"refs/heads/{branch}", "repository": {"full_name": repo}, "head_commit": {"id": "x"}}


def pull(repo, number, action="opened", head="h1", **more):
    return {"action": action, "repository": {"full_name": repo}, "pull_request": {"number": number, "head": {"sha": head}, "base": {"sha": "b"}, **more}}


def delivery(i, event, payload, signature=None, body=None):
    body = json.dumps(payload) if body is None else body
    return {"delivery_id": str(i), "event": event, "signature": sign(body) if signature is None else signature, "body": body, "received": (START + datetime.timedelta(seconds=i)).isoformat() + "Z"}


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.fixture
def repos(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "repo_id long, name string, default_branch string, is_connected boolean").write.mode("overwrite").parquet(str(tmp_path / "repos"))

    write([(1, "o/a", "main", True), (2, "o/b", "dev", None), (3, "o/off", "main", False)])
    return write


def receiver(spark, tmp_path, secret=SECRET):
    return webhooks.Receiver(spark, str(tmp_path / "tables"), lambda: spark.read.parquet(str(tmp_path / "repos")), secret)


def run(receiver, tmp_path):
    query = receiver.start(str(tmp_path / "in"), str(tmp_path / "ck"))
    query.awaitTermination(180)
    return query


def outcome(receiver):
    return {r["delivery_id"]: r["outcome"] for r in receiver.deliveries.read().collect()}


def test_outcomes(spark, tmp_path, repos):
    rows = [
        delivery(1, "ping", {}), delivery(2, "push", push("o/a")), delivery(3, "push", push("o/a", "other")), delivery(4, "push", push("o/b", "dev")), delivery(5, "push", push("o/off")),
        delivery(6, "pull_request", pull("o/a", 7)), delivery(7, "pull_request", pull("o/a", 7, "closed")), delivery(8, "pull_request", pull("o/none", 7)), delivery(9, "pull_request", pull("o/a", None)),
        delivery(10, "push", push(None)), delivery(11, "issues", {}), delivery(12, "push", None, body="{no json"), delivery(13, "push", push("o/a"), signature="sha256=00"), delivery(14, "push", push("o/a"), signature=""),
        delivery(15, "ping", None, body=""), delivery(16, "push", [1, 2]), delivery(17, "pull_request", {"action": "opened"}),
    ]
    put(tmp_path / "in", "1.json", rows)
    own = receiver(spark, tmp_path)
    run(own, tmp_path)
    assert outcome(own) == {
        "1": "pong", "2": "scan", "3": "ignored", "4": "scan", "5": "not connected", "6": "review", "7": "ignored", "8": "not connected", "9": "incomplete", "10": "incomplete", "11": "ignored",
        "12": "invalid body", "13": "signature mismatch", "14": "signature missing", "15": "pong", "16": "incomplete", "17": "incomplete",
    }
    assert sorted((r["delivery_id"], r["repo_id"], r["kind"], r["number"], r["status"]) for r in own.analyses.read().collect()) == [("2", 1, "scan", None, "pending"), ("4", 2, "scan", None, "pending"), ("6", 1, "review", 7, "pending")]
    (made,) = own.pull_requests().collect()
    assert (made["repo_id"], made["number"], made["title"], made["author"], made["head_sha"], made["base_sha"]) == (1, 7, "PR #7", "unknown", "h1", "b")


def test_crash_in_mid_batch_starts_no_second_scan(spark, tmp_path, repos):
    put(tmp_path / "in", "1.json", [delivery(1, "push", push("o/a")), delivery(2, "pull_request", pull("o/b", 3))])
    own = receiver(spark, tmp_path)
    kept = own.pulls.append
    own.pulls.append = lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
    query = own.start(str(tmp_path / "in"), str(tmp_path / "ck"))
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination(180)
    assert own.analyses.read().count() == 2 and own.pulls.read().count() == 0
    own.pulls.append = kept
    repos([])  # even with other repositories meanwhile, the batch stays what it was
    run(own, tmp_path)
    assert own.analyses.read().count() == 2 and own.pulls.read().count() == 1 and outcome(own) == {"1": "scan", "2": "review"}
    run(own, tmp_path)
    assert own.analyses.read().count() == 2


def test_repositories_change_between_batches(spark, tmp_path, repos):
    own = receiver(spark, tmp_path)
    put(tmp_path / "in", "1.json", [delivery(1, "push", push("o/new")), delivery(2, "pull_request", pull("o/a", 5, head="h1", title="T", user={"login": "me"}))])
    run(own, tmp_path)
    repos([(1, "o/a", "main", True), (9, "o/new", "main", True)])
    again = [delivery(2, "pull_request", pull("o/a", 5, head="h1")), delivery(3, "push", push("o/new")), delivery(4, "pull_request", pull("o/a", 5, "synchronize", "h2", title="U")), delivery(4, "pull_request", pull("o/a", 5, "synchronize", "h2", title="U"))]
    put(tmp_path / "in", "2.json", again)
    run(own, tmp_path)
    assert outcome(own) == {"1": "not connected", "2": "review", "3": "scan", "4": "review"}
    assert sorted(r["delivery_id"] for r in own.analyses.read().collect()) == ["2", "3", "4"]
    (made,) = own.pull_requests().collect()
    assert (made["title"], made["author"], made["head_sha"]) == ("T", "me", "h2")


def test_without_a_secret(spark, tmp_path, repos):
    put(tmp_path / "in", "1.json", [delivery(1, "push", push("o/a"), signature="")])
    own = receiver(spark, tmp_path, None)
    run(own, tmp_path)
    assert outcome(own) == {"1": "scan"}

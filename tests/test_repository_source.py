"""Repositories as a data source: git and folders, pushed filters, the cache."""

from __future__ import annotations

import os
import subprocess

import pytest

from auditspark.operators import tree
from auditspark.sources import repository

FILES = {
    "a": {"src/main.py": "print(1)\n" * 30, "src/util.py": "x = 1\n", "src/blank.py": "\n \n", "README.md": "# a\n", "node_modules/x.js": "1;\n", "big.py": "y = 2\n" * 200, "odd name é.py": "é = 'ü'\n"},
    "b": {"lib/one.go": "package lib\n", "package.json": "{}\n"},
    "c": {"only.txt": "text"},
}


def git(folder, *args):
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_AUTHOR_NAME": "n", "GIT_AUTHOR_EMAIL": "e@x", "GIT_COMMITTER_NAME": "n", "GIT_COMMITTER_EMAIL": "e@x"}
    return subprocess.run(["git", "-C", str(folder), *args], check=True, capture_output=True, env=env).stdout.decode().strip()


@pytest.fixture(params=["git", "folder"])
def root(request, tmp_path):
    top = tmp_path / "repos"
    for repo, files in FILES.items():
        for path, content in files.items():
            (top / repo / path).parent.mkdir(parents=True, exist_ok=True)
            (top / repo / path).write_text(content)
        if request.param == "git":
            git(top / repo, "init", "-q", "-b", "main")
            git(top / repo, "add", "-A", "-f")
            git(top / repo, "commit", "-q", "-m", "first")
    (top / "loose.txt").write_text("no repository")
    return request.param, top


def reader(spark, host, cache=None, **options):
    repository.register(spark)
    made = spark.read.format("repository").option("host", host).options(**options)
    return made.option("cache", f"file://{cache}") if cache else made


def test_all_files(spark, root):
    host, top = root
    found = reader(spark, host).load(str(top)).collect()
    assert {(r["repo"], r["path"]): r["content"] for r in found} == {(k, p): c for k, own in FILES.items() for p, c in own.items()}
    assert all(r["size"] == len(r["content"].encode()) and r["fetched"] and len(r["commit"]) in (40, 64) for r in found)
    assert len({r["commit"] for r in found}) == 3


def test_partitions_and_pushed_filters(spark, root, tmp_path):
    host, top = root
    df = reader(spark, host, tmp_path / "cache").load(str(top))
    assert df.rdd.getNumPartitions() == 3
    assert df.where("repo = 'a'").rdd.getNumPartitions() == 1
    kept = df.where("repo IN ('a', 'b') AND size < 500 AND path LIKE 'src/%' AND path LIKE '%.py' AND NOT path LIKE '%blank%' AND upper(path) <> 'SRC/OTHER.PY'")
    assert [(r["repo"], r["path"]) for r in kept.orderBy("path").collect()] == [("a", "src/main.py"), ("a", "src/util.py")]
    # the contents that were read are those of the filters on path and size, not all
    again = reader(spark, host, tmp_path / "cache").load(str(top)).where("repo = 'a'").collect()
    assert {r["path"] for r in again if not r["fetched"]} == {"src/main.py", "src/util.py"}


def test_listing_only(spark, root):
    host, top = root
    found = reader(spark, host, content="false").load(str(top)).collect()
    assert len(found) == 10 and all(r["content"] is None and not r["fetched"] for r in found)
    some = reader(spark, host, mostBytes="300").load(str(top)).collect()
    assert {r["path"] for r in some if r["content"] is None} == {"big.py"}


def test_second_read_fetches_nothing(spark, root, tmp_path):
    host, top = root
    cache = f"file://{tmp_path}/cache"
    first = repository.fetch_sources(spark, str(top), host, cache=cache).collect()
    assert {(r["repo"], r["path"]) for r in first} == {("a", "src/main.py"), ("a", "src/util.py"), ("a", "big.py"), ("a", "odd name é.py"), ("b", "lib/one.go")}
    assert all(r["fetched"] for r in first)
    second = repository.fetch_sources(spark, str(top), host, cache=cache).collect()
    assert not any(r["fetched"] for r in second)
    assert sorted((r["repo"], r["path"], r["lines"]) for r in second) == sorted((r["repo"], r["path"], r["lines"]) for r in first)


def test_new_commit_is_fetched(spark, root, tmp_path):
    host, top = root
    cache = f"file://{tmp_path}/cache"
    first = {r["path"]: r for r in repository.fetch_sources(spark, str(top), host, cache=cache).where("repo = 'a'").collect()}
    (top / "a/src/util.py").write_text("x = 22\n")
    if host == "git":
        git(top / "a", "commit", "-q", "-a", "-m", "second")
    second = {r["path"]: r for r in repository.fetch_sources(spark, str(top), host, cache=cache).where("repo = 'a'").collect()}
    assert second["src/util.py"]["lines"] == ["x = 22"] and second["src/util.py"]["fetched"]
    assert second["src/util.py"]["commit"] != first["src/util.py"]["commit"]
    if host == "git":  # the first commit by its id needs the host no more
        old = first["src/util.py"]["commit"]
        for path in (top / "a/.git/objects").rglob("*"):
            if path.is_file():
                path.chmod(0o600)
                path.write_bytes(b"")
        kept = reader(spark, host, tmp_path / "cache", ref=old).load(str(top)).where("repo = 'a' AND path = 'src/util.py'").collect()
        assert [(r["content"], r["fetched"]) for r in kept] == [("x = 1\n", False)]


def test_budget(spark, root):
    """The smallest sources are fetched first; a blank one uses up a fetch; long ones are cut."""
    host, top = root
    own = repository.fetch_sources(spark, str(top), host, most_files=3, most_lines=2).where("repo = 'a'").collect()
    assert {r["path"]: r["lines"] for r in own} == {"src/util.py": ["x = 1"], "odd name é.py": ["é = 'ü'"]}
    assert {r["path"] for r in repository.fetch_sources(spark, str(top), host, most_bytes=100).where("repo = 'a'").collect()} == {"src/util.py", "odd name é.py"}


def test_feeds_the_operators(spark, root):
    host, top = root
    df = reader(spark, host).load(str(top))
    assert {r["path"] for r in tree.fetched_sources(df).where("repo = 'a'").collect()} == {"src/main.py", "src/util.py", "big.py", "odd name é.py"}
    assert {(r["repo"], r["ecosystem"]) for r in tree.manifests(df).collect()} == {("b", "npm")}


def test_no_repositories(spark, tmp_path):
    assert reader(spark, "folder").load(str(tmp_path)).collect() == []

"""Repositories as a Spark data source: trees and contents of pinned commits, with a content cache.

``spark.read.format("repository").load(root)`` has a row (repo, ref, commit, path, size, blob, content, fetched) for each
file of each repository below ``root``, one partition a repository. Filters on repo, path and size are applied to the
listing, before any content is read. Options: ``host`` (``git``: repositories of git, work trees or bare; ``folder``:
plain directories, whose commit is a digest of their listing), ``ref`` (a branch, tag or commit; HEAD), ``content``
(false: listings only), ``cache`` (a URI that all executors reach), ``mostBytes`` (larger files have no content).

The cache holds, for each repository and commit, its listing and packs of contents by path. A pack is written under a
name of its own and never changed, so tasks that run twice or at once do no harm; what is in it is not fetched again,
by any session. ``fetched`` tells what came from the host. A branch is resolved by the host at each read; a read of a
commit by its full id asks the host for nothing that the cache has.

``fetch_sources`` is the service's way: listing, choice of the smallest sources by Spark, and contents of these only.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import subprocess
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, datasource
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from auditspark.functions import text
from auditspark.operators import tree

SCHEMA = "repo string, ref string, commit string, path string, size long, blob string, content string, fetched boolean"
CONTENTS = "repo string, commit string, path string, size long, content string, fetched boolean"
#: Files whose contents are read and packed together.
CHUNK = 64
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Entry(NamedTuple):
    path: str
    size: int
    blob: str


class GitHost:
    """Repositories of git below a folder, read by the git program."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _git(self, repo: str, *args: str, given: bytes | None = None) -> bytes:
        folder = os.path.join(self.root, repo)
        return subprocess.run(["git", "-c", f"safe.directory={os.path.abspath(folder)}", "-C", folder, *args], input=given, capture_output=True, check=True).stdout

    def repos(self) -> list[str]:
        marks = (".git", "HEAD")
        return sorted(n for n in os.listdir(self.root) if any(os.path.exists(os.path.join(self.root, n, m)) for m in marks))

    def commit(self, repo: str, ref: str) -> str:
        return self._git(repo, "rev-parse", "--verify", "--end-of-options", ref + "^{commit}").decode().strip()

    def tree(self, repo: str, commit: str) -> list[Entry]:
        rows = self._git(repo, "ls-tree", "-r", "-l", "-z", commit).decode("utf-8", "replace").split("\0")
        found = [re.fullmatch(r"\d+ blob (\w+) +(\d+)\t(.*)", r, re.DOTALL) for r in rows]
        return [Entry(m[3], int(m[2]), m[1]) for m in found if m]

    def contents(self, repo: str, commit: str, entries: list[Entry]) -> Iterator[bytes]:
        out = io.BytesIO(self._git(repo, "cat-file", "--batch", given="".join(e.blob + "\n" for e in entries).encode()))
        for _ in entries:
            size = int(out.readline().split()[2])
            yield out.read(size)
            out.read(1)


class FolderHost:
    """Plain directories below a folder; a commit is a digest of paths, sizes and times."""

    def __init__(self, root: str) -> None:
        self.root = root

    def repos(self) -> list[str]:
        return sorted(e.name for e in os.scandir(self.root) if e.is_dir())

    def _files(self, repo: str) -> list[tuple[str, os.stat_result]]:
        top = os.path.join(self.root, repo)
        names = sorted(os.path.join(d, n) for d, _, own in os.walk(top) for n in own)
        return [(os.path.relpath(n, top), os.stat(n)) for n in names if os.path.isfile(n)]

    def commit(self, repo: str, ref: str) -> str:
        digest = hashlib.sha256(repr([(p, s.st_size, s.st_mtime_ns) for p, s in self._files(repo)]).encode()).hexdigest()
        if re.fullmatch("[0-9a-f]{64}", ref) and ref != digest:
            raise ValueError(f"{repo} is not at {ref} any more")
        return digest

    def tree(self, repo: str, commit: str) -> list[Entry]:
        return [Entry(p, s.st_size, p) for p, s in self._files(repo)]

    def contents(self, repo: str, commit: str, entries: list[Entry]) -> Iterator[bytes]:
        for e in entries:
            with open(os.path.join(self.root, repo, e.path), "rb") as file:
                yield file.read()


HOSTS = {"git": GitHost, "folder": FolderHost}
_TREE = pa.schema([("path", pa.string()), ("size", pa.int64()), ("blob", pa.string())])
_PACK = pa.schema([("path", pa.string()), ("content", pa.binary())])


class Contents:
    """Listings and contents of commits, from the cache where it has them and from the host where not."""

    def __init__(self, root: str, host: str = "git", cache: str | None = None) -> None:
        self.host = HOSTS[host](root)
        self.files, self.base = fs.FileSystem.from_uri(cache) if cache else (None, "")

    def _place(self, repo: str, commit: str) -> str:
        return f"{self.base}/{quote(repo, safe='')}/{commit}"

    def _known(self, repo: str, commit: str) -> list[str]:
        if self.files is None:
            return []
        return sorted(f.path for f in self.files.get_file_info(fs.FileSelector(self._place(repo, commit), allow_not_found=True)) if f.path.endswith(".parquet"))

    def _write(self, table: pa.Table, repo: str, commit: str, name: str) -> None:
        """First under a name that no reader asks for, then moved."""
        place = self._place(repo, commit)
        self.files.create_dir(place, recursive=True)
        pq.write_table(table, f"{place}/{name}.writing", filesystem=self.files, compression="zstd")
        self.files.move(f"{place}/{name}.writing", f"{place}/{name}.parquet")

    def tree(self, repo: str, ref: str) -> tuple[str, list[Entry]]:
        """The commit that ``ref`` names, and its listing."""
        full = re.fullmatch("[0-9a-f]{40}|[0-9a-f]{64}", ref)
        commit = ref if full and self._known(repo, ref) else self.host.commit(repo, ref)
        for path in self._known(repo, commit):
            if os.path.basename(path).startswith("tree-"):
                return commit, [Entry(*r.values()) for r in pq.read_table(path, filesystem=self.files, schema=_TREE).to_pylist()]
        entries = self.host.tree(repo, commit)
        if self.files is not None:
            self._write(pa.Table.from_pylist([e._asdict() for e in entries], _TREE), repo, commit, f"tree-{uuid.uuid4().hex}")
        return commit, entries

    def read(self, repo: str, commit: str, entries: list[Entry]) -> Iterator[tuple[Entry, bytes, bool]]:
        """The entries with their contents, and whether the host was asked for them."""
        packs = [p for p in self._known(repo, commit) if os.path.basename(p).startswith("pack-")]
        for at in range(0, len(entries), CHUNK):
            some = entries[at : at + CHUNK]
            paths, have = [e.path for e in some], {}
            for pack in packs:
                for row in pq.read_table(pack, filesystem=self.files, schema=_PACK, filters=[("path", "in", paths)]).to_pylist():
                    have[row["path"]] = row["content"]
            missing = [e for e in some if e.path not in have]
            new = dict(zip((e.path for e in missing), self.host.contents(repo, commit, missing))) if missing else {}
            if new and self.files is not None:
                self._write(pa.Table.from_pylist([{"path": p, "content": c} for p, c in new.items()], _PACK), repo, commit, f"pack-{uuid.uuid4().hex}")
            for e in some:
                yield e, new[e.path] if e.path in new else have[e.path], e.path in new


_COMPARED = {
    "EqualTo": lambda a, b: a == b, "EqualNullSafe": lambda a, b: a == b, "In": lambda a, b: a in b, "GreaterThan": lambda a, b: a > b, "LessThan": lambda a, b: a < b,
    "GreaterThanOrEqual": lambda a, b: a >= b, "LessThanOrEqual": lambda a, b: a <= b, "StringStartsWith": lambda a, b: a.startswith(b), "StringEndsWith": lambda a, b: a.endswith(b),
    "StringContains": lambda a, b: b in a, "IsNotNull": lambda a, b: True,
}


def pushable(f: Filter) -> bool:
    if isinstance(f, datasource.Not):
        return type(f.child).__name__ not in ("IsNotNull", "EqualNullSafe") and pushable(f.child)
    return type(f).__name__ in _COMPARED and f.attribute in (("repo",), ("path",), ("size",)) and getattr(f, "value", 0) is not None


def passes(f: Filter, row: dict) -> bool:
    if isinstance(f, datasource.Not):
        return not passes(f.child, row)
    return f.attribute[0] not in row or _COMPARED[type(f).__name__](row[f.attribute[0]], getattr(f, "value", None))


class Repository(InputPartition):
    def __init__(self, repo: str) -> None:
        super().__init__(repo)
        self.repo = repo


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.filters: list[Filter] = []

    def _contents(self) -> Contents:
        return Contents(self.options["path"], self.options.get("host", "git"), self.options.get("cache"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Repository]:
        named = [f for f in self.filters if not isinstance(f, datasource.Not) and f.attribute == ("repo",)]
        return [Repository(r) for r in self._contents().host.repos() if all(passes(f, {"repo": r}) for f in named)]

    def read(self, partition: Repository | None) -> Iterator[tuple]:
        if partition is None:  # no repository at all
            return
        repo, ref = partition.repo, self.options.get("ref", "HEAD")
        source, most = self._contents(), int(self.options.get("mostbytes", 1 << 62))
        commit, entries = source.tree(repo, ref)
        own = [e for e in entries if all(passes(f, {"repo": repo, "path": e.path, "size": e.size}) for f in self.filters)]
        wanted = [e for e in own if e.size <= most] if self.options.get("content", "true").lower() == "true" else []
        for e, content, fetched in source.read(repo, commit, wanted):
            yield repo, ref, commit, e.path, e.size, e.blob, content.decode("utf-8", "replace"), fetched
        listed = set(wanted)
        for e in own:
            if e not in listed:
                yield repo, ref, commit, e.path, e.size, e.blob, None, False


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> RepositoryReader:
        return RepositoryReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed into it."""
    spark.dataSource.register(RepositorySource)
    spark.conf.set(PUSHDOWN, "true")


def fetch_contents(chosen: DataFrame, root: str, host: str = "git", cache: str | None = None) -> DataFrame:
    """The rows (repo, commit, path, size, blob) with their contents. A repository's rows are read together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Contents(root, host, cache)
        for batch in batches:
            groups: dict[tuple[str, str], list[Entry]] = {}
            for r in batch.to_pylist():
                groups.setdefault((r["repo"], r["commit"]), []).append(Entry(r["path"], r["size"], r["blob"]))
            for (repo, commit), entries in groups.items():
                rows = [{"repo": repo, "commit": commit, "path": e.path, "size": e.size, "content": c.decode("utf-8", "replace"), "fetched": new} for e, c, new in source.read(repo, commit, entries)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("repo", pa.string()), ("commit", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.string()), ("fetched", pa.bool_())]))

    by_repo = chosen.select("repo", "commit", "path", "size", "blob").repartition("repo").sortWithinPartitions("repo", "commit", "size", "path")
    return by_repo.mapInArrow(run, CONTENTS)


def fetch_sources(spark: SparkSession, root: str, host: str = "git", ref: str = "HEAD", cache: str | None = None, most_files: int = tree.MOST_FILES, most_bytes: int = tree.MOST_BYTES, most_lines: int = tree.MOST_LINES) -> DataFrame:
    """repo, commit, path, lines, fetched of the sources of each repository: of those not ignored and not too large the
    smallest, as many as the budget of fetches allows; blank ones use it up but have no row."""
    register(spark)
    reader = spark.read.format("repository").option("host", host).option("ref", ref).option("content", False)
    listing = (reader.option("cache", cache) if cache else reader).load(root)
    chosen = tree.source_paths(listing.where(F.col("size") <= most_bytes)).where(F.col("place") <= most_files)
    lines = F.slice(text.split_lines(F.col("content")), 1, most_lines)
    rows = fetch_contents(chosen, root, host, cache).withColumn("lines", lines)
    return rows.where(F.exists("lines", lambda x: text.strip(x) != "")).select("repo", "commit", "path", "lines", "fetched")

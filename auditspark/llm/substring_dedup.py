r"""Duplicate substrings of at least 50 bytes across documents, by distributed prefix doubling.

Names of strings of 1, 2, 4, ... bytes are made by pairing each position's name with the name at the doubled offset; as
only equality matters, a name is a 64-bit hash instead of an order-preserving rank. Spark sorts and compares names at
two lengths, and a position drops out as soon as it is known to be unique or settled:

(1) 20 bytes. Each 50-byte window is named by the least 20-byte name among its positions; windows in a row that share
    it form a run, about one for 16 bytes, and only runs are sent. A run's content is named too. If all runs of the
    corpus that have a 20-byte name have one content, then the least document that holds it settles all their windows.
    Where contents differ, runs whose content a smaller document has are settled too: all their windows go, and that
    document speaks for them.
(2) 50 bytes. Windows of the remaining runs, those in the least documents of each content, are ranked by their full names:
    the least document for each is found. A full name has 96 bits: 64 of the window and 32 of its seed, made of other
    bytes of it. A run's content has 64 bits beside the 64 of its seed, so only runs of one seed can be taken for each
    other.

A window is removed where a smaller document has it. Texts lie in a table bucketed by block of documents and are not
moved again; what moves are packed, distinct names of each block, a name once a block, so a passage that stands in a
third of all documents meets in one entry for each block. Every byte position of every text takes part.

Defined results: null and empty text has no bytes; rows with equal ids do not remove from each other; a row without an
id is kept whole and removes nothing; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import bucketed, mix64, planes, raw_text, slices, stored, table, text_bytes, unplanes

LEAST = 50
SEED = 20
SPREAD = LEAST - SEED + 1
BLOCK_BYTES = 1 << 22
#: Windows that are named at a time; names that one partition takes, about.
PIECE, PART_KEYS = 1 << 20, 1 << 20
#: Bytes that go with a name: of a run's content beside its seed, and of its seed beside a whole window.
WIDTHS = {1: 8, 2: 4}
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_STEP = 0xD6E8FEB86659FD93
BLOCK = "block long, doc_id long, text binary"
SENT = "part int, block long, n long, keys binary, content binary, docs binary"
BACK = "block long, level int, part int, status binary"
KEPT = "doc_id long, n_bytes long, spans array<long>, kept binary"


def names(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all 20-byte and all 50-byte strings, from names at offsets 1, 2, 4, 8, 16, 32."""
    by = {1: _BYTES[raw]}
    for k in (1, 2, 4, 8, 16):
        by[2 * k] = by[k][:-k] + by[k][k:] * np.uint64(pow(_STEP, k, 1 << 64))
    n = len(raw)
    seed = by[16][: n - SEED + 1] + by[4][16 : 16 + n - SEED + 1] * np.uint64(pow(_STEP, 16, 1 << 64))
    m = n - LEAST + 1
    full = by[32][:m] + by[16][32 : 32 + m] * np.uint64(pow(_STEP, 32, 1 << 64)) + by[2][48 : 48 + m] * np.uint64(pow(_STEP, 48, 1 << 64))
    return mix64(seed), mix64(full)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, k = len(x) - width + 1, 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[:n], x[width - k : width - k + n])


@dataclass
class Runs:
    """Windows of a block's documents in runs of one seed. ``row`` and ``at`` place each run's first window."""

    row: np.ndarray
    at: np.ndarray
    size: np.ndarray
    seed: np.ndarray
    content: np.ndarray
    full: np.ndarray  # names of all windows, run after run


def runs_of(texts: list[bytes], skip: list[bool]) -> Runs:
    out: list[tuple] = []
    todo = [(i, a) for i, t in enumerate(texts) if not skip[i] for a in range(0, len(t) - LEAST + 1, PIECE)]
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        starts = np.cumsum([0, *(len(p) for _, _, p in group)])
        raw = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        seed, full = names(raw)
        seed = least_of(seed, SPREAD)
        windows = np.diff(starts) - LEAST + 1
        inside = np.repeat(starts[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        seed, full = mix64(seed[inside]), full[inside]
        row = np.repeat([i for i, _, _ in group], windows)
        at = np.repeat([a for _, a, _ in group], windows) + inside - np.repeat(starts[:-1], windows)
        fresh = np.concatenate([[True], (seed[1:] != seed[:-1]) | (inside[1:] != inside[:-1] + 1)])
        first = np.flatnonzero(fresh)
        since = np.arange(len(seed)) - np.repeat(first, np.diff(np.append(first, len(seed))))
        first = np.flatnonzero(since % SPREAD == 0)
        last = np.append(first[1:], len(seed)) - 1
        length = last - first + 1
        content = mix64(full[first] + full[last] * np.uint64(_STEP) + length.astype(np.uint64)) | np.uint64(1)
        out.append((row[first], at[first], length, seed[first], content, full))

    for i, a in todo:
        piece = texts[i][a : a + PIECE + LEAST - 1]
        group.append((i, a, piece))
        size += len(piece)
        if size >= PIECE:
            flush()
            group, size = [], 0
    if group:
        flush()
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    return Runs(*(np.concatenate(x) for x in zip(*out))) if out else Runs(*empty)


def make_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches):
            number = []
            for n in batch.column(1).to_pylist():
                if size and size + n > block_bytes:
                    block, size = block + 1, 0
                size += n
                number.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), batch.column(0), batch.column(2)], names=["block", "doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text()).select("doc_id", F.length("text").cast("long").alias("n"), "text").mapInArrow(run, BLOCK)


def part_bounds(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)


def cuts(keys: np.ndarray, parts: int) -> list[int]:
    """Where each part begins among sorted keys."""
    return [0, *np.searchsorted(keys, part_bounds(parts)).tolist(), len(keys)]


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys as steps from each to the next: many leading zero bytes, which compress away."""
    return planes(np.concatenate([keys[:1], keys[1:] - keys[:-1]]), "<u8")


class Block:
    """The documents of a block, their runs, and the distinct names that the block sends on either level."""

    def __init__(self, group: pa.Table) -> None:
        self.ids, self.texts = group["doc_id"].to_pylist(), group["text"].to_pylist()
        self.name = group["block"][0].as_py()
        self.runs = runs_of(self.texts, [i is None for i in self.ids])
        self.id = np.array([i or 0 for i in self.ids], np.int64)[self.runs.row]
        order = np.argsort(self.runs.seed, kind="stable")
        key, content = self.runs.seed[order], self.runs.content[order]
        same = key[1:] == key[:-1]
        if (mixed := same & (content[1:] != content[:-1])).any():  # few seeds of a block have several contents: sort these by content
            of = np.cumsum(np.concatenate([[True], ~same])) - 1
            several = np.zeros(of[-1] + 1, bool)
            several[of[1:][mixed]] = True
            at = np.flatnonzero(several[of])
            order[at] = order[at[np.lexsort((content[at], key[at]))]]
            content = self.runs.content[order]
        fresh = np.concatenate([[True], ~same | (content[1:] != content[:-1])]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        self.keys, self.content = key[first], content[first]
        self.least = np.minimum.reduceat(self.id[order], first) if len(key) else np.zeros(0, np.int64)
        self.key_of = np.empty(len(key), np.int64)
        self.key_of[order] = np.cumsum(fresh) - 1

    def send(self, parts: int, keys: np.ndarray, content: np.ndarray, width: int, least: np.ndarray) -> pa.Table:
        """Rows for the parts of ``keys``, which are sorted; of ``content`` the ``width`` high bytes are sent."""
        cut = cuts(keys, parts)
        high = content.view(np.uint8).reshape(-1, 8)[:, 8 - width :]
        rows = [(p, self.name, b - a, steps(keys[a:b]), high[a:b].tobytes(), planes(least[a:b], "<i8")) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["part", "block", "n", "keys", "content", "docs"])

    def settle(self, rows: list[dict], level: int, parts: int, keys: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key: the least document, or one below all others where another block has a smaller one than this; and
        whether the next level has to tell."""
        cut, least, is_open = cuts(keys, parts), least.copy(), np.zeros(len(keys), bool)
        for r in rows:
            if r["level"] == level:
                a, b = cut[r["part"]], cut[r["part"] + 1]
                status = np.frombuffer(r["status"], np.uint8)
                least[a:b][status == 1] = np.iinfo(np.int64).min
                is_open[a:b] = status == 2
        return least, is_open

    def open_windows(self, is_open: np.ndarray) -> None:
        """Windows of the runs that the first level leaves open: names, and the least document of this block for each."""
        per_run = is_open[self.key_of]
        self.window_open = np.repeat(per_run, self.runs.size)
        full = self.runs.full[self.window_open]
        seed = np.repeat(self.runs.seed[per_run], self.runs.size[per_run]) >> np.uint64(32)
        ids = np.repeat(self.id[per_run], self.runs.size[per_run])
        order = np.lexsort((seed, full))
        key, mark = full[order], seed[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        self.full_keys, self.full_marks = key[first], mark[first] << np.uint64(32)
        self.full_least = np.minimum.reduceat(ids[order], first) if len(key) else np.zeros(0, np.int64)
        self.full_of = np.empty(len(key), np.int64)
        self.full_of[order] = np.cumsum(fresh) - 1


def least_documents(group: pa.Table, level: int) -> pa.Table:
    """Of one partition of names: what each block has to know. Status 1: another block has the name, with the same
    content, in a smaller document; 2: it has not, and the name has several contents; 0: neither."""
    sizes = group["n"].to_pylist()
    keys = np.concatenate([np.cumsum(unplanes(x, "<u8"), dtype=np.uint64) for x in group["keys"].to_pylist()])
    docs = np.concatenate([unplanes(x, "<i8") for x in group["docs"].to_pylist()])
    width = WIDTHS[level]
    content = np.zeros((len(keys), 8), np.uint8)
    content[:, 8 - width :] = np.frombuffer(b"".join(group["content"].to_pylist()), np.uint8).reshape(-1, width)
    content = content.view(np.uint64).reshape(-1)
    order = np.lexsort((content, keys))
    ordered, content = keys[order], content[order]
    new_key = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    fresh = new_key | np.concatenate([[True], content[1:] != content[:-1]])
    first = np.flatnonzero(fresh)
    least = np.minimum.reduceat(docs[order], first)[np.cumsum(fresh) - 1]
    state = np.where(least < docs[order], 1, 0)
    if level == 1:
        several = np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(new_key)) > 1
        state[(state == 0) & several[np.cumsum(new_key) - 1]] = 2
    status = np.empty(len(keys), np.uint8)
    status[order] = state
    cut = np.concatenate([[0], np.cumsum(sizes)])
    part = group["part"][0].as_py()
    rows = [(name, level, part, status[a:b].tobytes()) for name, a, b in zip(group["block"].to_pylist(), cut, cut[1:])]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["block", "level", "part", "status"])


def cut_block(block: Block, rows: list[dict], parts: int, full_parts: int) -> pa.Table:
    least, is_open = block.settle(rows, 1, parts, block.keys, block.least)
    block.open_windows(is_open)
    full_least, _ = block.settle(rows, 2, full_parts, block.full_keys, block.full_least)
    runs = block.runs
    own = np.repeat(block.id, runs.size)
    holder = np.repeat(least[block.key_of], runs.size)
    holder[block.window_open] = full_least[block.full_of]
    begin = np.cumsum(runs.size) - runs.size
    where = np.repeat(runs.at - begin, runs.size) + np.arange(len(own))
    row = np.repeat(runs.row, runs.size)
    gone = holder < own
    row, where = row[gone], where[gone]
    edge = np.searchsorted(row, np.arange(len(block.texts) + 1))
    spans, kept = [], []
    for k, text in enumerate(block.texts):
        at = where[edge[k] : edge[k + 1]]
        if not len(at):
            spans.append([])
            kept.append(text)
            continue
        new = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + LEAST]))
        start, end = at[new], np.append(at[new[1:] - 1], at[-1]) + LEAST
        spans.append(np.stack([start, end], axis=1).reshape(-1).tolist())
        ends = [0, *end.tolist()]
        kept.append(b"".join(text[a:b] for a, b in zip(ends, [*start.tolist(), len(text)])))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.table([pa.array(x, k) for x, k in zip([block.ids, list(map(len, block.texts)), spans, kept], kinds)], names=["doc_id", "n_bytes", "spans", "kept"])


def substring_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """doc_id, n_bytes, spans (start, end, ... of the removed bytes) and the kept bytes of every document."""
    n_bytes = text_bytes(docs)
    blocks = bucketed(make_blocks(docs, block_bytes), "block", n_bytes)
    parts = full_parts = int(1 + n_bytes // (16 * part_keys))
    by_block = blocks.groupBy("block")

    def send_seeds(group: pa.Table) -> pa.Table:
        block = Block(group)
        return block.send(parts, block.keys, block.content, WIDTHS[1], block.least)

    seeds = stored(by_block.applyInArrow(send_seeds, SENT).groupBy("part").applyInArrow(lambda group: least_documents(group, 1), BACK))

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left)
        _, is_open = block.settle(right.to_pylist(), 1, parts, block.keys, block.least)
        block.open_windows(is_open)
        return block.send(full_parts, block.full_keys, block.full_marks, WIDTHS[2], block.full_least)

    windows = by_block.cogroup(seeds.groupBy("block")).applyInArrow(send_windows, SENT)
    windows = stored(windows.groupBy("part").applyInArrow(lambda group: least_documents(group, 2), BACK))
    told = seeds.unionByName(windows).groupBy("block")
    return by_block.cogroup(told).applyInArrow(lambda left, right: cut_block(Block(left), right.to_pylist(), parts, full_parts), KEPT)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE: dict[str, str] = {}

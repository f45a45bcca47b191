r"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Both sides lower-case A-Z and take words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. The automaton of one block of items is
built on the driver (at most about ``BLOCK_WORDS`` words, so its size is bounded) and broadcast; larger benchmarks take
one pass over the documents for each block, and what a pass found is stored with the documents for the next.
A task streams each document's words through the automaton and tracks the longest match; a match of at least ``window``
words, or of a whole shorter item, marks its words as hit.

Defined results: null or empty text has no words; items without words are ignored; items with a null id mark words but
are not listed; ``items_sha256`` of a document without hits is the digest of the empty string; repeated rows give
repeated results; empty tables give empty results. ``doc_id`` may be null. No other column is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from auditspark.llm.common import ALNUM, raw_text, slices, stored, table, unused

WINDOW = 13
#: A document is contaminated when at least one word in COVERAGE is hit.
COVERAGE = 20
BLOCK_WORDS = 200_000
WORD = re.compile(rb"[^ ]+")

FOUND = "doc_id long, text binary, n_words long, spans array<long>, items array<string>"


class SuffixAutomaton:
    """All word sequences of some items. ``ends[s]``: the items' windows that end where state ``s`` is reached."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, words in numbered:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.whole = [self._climb(s, window) for s in range(len(self.next))]
        self.items: list[set] = [set() for _ in self.next]
        short: list[list] = [[] for _ in self.next]
        for name, words in numbered:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.items[self.whole[state]].add(name)
            if len(words) < window:
                short[self._climb(state, len(words))].append((len(words), name))
        self.short: list[tuple] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[s] = self.short[self.link[s]] + tuple(short[s])
        self.least = min((min(len(words), window) for _, words in numbered), default=0)
        base = len(self.vocabulary)
        self.pairs = np.unique(np.array([a * base + b for _, words in numbered for a, b in zip(words, words[1:])], dtype=np.int64))

    def _climb(self, state: int, length: int) -> int:
        while state > 0 and self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of the string that ``p`` and ``w`` make, apart from longer strings of the same class."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w)
        return state

    def _stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Word ranges outside of which nothing can match: in a match all neighbours are neighbours in an item."""
        if len(ids) < self.least or not self.least:
            return
        if self.least == 1:
            yield 0, len(ids)
            return
        key = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * len(self.vocabulary) + ids[1:], -1)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        good = np.concatenate([[False], self.pairs[at] == key, [False]])
        edge = np.flatnonzero(good[1:] != good[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + 1 >= self.least:
                yield a, b + 1

    def hits(self, words: list[bytes]) -> tuple[list[int], set]:
        """Maximal hit word ranges as start, end, start, end ... and the names of items with occurring windows."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        spans: list[int] = []
        names: set = set()
        for a, b in self._stretches(ids):
            state = length = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if w not in self.next[state]:
                    continue
                state, length = self.next[state][w], length + 1
                longest = 0
                if length >= self.window:
                    longest = self.window
                    names |= self.items[self.whole[state]]
                for k, name in self.short[state]:
                    if k <= length:
                        longest = max(longest, k)
                        names.add(name)
                if longest:
                    start = i + 1 - longest
                    while spans and spans[-2] >= start:
                        start = min(start, spans[-2])
                        del spans[-2:]
                    if spans and spans[-1] >= start:
                        spans[-1] = i + 1
                    else:
                        spans += [start, i + 1]
        return spans, names


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def is_contaminated(spans: list[int], n_words: int, coverage: int = COVERAGE) -> bool:
    n_hit = sum(spans[1::2]) - sum(spans[::2])
    return n_hit > 0 and coverage * n_hit >= n_words


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[tuple[SuffixAutomaton, bool]]:
    """One automaton for each block of items, and whether it is the last; a block is what the driver holds at a time."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), raw_text())
    size = rows.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // (6 * block_words)))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        yield SuffixAutomaton([(r[0], words_of(bytes(r[1]))) for r in part.collect()], window), k == blocks - 1


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Of each document: n_words, the hit word ranges (start, end, ...) and the ids of items that occur in it."""
    spark = docs.sparkSession
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for k, (automaton, _) in enumerate(automata(items, window, block_words)):
        sent = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = sent.value
            for batch in slices(batches):
                n, spans, names = [], [], []
                for text, old, known in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "items"))):
                    words = words_of(text)
                    new, more = automaton.hits(words)
                    n.append(len(words))
                    spans.append(merged(old + new) if old else new)
                    names.append(sorted({*known, *more} - {None}))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "spans", "items"])

        found = (stored(found) if k else found).mapInArrow(run, FOUND)
    return found


def cut(text: bytes, spans: list[int]) -> bytes:
    """``text`` without the words of ``spans``."""
    places = [m.span() for m in WORD.finditer(text.translate(ALNUM))]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs``, all columns, without contaminated documents; other documents lose only the words of their hit spans.

    One block of items needs no shuffle; with more, the passes run one after another over stored documents, which keep
    their text and the spans found so far; the last pass judges and cuts by the spans of all blocks."""
    spark, schema = docs.sparkSession, docs.schema
    known = unused(docs, "_spans")
    for k, (automaton, last) in enumerate(automata(items, window, block_words)):
        sent = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=not k, last=last) -> Iterator[pa.RecordBatch]:
            automaton = sent.value
            for batch in slices(batches):
                at, found, keep, texts = batch.schema.get_field_index("text"), [], [], []
                before = repeat([]) if first else batch.column(batch.num_columns - 1).to_pylist()
                for text, old in zip(batch.column(at).cast(pa.binary()).to_pylist(), before):
                    words = words_of(text or b"")
                    new, _ = automaton.hits(words)
                    spans = merged(old + new) if old else new
                    if last:
                        keep.append(not is_contaminated(spans, len(words), coverage))
                        texts.append(cut(text, spans) if spans else text)
                    else:
                        found.append(spans)
                columns = batch.columns if first else batch.columns[:-1]
                names = batch.schema.names[: len(columns)]
                if last:
                    columns[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
                    yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int64()))], names=[*names, known])

        docs = (stored(docs) if k else docs).mapInArrow(run, schema if last else StructType([*schema, StructField(known, ArrayType(LongType()))]))
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words"))
    )


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE = {
    "op4_decontaminate": r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spread AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM spread),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc CROSS JOIN (SELECT DISTINCT k FROM win)),
hit AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM place) JOIN win USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""
}

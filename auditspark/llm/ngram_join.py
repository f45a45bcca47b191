r"""Exact Jaccard join of documents on word shingles, with adaptive multi-match prefixes.

A document's set is its distinct 4-word shingles; two link where their sets' similarity is at least 0.85, so that at
most ``n - ceil(0.85 n)`` of a set's n shingles are missing in any set that it links with. Equal sets are one class.

(1) Shingles under a fixed hash, a quarter of them, are a first prefix in hash order: a class of whose sampled shingles
more are nowhere else than may be missing links with nothing. Most classes end here, and only their samples moved.
(2) The others' full sets are counted, and each set is ordered by the frequency of its shingles. A prefix of
``n - ceil(0.85 n) + l`` shingles shares at least ``min(l, l')`` shingles with that of any set that it links with. Each
class lengthens its prefix for itself: l is where the entries to read and the candidates to verify (each needs l entries
of the prefix) are estimated to cost least. (3) In each shingle's list the class of the most frequent shingles is a
centre; the distinct pairs of centre and member are verified on full sets and give components. (4) What is left are pairs
in different components. They are joined by shared prefix shingles, where enough of both sets follows the shared
places for the pair's needed overlap, counted, and verified on full sets if they share ``min(l, l')``. No pair that could
link is left out, so the result is exact; the components of both kinds of links are the result.

A list makes as many rows as it has members in (3). In (4) it makes a row only for pairs in different components whose
unmatched shingles so far leave room to link; a family of variants that are all far from each other makes none.

Defined results: null and empty texts and texts without words have an empty set and are linked with nothing. Each row is
a document of its own; rows that share an id or have none link by their texts. A group's id is the smallest id in it, and
null where no row of it has one. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import discard, raw_text, slices, stored, table
from auditspark.llm.near_dedup import components, set_key
from auditspark.llm.shingles import shingle_sets

WORDS, SIMILAR = 4, 85
#: Part of all shingles that is looked at first.
SAMPLE = 0.25
#: What it costs to verify a candidate, in entries read: a fixed part, and one more for so many shingles.
VERIFY, VERIFY_SHINGLES = 4, 50
SIGNED = "doc_id long, row_key long, n long, set_key binary, class long, sample array<long>"
PREFIX = "shingle long, node long, n long, at long, level long, score double"


def least(n: Column) -> Column:
    """ceil(0.85 n): shingles that a set of n shares with any set that it links with."""
    return F.floor((SIMILAR * n + 99) / 100).cast("long")


def overlap_of(n: Column, m: Column) -> Column:
    """Shingles that linked sets of n and m share at least: ceil(0.85 / 1.85 (n + m))."""
    return F.ceil(SIMILAR * (n + m) / (100 + SIMILAR)).cast("long")


def longs(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (a hash of id and text) and the text's bytes."""
    row_key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row_key")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key, raw_text())


def sign(docs: DataFrame, words: int) -> DataFrame:
    """Size and key of each document's set, and the shingles of it that are sampled."""
    under = np.uint64(SAMPLE * 2**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            keys = [set_key(s) if len(s) else None for s in sets]
            classes = [int.from_bytes(k[:8], "little", signed=True) if k else None for k in keys]
            columns = [pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array(classes, pa.int64())]
            sample = longs([s[: np.searchsorted(s, under)] for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, sample], names=["doc_id", "row_key", "n", "set_key", "class", "sample"])

    return keyed(docs).mapInArrow(run, SIGNED)


def candidates(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """node, set_key, row_key of the classes that can link by their sampled shingles."""
    shingles = signed.select("class", F.explode("sample").alias("shingle"))
    held = shingles.groupBy("shingle").agg(F.min("class").alias("class"), F.max("class").alias("last"))
    alone = held.where(F.col("class") == F.col("last")).groupBy("class").agg(F.count(F.lit(1)).alias("alone"))
    open_ = classes.join(alone, "class", "left").where(F.coalesce("alone", F.lit(0)) <= F.col("n") - least(F.col("n")))
    return stored(open_.select(F.monotonically_increasing_id().alias("node"), "set_key", "row_key"))


def full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, n, shingles of each of ``nodes``, from one row of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(0).to_pylist(), words)
            keys = [set_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), longs(sets)], names=["set_key", "shingles"])

    texts = keyed(docs.where(F.col("text").isNotNull())).join(nodes.select("row_key"), "row_key", "left_semi").select("text")
    sets = texts.mapInArrow(run, "set_key binary, shingles array<long>").join(nodes.select("set_key", "node"), "set_key")
    one = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    return stored(one.select("node", F.size("shingles").cast("long").alias("n"), "shingles"))


def prefixes(sets: DataFrame) -> DataFrame:
    """The shingles of each set's prefix that another set has too: PREFIX, ``at`` from 0, ``level`` the set's l, ``score``
    the mean frequency of its shingles. Sets that can link with nothing have none."""
    rows = sets.select("node", "n", F.explode("shingles").alias("shingle"))
    counts = stored(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1))
    common = rows.join(counts, "shingle").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("common"))
    common = common.where(F.size("common") >= least(F.col("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for node, n, times, shingles in zip(*(batch.column(k).to_pylist() for k in range(4))):
                times, alone = np.array(times, np.int64), n - len(times)
                level, size = chosen(n, alone, times)
                score = (alone + int(times.sum())) / n
                out.append((shingles[:size], np.full(size, node), np.full(size, n), alone + np.arange(size), np.full(size, level), np.full(size, score)))
            columns = [np.concatenate(c) for c in zip(*out)]
            kinds = [pa.int64()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names=["shingle", "node", "n", "at", "level", "score"])

    found = stored(common.select("node", "n", "common.times", "common.shingle").mapInArrow(run, PREFIX))
    discard(counts)
    return found


def chosen(n: int, alone: int, times: np.ndarray) -> tuple[int, int]:
    """The level l of a set of n shingles whose first ``alone`` are nowhere else and whose others are in ``times`` sets, and
    how many of the others its prefix has.

    The entries that a level reads are estimated for partners of the same size: those at places that leave room for the
    overlap which such a pair needs."""
    need, both = -(-SIMILAR * n // 100), -(-2 * SIMILAR * n // (100 + SIMILAR))
    level = np.arange(1, need + 1)
    room = np.clip(n - both + level - alone, 0, len(times))
    entries = np.concatenate([[0], np.cumsum(times - 1)])[room]
    best = int(np.argmin(entries * (1 + (VERIFY + n / VERIFY_SHINGLES) / level)))
    return best + 1, int(np.clip(n - need + best + 1 - alone, 0, len(times)))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link on their full sets. The members' sets (b) move to the rarer key first."""
    second = pairs.join(sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("set_b")), "b")
    both = second.join(sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("set_a")), "a")
    both = both.withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return stored(both.where(100 * F.col("common") >= SIMILAR * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b"))


def star_pairs(prefix: DataFrame) -> DataFrame:
    """Distinct pairs of the centre (a) of a shingle's list and another of its members (b)."""
    order = F.struct("score", (-F.col("node")).alias("last"), "n")
    centres = stored(prefix.groupBy("shingle").agg(F.max(order).alias("m"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1).select("shingle", (-F.col("m.last")).alias("a"), F.col("m.n").alias("n_a")))
    fits = 100 * F.least("n", "n_a") >= SIMILAR * F.greatest("n", "n_a")
    return stored(prefix.join(centres, "shingle").where((F.col("node") != F.col("a")) & fits).select("a", F.col("node").alias("b")).distinct())


def far_pairs(prefix: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that share as many prefix shingles as the lower of their levels asks.

    A shared shingle counts where the shingles from there on, with ``level - 1`` before it, are enough for the overlap that
    a pair of these sizes needs; the first ``level`` shared shingles of a pair that links all are such."""
    rows = prefix.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    most = F.floor((F.col("n") - F.col("at") + F.col("level") - 1) * (100 + SIMILAR) / SIMILAR) - F.col("n")  # size of a partner, at most
    rows = stored(rows.withColumn("most", most))
    lists = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("smallest"))
    lists = stored(lists.where(F.col("low") != F.col("high")))
    open_ = stored(rows.join(lists, "shingle").where(F.col("most") >= F.col("smallest")).select("shingle", "node", "n", "at", "level", "component", "most"))
    a, b = (open_.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "at", "level", "component", "most"))) for s in "ab")
    level = F.least("level_a", "level_b")
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + level - 1
    near = (F.col("n_a") <= F.col("most_b")) & (F.col("n_b") <= F.col("most_a")) & (left >= overlap_of(F.col("n_a"), F.col("n_b")))
    shared = a.join(b, "shingle").where((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & near)
    pairs = shared.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), level.alias("level")).agg(F.count(F.lit(1)).alias("shared"))
    found = stored(pairs.where(F.col("shared") >= F.col("level")).select("a", "b"))
    discard(rows, lists, open_)
    return found


def linked_classes(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, component of the classes that link with another."""
    sets = full_sets(docs, nodes, words)
    prefix = prefixes(sets)
    links = verified(star_pairs(prefix), sets)
    named = components(links)
    further = verified(far_pairs(prefix, named), sets)
    found = named if further.isEmpty() else components(links.union(further))
    discard(sets, prefix)
    return found


def join_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    signed = stored(sign(docs, words))
    one = signed.where(F.col("set_key").isNotNull()).groupBy("set_key")
    classes = stored(one.agg(F.min("doc_id").alias("least_id"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("class").alias("class")))
    nodes = candidates(signed, classes)
    found = nodes.join(linked_classes(docs, nodes, words), "node").select("set_key", "component")
    found = stored(found.join(classes.select("set_key", "least_id"), "set_key"))
    ids = found.groupBy("component").agg(F.min("least_id").alias("of_component"))
    named = stored(classes.select("set_key", "least_id").join(found.join(ids, "component").select("set_key", "of_component"), "set_key", "left"))
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(named, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.coalesce("of_component", "least_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op12_ngram_join": op12_ngram_join}
ORACLE = {
    "op12_ngram_join": r"""
WITH RECURSIVE word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM word WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, root AS component_id FROM (SELECT node AS doc_id, min(root) AS root FROM reach GROUP BY node) LEFT JOIN n USING (doc_id)"""
}

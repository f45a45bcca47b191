r"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped edges.

A document's set is its distinct 5-word shingles. (1) Tasks hash each text to the size of its set, a 128-bit key of the
set and ``BANDS`` band hashes of a one-permutation signature of ``BINS`` bins; an empty bin borrows from bins at a fixed
pseudo-random sequence until one is filled. (2) Equal sets are one class, represented by their smallest id; only
classes go on. (3) In each bucket of two or more classes the class that shares most buckets is the centre; edges go from
the centre to the others, so a bucket makes as many edges as it has members. (4) Edges are confirmed on the full sets
of both texts, and confirmed links give components. (5) Where a bucket still holds several components, its members
outside the centre's component are held, on full sets, against the members of other components; members whose sets share
too few shingles with all other such documents are left out first. Both sides of a bucket are dealt out in blocks of a
bounded number of shingles, and a task holds two blocks against each other as rows of bits; the components that are
linked leave it. Any two linked classes that meet in a bucket are then in one component. Two sets with the least
similarity, 0.75, miss each other in all bands with a probability of about 5e-6.

Defined results: null or empty text and text without words has an empty set and is linked with nothing; rows that share
an id are one document; rows without an id link nothing but join the group of an equal set; empty tables give empty
results. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.llm.common import bucketed, discard, drop_caches, mix64, raw_text, slices, stored, table, text_bytes, unused
from auditspark.llm.shingles import overlap, shingle_sets

BINS, BANDS = 128, 32
ROWS = BINS // BANDS
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Shingles of a block of a bucket's members, about; what a member counts besides its shingles.
BLOCK_SHINGLES, MEMBER = 1 << 15, 32
SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>"
_BITS = np.uint64(64 - BINS.bit_length() + 1)
_PROBES = (mix64(np.arange(BINS * 2048, dtype=np.uint64) + np.uint64(1 << 40)) % np.uint64(BINS)).astype(np.int64).reshape(2048, BINS)
_FACTORS = mix64(np.arange(1, ROWS + 1, dtype=np.uint64) + np.uint64(1 << 41)) | np.uint64(1)
_SALTS = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(1 << 42))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin, bins being ranges of the hash; ``hashes`` are sorted and not empty."""
    home = (hashes >> _BITS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
    filled = np.zeros(BINS, bool)
    filled[home[first]] = True
    out = np.zeros(BINS, np.uint64)
    out[home[first]] = hashes[first]
    empty = np.flatnonzero(~filled)
    for a, b in ((0, 16), (16, 256), (256, 2048)):
        if not len(empty):
            break
        hit = filled[_PROBES[a:b, empty]]
        found = hit.any(axis=0)
        out[empty[found]] = out[_PROBES[a + hit.argmax(axis=0)[found], empty[found]]]
        empty = empty[~found]
    out[empty] = hashes[0]
    return out


def bands_of(hashes: np.ndarray) -> np.ndarray:
    return mix64((signature(hashes).reshape(BANDS, ROWS) * _FACTORS).sum(axis=1, dtype=np.uint64) + _SALTS).view(np.int64)


def set_key(hashes: np.ndarray) -> bytes:
    sums = [mix64(hashes + np.uint64(salt)).sum(dtype=np.uint64) for salt in (3 << 50, 5 << 50)]
    return np.array(sums, np.uint64).tobytes()


def sign(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1).to_pylist())
            bands = np.concatenate([bands_of(s) for s in sets if len(s)] or [np.zeros(0, np.int64)])
            full = np.array([len(s) > 0 for s in sets])
            ends = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands))],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text()).mapInArrow(run, SIGNED)


def with_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows that have an id, bucketed by it in a further column, which is named: texts move here once, and all later
    joins with ids move ids only."""
    key = unused(docs, "_id")
    rows = docs.withColumn(key, F.col("doc_id").cast("long")).where(F.col(key).isNotNull())
    return bucketed(rows, key, text_bytes(docs), spread=True), key


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``docs`` (id, text) are bucketed by id. Texts of linked ids go to
    a pair's second id first, as that is the rarer key."""
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    texts = stored(docs.join(ids, "id", "left_semi"))
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in slices(batches, 256):
            ids = batch.column(0).to_pylist()
            left = batch.column(2).to_pylist()
            right = shingle_sets(batch.column(3).to_pylist())
            keep = []
            for i, other in zip(range(len(ids)), right):
                if held is None or left[i] != last:
                    last, held = left[i], shingle_sets([left[i]])[0]
                common = overlap(held, other)
                keep.append(100 * common >= SIMILAR * (len(held) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = stored(both.select("a", "b", F.col("text_a").cast("binary"), F.col("text_b").cast("binary")).mapInArrow(run, "a long, b long"))
    discard(texts, ids)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest id reachable by ``links`` (a, b); ids without links are absent.

    Labels go along the links and then jump to their label's label until none changes."""
    both = links.union(links.select("b", "a")).toDF("node", "other")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        heard = both.join(labels.withColumnsRenamed({"node": "other", "component": "heard"}), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        nearer = stored(labels.join(heard, "node").select("node", "component", F.least("component", "heard").alias("nearer")))
        jump = nearer.select(F.col("node").alias("nearer"), F.col("nearer").alias("far"))
        moved = stored(nearer.join(jump, "nearer").select("node", F.col("component").alias("was"), F.least("nearer", "far").alias("component")))
        labels = moved.select("node", "component")
        if moved.where(F.col("was") != F.col("component")).isEmpty():
            return labels


def alike(a: str, b: str) -> Column:
    """Sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


def rows_of_bits(sets: list[np.ndarray]) -> np.ndarray:
    """Each sorted set as a row of bits, one for each value that two or more of the sets have."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, common = np.repeat(np.arange(len(sets)), sizes), times[column] > 1
    column, row = (np.cumsum(times > 1) - 1)[column][common], row[common]
    words = int((times > 1).sum()) // 64 + 1
    bits = np.zeros((len(sets), words), np.uint64)
    if len(row):
        at = row * words + (column >> 6)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        bits.reshape(-1)[at[first]] = np.bitwise_or.reduceat(np.uint64(1) << (column & 63).astype(np.uint64), first)
    return bits


def linked_components(numbers: np.ndarray, sets: list[np.ndarray]) -> set[tuple[int, int]]:
    """Pairs of components with a link between a member of half 0 and one of half 1 or, where the block is held ``within``,
    another of half 0. Columns of ``numbers``: half, within, n, component."""
    half, within, n, component = numbers.T
    bits = rows_of_bits(sets)
    found = set()
    for i in np.flatnonzero(half == 0).tolist():
        against = half == 1
        if within[i]:
            against[i + 1 :] = True
        near = np.flatnonzero(against & (component != component[i]) & (100 * np.minimum(n, n[i]) >= SIMILAR * np.maximum(n, n[i])))
        shared = np.bitwise_count(bits[near] & bits[i]).sum(axis=1, dtype=np.int64)
        linked = (100 + SIMILAR) * shared >= SIMILAR * (n[near] + n[i])
        for other in np.unique(component[near[linked]]).tolist():
            found.add((min(other, int(component[i])), max(other, int(component[i]))))
    return found


def hold_blocks(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: components linked by members that share a bucket, one of them outside the bucket's main component. ``placed``: key,
    rep, n, component, main.

    A bucket's outside and other members are dealt out in blocks by a hash of their ids. Each outside block a meets each
    other block b (and itself, with the first of these) and each outside block after it, numbered after the others."""
    out = F.col("component") != F.col("main")
    weight = F.col("n") + MEMBER
    blocks = [F.greatest(F.lit(1), F.ceil(F.sum(F.when(side, weight)) / BLOCK_SHINGLES)).cast("int") for side in (out, ~out)]
    totals = placed.groupBy("key").agg(F.count(F.when(out, 1)).alias("outside"), blocks[0].alias("outs"), blocks[1].alias("ins"))
    dealt = placed.join(stored(totals.where(F.col("outside") > 0).drop("outside")), "key")
    own = F.pmod(F.xxhash64("rep"), F.when(out, F.col("outs")).otherwise(F.col("ins"))).cast("int")
    dealt = dealt.select("key", "rep", "n", "component", "outs", "ins", out.alias("out"), own.alias("own"))

    def place(a: Column, b: Column, half: Column) -> Column:
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), half.cast("int").alias("half"))

    to_others = F.transform(F.sequence(F.lit(0), F.col("ins") - 1), lambda b: place(F.col("own"), b, F.lit(0)))
    further = F.filter(F.sequence(F.lit(0), F.col("outs") - 1), lambda o: o != F.col("own"))
    to_outside = F.transform(further, lambda o: place(F.least(o, "own"), F.col("ins") + F.greatest(o, "own"), (o < F.col("own")).cast("int")))
    from_others = F.transform(F.sequence(F.lit(0), F.col("outs") - 1), lambda a: place(a, F.col("own"), F.lit(1)))
    places = F.when(F.col("out"), F.concat(to_others, to_outside)).otherwise(from_others)
    copies = dealt.withColumn("at", F.explode(places)).select("key", "at.*", (F.col("at.b") == 0).cast("int").alias("within"), "rep", "n", "component")
    rows = copies.join(sets, "rep").select("key", "a", "b", "half", "within", "n", "component", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, numbers, held, found = None, [], [], set()
        for batch in slices(batches):
            at = np.stack([batch.column(c).to_numpy() for c in ("key", "a", "b")], axis=1)
            sets = batch.column("shingles")
            ends, values = sets.offsets.to_numpy() - sets.offsets[0].as_py(), sets.flatten().to_numpy().view(np.uint64)
            columns = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("half", "within", "n", "component")], axis=1)
            starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for first, end in zip(starts[:-1], starts[1:]):
                if last is None or (at[first] != last).any():
                    if len(held) > 1:
                        found |= linked_components(np.concatenate(numbers), held)
                    last, numbers, held = at[first], [], []
                numbers.append(columns[first:end])
                held.extend(values[ends[i] : ends[i + 1]] for i in range(first, end))
        if len(held) > 1:
            found |= linked_components(np.concatenate(numbers), held)
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    groups = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return groups.mapInArrow(run, "a long, b long").distinct()


def shared_sizes(ids: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, shingles): the sets of these documents (``ids``, each at most BANDS times); (rep, common): how many shingles of each another one of them has too.
    No two of them have more in common than the smaller of their two numbers, which bounds their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = shingle_sets(batch.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(list(map(len, sets)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["rep", "shingles"])

    texts = docs.select(F.col("id").alias("rep"), raw_text()).join(ids, "rep", "left_semi")
    sets = stored(texts.mapInArrow(run, "rep long, shingles array<long>"))
    one = sets.select("rep", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    alone = stored(one.where(F.col("rep") == F.col("last")).groupBy("rep").agg(F.count(F.lit(1)).alias("alone")))
    sizes = sets.select("rep", F.size("shingles").alias("n"))
    return sets, stored(sizes.join(alone, "rep", "left").select("rep", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common")))


def link_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """set_key, component_id of all classes (set_key, rep, n, bands)."""
    members = stored(classes.select("rep", "n", F.explode("bands").alias("key")))
    sizes = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1))
    every, members = members, stored(members.join(sizes, "key"))
    discard(every)
    shared = members.withColumn("shared", F.sum("size").over(Window.partitionBy("rep")))  # a class has at most BANDS rows
    centres = stored(shared.groupBy("key").agg(F.max(F.struct("shared", (-F.col("rep")).alias("last"), "n")).alias("m")).select("key", (-F.col("m.last")).alias("centre"), F.col("m.n").alias("centre_n")))
    placed = stored(members.join(centres, "key").select("key", "rep", "n", "centre", "centre_n"))
    discard(members, centres)
    star = placed.where((F.col("rep") != F.col("centre")) & alike("n", "centre_n"))
    found = components(confirm(stored(star.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()), docs))

    component = F.coalesce("component", "rep")
    named = stored(placed.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "centre", component.alias("component")))
    main = F.max(F.when(F.col("rep") == F.col("centre"), F.col("component"))).alias("main")
    mixed = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), main)
    mixed = stored(mixed.where(F.col("least") != F.col("most")).select("key", "main"))
    opened = stored(named.join(mixed, "key"))
    sets, common = shared_sizes(opened.select("rep"), docs)
    least = SIMILAR * F.col("n") <= 100 * F.col("common")  # else it is near none of them
    held = stored(opened.join(common, "rep").where(least & (F.col("rep") != F.col("centre"))).select("key", "rep", "n", "component", "main"))
    links = stored(hold_blocks(held, sets))
    discard(sets, held, opened, named, placed)
    of_classes = classes.select("set_key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", component.alias("component_id"))
    if links.isEmpty():
        return of_classes
    joined = components(links).select(F.col("node").alias("component_id"), "component")
    return of_classes.join(joined, "component_id", "left").select("set_key", F.coalesce("component", "component_id").alias("component_id"))


def duplicates(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """As ``near_duplicates``; ``texts`` (id, text) are the rows with an id, bucketed by it."""
    signed = stored(sign(docs))
    classes = stored(signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    named = stored(link_classes(classes, texts))
    joined = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    held, key = with_ids(docs.select("doc_id", "text"))
    return duplicates(docs, held.select(F.col(key).alias("id"), "text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each group. Rows without an id all stay; of rows that share an id, all
    stay or none."""
    held, key = with_ids(docs)
    found = duplicates(docs, held.select(F.col(key).alias("id"), "text"))
    gone = stored(found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(key)).distinct())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = held.join(gone, key, "left_anti").select(*columns)
    return kept.unionByName(docs.where(F.col("doc_id").cast("long").isNull()))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLE = {
    "op7_near_dedup": r"""
WITH RECURSIVE word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM word WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, doc_id = root AS kept FROM (SELECT node AS doc_id, min(root) AS root FROM reach GROUP BY node) LEFT JOIN n USING (doc_id)"""
}

r"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words ``[^\x20\x09-\x0D]+``. Sources, in code-point order with null last, weigh 1, 2, 3, 1, 2, ...; they share
all words, and a source's target stops at ``MAX_EPOCHS`` times its size, the excess being shared again by weight.
The words are cut into equal blocks (a hundredth of the smallest target, at most a sixteenth of a shard). Blocks go
to sources by the highest quotients target / (2 k + 1), then, in the same way, from each source to its shards by the
shards' sizes, which gives an integer quota for each shard. A shard holds a seeded share of a source's documents in
a seeded order; whole rounds take every word once, and the rest of the quota takes blocks that a seeded permutation
selects. So a source's words come within one block of its target, and a document's within MAX_EPOCHS times its size.
Where whole documents are asked for, the parts of copies are rounded together for each source (``rounded``).

Tables with a row for each source or shard are aggregated by Spark and small against the documents; they stay
DataFrames, are joined with the documents' sizes only, and texts are never moved.

Defined results: null or empty text has size 0 and nothing is taken of it; null is a source of its own; a source
without words has the target 0; equal ids are ordered by size; an empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.llm.common import stored, table, unused

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"
#: Blocks of the smallest target.
RESOLUTION = 100
#: Words of a shard, about, unless that made more than MOST_SHARDS of them: the table of shards stays small at any size.
SHARD_WORDS, MOST_SHARDS = 1 << 14, 1 << 18
WORD = r"[^\x20\x09-\x0D]+"


def number_of(digest: Column, start: int) -> Column:
    """Six hexadecimal digits of ``digest`` as a number."""
    return F.conv(F.substring(digest, start, 6), 16, 10).cast("long")


def size_of() -> Column:
    """Words of the text."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target: capped shares of all words. ``sizes`` has a row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("place", F.row_number().over(order))
    weights = F.array(*map(F.lit, WEIGHTS))
    rows = stored(rows.withColumn("weight", F.element_at(weights, (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))).withColumn("cap", MAX_EPOCHS * F.col("source_size")))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    share, fixed = 0.0, -1
    while True:  # each round but the last adds a source at its cap; a few rounds in practice
        full = F.col("cap") <= F.lit(share) * F.col("weight")
        left = rows.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("cap"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if left["n"] == fixed or not left["weight"]:
            break
        fixed, share = left["n"], (total - left["cap"]) / left["weight"]
    return rows.withColumn("target", F.when(F.col("cap") <= F.lit(share) * F.col("weight"), F.col("cap").cast("double")).otherwise(F.lit(share) * F.col("weight"))).drop("cap")


def apportion(rows: DataFrame, group: list[str], votes: str, order: list[Column], seats: Column, most: str) -> DataFrame:
    """Sainte-Laguë: adds ``quota``, the seats of each row of a group, at most column ``most``.

    A divisor a little above the final one gives nearly all seats at once; the few left, at most as many as the group
    has rows, go to the highest quotients among each row's next ones."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    rows = rows.withColumn("_seats", seats).withColumn("_votes", F.sum(votes).over(whole)).withColumn("_rows", F.count(F.lit(1)).over(whole))
    share = F.col(votes) / F.col("_votes")
    first = F.greatest(F.lit(0), F.floor(share * (F.col("_seats") - F.col("_rows") / 2) + 0.5))
    rows = rows.withColumn("_first", F.when(F.col(votes) > 0, F.least(first, F.col(most))).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("_left", F.col("_seats") - F.sum("_first").over(whole)).withColumn("_more", F.least(F.col(most) - F.col("_first"), F.ceil(share * 2 * F.col("_rows")) + 1).cast("long"))
    next_seats = rows.where((F.col(votes) > 0) & (F.col("_more") > 0)).withColumn("_k", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_more") - 1)))
    quotient = F.col(votes) / (2 * F.col("_k") + 1)
    ranked = next_seats.withColumn("_rank", F.row_number().over(whole.orderBy(quotient.desc(), *order, F.col("_k"))))
    keys = [c for c in rows.columns if not c.startswith("_")]
    won = ranked.where(F.col("_rank") <= F.col("_left")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    same = None
    left, right = rows.alias("l"), won.alias("r")
    for c in (*group, *(["shard"] if "shard" in keys else []), *([] if group else ["source"])):
        test = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        same = test if same is None else same & test
    return left.join(right, same, "left").select(*[F.col(f"l.{c}") for c in keys], (F.col("l._first") + F.coalesce("r._won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shard and source of each document."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size"), digest.alias("digest")))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    facts = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    shard_words = max(SHARD_WORDS, facts["total"] // MOST_SHARDS)
    block = max(1, min(int((facts["least"] or 0) // RESOLUTION), shard_words // 16))
    sources = sources.withColumn("limit", F.ceil(F.col("target") / block)).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    sources = stored(apportion(sources, [], "target", [F.col("place")], F.lit(facts["total"] // block), "limit"))
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    dealt = sized.alias("d").join(sources.select("source", "shards").alias("s"), same).select("d.*", F.pmod(number_of(F.col("digest"), 1), F.col("shards")).alias("shard"))
    parts = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    parts = parts.alias("d").join(sources.select("source", "source_size", "target", F.col("quota").alias("source_quota")).alias("s"), same).select("d.*", "s.source_size", "s.target", "s.source_quota")
    parts = apportion(parts.withColumn("limit", F.ceil(F.col("shard_size") * MAX_EPOCHS / block)), ["source"], "shard_size", [F.col("shard")], F.col("source_quota"), "limit")
    most = MAX_EPOCHS * F.col("shard_size")
    words = F.when(F.col("target") >= MAX_EPOCHS * F.col("source_size"), most).otherwise(F.least(F.col("quota") * block, most))
    seeded = number_of(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("null")), F.lit(":"), F.col("shard").cast("string"))), 1)
    parts = parts.where(F.col("shard_size") > 0).withColumn("words", words).withColumn("whole", F.floor(F.col("shard_size") / block).cast("long"))
    parts = stored(parts.select("source", "shard", "quota", "whole", F.pmod(seeded, F.greatest("whole", F.lit(1))).alias("start"), F.floor(F.col("words") / F.col("shard_size")).cast("long").alias("rounds"), (F.col("words") % F.col("shard_size")).cast("long").alias("rest")))
    in_shard = Window.partitionBy("source", "shard").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(in_shard)).alias("d")
    quotas = parts.withColumnsRenamed({"source": "p_source", "shard": "p_shard"})
    placed = placed.join(quotas, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("shard") == F.col("p_shard")), "left")
    placed = placed.join(sources.select("source", "source_size", "target").alias("s"), same).drop(F.col("s.source"))
    taken = F.coalesce(F.col("rounds") * F.col("size") + selected_words(block), F.lit(0).cast("long"))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "shard")


def selected_words(block: int) -> Column:
    """Words of a document, at ``end - size`` to ``end`` of its shard, in the selected blocks. Rank r of whole block b is
    (b + start) mod whole; ranks under rest / block are taken whole and the next one up to the rest; the part of a
    block at the shard's end ranks last."""
    begin, n = F.col("end") - F.col("size"), F.col("rest")
    full = F.floor(n / block).cast("long")

    def overlap(b: Column) -> Column:
        rank = F.when(b < F.col("whole"), F.pmod(b + F.col("start"), F.greatest(F.col("whole"), F.lit(1)))).otherwise(F.col("whole"))
        length = F.when(rank < full, F.lit(block)).when(rank == full, n - full * block).otherwise(F.lit(0)).cast("long")
        return F.greatest(F.lit(0), F.least(F.col("end"), b * block + length) - F.greatest(begin, b * block))

    spanned = F.sequence(F.floor(begin / block).cast("long"), F.floor((F.col("end") - 1) / block).cast("long"))
    return F.when((F.col("size") > 0) & (n > 0), F.aggregate(spanned, F.lit(0).cast("long"), lambda a, b: a + overlap(b))).otherwise(F.lit(0).cast("long"))


def rounded(parts: pd.DataFrame, seed: str) -> pd.DataFrame:
    """Of a source's rows (size, n of that size, part: how much of a copy is taken): those that get a copy more.

    Systematic rounding within classes of size by powers of two, the largest first: a running sum of the parts from a
    seeded start gives a copy wherever it passes a whole number, so a row's chance is its part. What a class emits more
    or less than its parts moves the parts of all smaller ones, in proportion to what they can give."""
    parts = parts.assign(words=parts["size"] * parts["n"]).sort_values(["words", "size", "digest"], ascending=[False, True, True])
    words, part = parts["words"].to_numpy(np.float64), parts["part"].to_numpy(np.float64)
    draw = np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{parts['source'].iloc[0]}".encode()).digest()[:8], "little"))
    level = np.frexp(words)[1]
    edges = [0, *(np.flatnonzero(np.diff(level)) + 1).tolist(), len(words)]
    want, given = float(words @ part), 0.0
    copy = np.zeros(len(words), dtype=bool)
    for a, b in zip(edges, edges[1:]):
        open_, rest = want - given - float(words[a:] @ part[a:]), words[a:]
        room = float(rest @ (1 - part[a:])) if open_ > 0 else float(rest @ part[a:])
        move = min(1.0, abs(open_) / room) if room > 0 else 0.0
        part[a:] += move * (1 - part[a:]) if open_ > 0 else -move * part[a:]
        place = np.floor(np.cumsum(part[a:b]) + draw.random())
        copy[a:b] = np.diff(place, prepend=0) > 0
        given += float(words[a:b] @ copy[a:b])
    return parts.loc[copy, ["doc_id", "source", "size"]]


def whole_copies(taken: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, copies: the taken words of ``mix`` as whole documents, each part of a copy rounded up or
    down so that a source's copies have its taken words. Rows of the same three values get the same copies.

    Only documents at the ends of a shard's selected words have parts: a few of each shard, as few as the shards."""
    key = ["doc_id", "source", "size"]
    units = taken.where((F.col("size") > 0) & (F.col("taken") > 0)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"))
    words = F.col("size") * F.col("n")
    units = stored(units.withColumn("copies", F.floor(F.col("taken") / words).cast("int")).withColumn("part", F.col("taken") % words / words))
    partial = units.where(F.col("part") > 0).withColumn("digest", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    more = partial.groupBy("source").applyInPandas(lambda parts: rounded(parts, seed), "doc_id long, source string, size long")
    both = units.where(F.col("copies") > 0).select(*key, "copies").unionByName(more.withColumn("copies", F.lit(1)))
    return both.groupBy(*key).agg(F.sum("copies").cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs``, all columns, each as often as the mix takes it, in whole documents.

    The one join of texts. It is a sort-merge join at every size, since copies grow with the documents; hot keys are split
    by adaptive execution."""
    names = {c: unused(docs, f"_{c}") for c in ("doc_id", "source", "size", "copies")}
    own = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "size": size_of()}
    copies = stored(whole_copies(mix(docs, seed), seed)).withColumnsRenamed(names)
    same = reduce(Column.__and__, (value.eqNullSafe(F.col(names[c])) for c, value in own.items()))
    copy = unused(docs, "_copy")
    return docs.join(copies.hint("merge"), same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLE: dict[str, str] = {}

r"""Language-model scoring: a bigram Katz backoff model with Good-Turing discounts.

Texts lower-case A-Z and become words ``[^\x20\x09-\x0D]+`` and an end token; a start mark is the first context. The
model learns from documents whose crc32(doc_id as text) mod 7 is not 2 and scores every document.

    p(w | u) = d(c(u, w)) c(u, w) / c(u)   where the pair was seen
               a(u) p(w)                   where u was seen, but not the pair
               p(w)                        otherwise
    p(w)     = d(c(w)) c(w) / N            where w was seen, else the mass that the discounts leave

with Katz's Good-Turing discounts for counts up to ``K`` and a(u) = (1 - sum p(w | u)) / (1 - sum p(w)) over the words
seen after u, which normalises exactly. A context whose counts all exceed K has no discounts; its counts are taken
over c(u) + 1, which leaves mass for the rest.

Tables and movement: documents become blocks of about ``BLOCK_TOKENS`` tokens (a table bucketed by block, with the
block's distinct word hashes). (1) Each block sends its distinct words to word partitions and gets their corpus counts
back. (2) It sends its distinct pairs, with the counts of their words, to partitions of the pair table by context and
gets back the pairs' corpus counts and, for each context, what its backoff weight needs. Contexts of more than ``HOT``
tokens are split by the next word; their parts' sums add up in the block. What moves is packed arrays of distinct
words and pairs of a block, so frequent words cross once a block; partitions are dealt by hash and sized by a count,
and there is no cap on vocabulary or pairs. Word and pair identities are 64-bit hashes.

Defined results: null and empty texts are the end token alone; a null id is learned from; repeated rows count as often
as they stand; without training tokens, train_tokens is 0 and every token has the base probability as the model's too;
an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import bucketed, crc32_of, mix64, planes, raw_text, slices, stored, table, text_bytes, unplanes
from auditspark.llm.shingles import word_hashes

FOLDS, HELD = 7, 2
K = 5
BLOCK_TOKENS = 1 << 21
#: Distinct words, or pairs, of all blocks that one partition takes, about; tokens of a context that is split.
PART_KEYS, HOT = 1 << 20, 1 << 20
START, END = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5A)

BLOCK = "block long, doc_ids array<long>, lengths array<long>, held array<boolean>, n_words long, words binary, tokens binary"
SENT = "part int, block long, sizes array<long>, a binary, b binary, c binary, d binary"
BACK = "block long, kind int, part int, a binary, b binary, stats array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
BACK_NAMES = ["block", "kind", "part", "a", "b", "stats"]


def make_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents' tokens as numbers of their block's distinct words, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, serial = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        held: list = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words, token, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            columns = [[first + serial], [ids], [[len(p) for p in parts]], [held], [len(words)], [words[order].tobytes()], [planes(rank[token], "<u4")]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "doc_ids", "lengths", "held", "n_words", "words", "tokens"])

        for batch in slices(batches):
            hashes, counts = word_hashes(batch.column(2).to_pylist())
            ends = np.cumsum(counts)
            for doc, out, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                if parts and size + b - a > block_tokens:
                    yield flush()
                    ids, held, parts, size, serial = [], [], [], 0, serial + 1
                ids.append(doc)
                held.append(out)
                parts.append(np.concatenate([[START], hashes[a:b], [END]]))
                size += b - a + 2
        if parts:
            yield flush()

    out = F.coalesce(crc32_of() % FOLDS == HELD, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held"), raw_text()).mapInArrow(run, BLOCK)


class Block:
    def __init__(self, row: dict) -> None:
        self.name, self.doc_ids = row["block"], row["doc_ids"]
        self.lengths, self.held = np.array(row["lengths"], np.int64), np.array(row["held"], bool)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = unplanes(row["tokens"], "<u4").astype(np.int64)
        self.learned = np.repeat(~self.held, self.lengths)

    def word_parts(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The words in the order of their parts, and where each part begins."""
        part = (mix64(self.words) % np.uint64(parts)).astype(np.int64)
        return np.argsort(part, kind="stable"), np.searchsorted(np.sort(part), np.arange(parts + 1))

    def counts(self, back: list[dict], parts: int) -> np.ndarray:
        order, cut = self.word_parts(parts)
        out = np.zeros(len(self.words), np.int64)
        for row in back:
            if row["kind"] == 1:
                out[order[cut[row["part"]] : cut[row["part"] + 1]]] = unplanes(row["a"], "<u8")
        return out

    def pairs(self, counts: np.ndarray, parts: int) -> None:
        """Distinct pairs of known words, and entries (context, part) that they belong to, both in the order of parts."""
        n = len(self.words)
        self.start = np.cumsum(self.lengths) - self.lengths
        inner = np.ones(len(self.tokens), bool)
        inner[self.start] = False  # predicted tokens: all but the start marks
        self.at = np.flatnonzero(inner)
        u, w = self.tokens[self.at - 1], self.tokens[self.at]
        known = (counts[u] > 0) & (counts[w] > 0)
        key, self.pair_of = np.unique(u[known] * n + w[known], return_inverse=True)
        self.known = known
        self.pair_learned = np.bincount(self.pair_of, self.learned[self.at][known], len(key)).astype(np.int64)
        self.u, self.w = key // n, key % n
        splits = 1 + counts // HOT
        contexts = np.unique(u[counts[u] > 0])
        entry_u = np.repeat(contexts, splits[contexts])
        piece = np.arange(len(entry_u)) - np.repeat(np.cumsum(splits[contexts]) - splits[contexts], splits[contexts])
        entry_part = self._part(entry_u, piece, parts)
        order = np.lexsort((piece, entry_u, entry_part))
        self.entry_u, self.entry_part = entry_u[order], entry_part[order]
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        first = np.zeros(n, np.int64)
        first[contexts] = np.cumsum(splits[contexts]) - splits[contexts]
        self.entry = number[first[self.u] + (self.words[self.w] % splits[self.u].astype(np.uint64)).astype(np.int64)]
        self.order = np.argsort(self.entry, kind="stable")

    def _part(self, u: np.ndarray, piece: np.ndarray, parts: int) -> np.ndarray:
        return (mix64(self.words[u] + piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) % np.uint64(parts)).astype(np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's discounts of the counts 0 to K from the numbers of events seen 1 to K + 1 times; where the formula has no
    use, as on small or odd data, half a count is taken off."""
    out = np.ones(K + 1)
    r = np.arange(1, K + 1)
    half = (r - 0.5) / r
    n = n.astype(np.float64)
    if (n[: K + 1] <= 0).any():
        out[1:] = half
        return out
    tail = (K + 1) * n[K] / n[0]
    d = ((r + 1) * n[1 : K + 1] / (r * n[:K]) - tail) / (1 - tail) if tail != 1 else half
    out[1:] = np.where((d > 0) & (d < 1), d, half)
    return out


class Unigrams:
    def __init__(self, stats: np.ndarray) -> None:
        self.tokens, self.kinds = int(stats[K + 2]), int(stats[K + 1])
        self.d = discounts(stats[: K + 1])
        small = np.arange(1, K + 1)
        self.unknown = float(((1 - self.d[1:]) * small * stats[:K]).sum() / self.tokens) if self.tokens else 1.0
        if self.tokens and self.unknown <= 0:  # no word is rare: one more token, unseen
            self.scale, self.unknown = self.tokens / (self.tokens + 1), 1 / (self.tokens + 1)
        else:
            self.scale = 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        d = np.where(count <= K, self.d[np.minimum(count, K)], 1.0)
        return np.where(count > 0, d * count * self.scale / max(1, self.tokens), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.kinds + 1))


def send_words(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            block = Block(batch.to_pylist()[0])
            count = np.bincount(block.tokens, block.learned, len(block.words)).astype(np.int64)
            order, cut = block.word_parts(parts)
            yield sent(block.name, [(p, [], block.words[order[a:b]].tobytes(), planes(count[order[a:b]], "<u4"), b"", b"") for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a])

    return blocks.mapInArrow(run, SENT)


def sent(block: int, rows: list[tuple]) -> pa.RecordBatch:
    part, sizes, a, b, c, d = zip(*rows) if rows else ((),) * 6
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([part, [block] * len(part), sizes, a, b, c, d], kinds)], names=["part", "block", "sizes", "a", "b", "c", "d"])


def back(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=BACK_NAMES)


def sum_words(group: pa.Table) -> pa.Table:
    """Of one word partition: for each block, the corpus counts of the words it sent; and counts of counts."""
    blobs = [np.frombuffer(x, np.uint64) for x in group["a"].to_pylist()]
    words, where = np.unique(np.concatenate(blobs), return_inverse=True)
    total = np.bincount(where, np.concatenate([unplanes(x, "<u4") for x in group["b"].to_pylist()])).astype(np.int64)
    own = total[words != START]
    stats = [*np.bincount(own[own <= K + 1], minlength=K + 2)[1:].tolist(), int((own > 0).sum()), int(own.sum())]
    cut = np.concatenate([[0], np.cumsum([len(x) for x in blobs])])
    part = group["part"][0].as_py()
    return back([(name, 1, part, planes(total[where[a:b]], "<u8"), None, None if k else stats) for k, (name, a, b) in enumerate(zip(group["block"].to_pylist(), cut, cut[1:]))])


def send_pairs(left: pa.Table, right: pa.Table, word_parts: int, parts: int) -> pa.Table:
    out = []
    for row in left.to_pylist():
        block = Block(row)
        counts = block.counts([r for r in right.to_pylist() if r["block"] == block.name], word_parts)
        block.pairs(counts, parts)
        entries = np.searchsorted(block.entry_part, np.arange(parts + 1))
        sorted_entry = block.entry[block.order]
        at = np.searchsorted(sorted_entry, entries)
        rows = []
        for p in range(parts):
            a, b, x, y = entries[p], entries[p + 1], at[p], at[p + 1]
            if b > a:
                own = block.order[x:y]
                size = np.bincount(sorted_entry[x:y] - a, minlength=b - a)
                w = block.w[own]
                next_words = block.words[w].tobytes()
                rows.append((p, [int(b - a), int(y - x)], block.words[block.entry_u[a:b]].tobytes() + planes(size, "<u4"), next_words, planes(block.pair_learned[own], "<u4"), planes(counts[w], "<u8")))
        out.append(sent(block.name, rows))
    return pa.Table.from_batches(out)


def sum_pairs(group: pa.Table, unigrams: Unigrams) -> pa.Table:
    """Of one pair partition: for each block, the corpus counts of its pairs; for each of its contexts, how many
    different pairs this partition has with each count up to K, the tokens of more frequent ones, and their words' mass."""
    rows = group.to_pylist()
    contexts = [np.frombuffer(r["a"], np.uint64, r["sizes"][0]) for r in rows]
    sizes = [unplanes(r["a"][8 * r["sizes"][0] :], "<u4").astype(np.int64) for r in rows]
    names, entry = np.unique(np.concatenate(contexts), return_inverse=True)
    u = np.repeat(entry, np.concatenate(sizes))
    words = np.frombuffer(b"".join(r["b"] for r in rows), np.uint64)
    key = mix64(names[u] * np.uint64(0x9E3779B97F4A7C15) + words) if len(u) else np.zeros(0, np.uint64)
    _, first, where = np.unique(key, return_index=True, return_inverse=True)
    total = np.bincount(where, np.concatenate([unplanes(r["c"], "<u4") for r in rows]), len(first)).astype(np.int64)
    own_u = u[first]
    mass = np.where(total > 0, unigrams.p(np.concatenate([unplanes(r["d"], "<u8") for r in rows])[first].astype(np.int64)), 0.0)
    small = np.zeros((K, len(names)), np.int64)
    for r in range(1, K + 1):
        small[r - 1] = np.bincount(own_u[total == r], minlength=len(names))
    large = np.bincount(own_u, np.where(total > K, total, 0), len(names)).astype(np.int64)
    unseen = np.bincount(own_u, mass, len(names))
    stats = np.bincount(total[total <= K + 1], minlength=K + 2)[1:].tolist()
    out, e, p = [], 0, 0
    for k, r in enumerate(rows):
        n_e, n_p = r["sizes"]
        of = entry[e : e + n_e]
        facts = b"".join([unseen[of].tobytes(), *(planes(small[i][of], "<u4") for i in range(K)), planes(large[of], "<u8")])
        out.append((r["block"], 2, r["part"], planes(total[where[p : p + n_p]], "<u8"), facts, None if k else stats))
        e, p = e + n_e, p + n_p
    return back(out)


def score_block(left: pa.Table, right: pa.Table, word_parts: int, parts: int, unigrams: Unigrams, d: np.ndarray) -> pa.Table:
    out = []
    for row in left.to_pylist():
        block = Block(row)
        rows = [r for r in right.to_pylist() if r["block"] == block.name]
        counts = block.counts(rows, word_parts)
        block.pairs(counts, parts)
        entries = np.searchsorted(block.entry_part, np.arange(parts + 1))
        at = np.searchsorted(block.entry[block.order], entries)
        seen = np.zeros(len(block.u), np.int64)
        facts = np.zeros((K + 2, len(block.entry_u)))
        for r in rows:
            if r["kind"] == 2:
                a, b = entries[r["part"]], entries[r["part"] + 1]
                seen[block.order[at[r["part"]] : at[r["part"] + 1]]] = unplanes(r["a"], "<u8")
                n = b - a
                facts[0, a:b] = np.frombuffer(r["b"], np.float64, n)
                for i in range(K):
                    facts[1 + i, a:b] = unplanes(r["b"][8 * n + 4 * n * i : 8 * n + 4 * n * (i + 1)], "<u4")
                facts[K + 1, a:b] = unplanes(r["b"][8 * n + 4 * n * K :], "<u8")
        unseen, *small, large = (np.bincount(block.entry_u, f, len(counts)) for f in facts)
        c = np.maximum(counts, 1).astype(np.float64)
        rare = sum(small) > 0
        scale = np.where(rare, 1.0, c / (c + 1))
        kept = sum(d[r] * r * small[r - 1] for r in range(1, K + 1)) + large
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.log10(np.maximum(1 - scale * kept / c, 1e-300)) - np.log10(np.maximum(1 - unseen, 1e-300))
            pair = np.log10(np.where(seen <= K, d[np.minimum(seen, K)], 1.0) * seen / c[block.u] * scale[block.u])
        alone = np.log10(unigrams.p(counts)) if unigrams.tokens else unigrams.base(counts)
        token, context = block.tokens[block.at], block.tokens[block.at - 1]
        value = alone[token] + np.where(counts[context] > 0, weight[context], 0.0)
        hit = seen[block.pair_of] > 0
        value[np.flatnonzero(block.known)[hit]] = pair[block.pair_of[hit]]
        first = block.start - np.arange(len(block.start))
        columns = [
            pa.array(block.doc_ids, pa.int64()), pa.array(block.held), pa.array(block.lengths - 1), pa.array(np.add.reduceat((counts[token] > 0).astype(np.int64), first)),
            pa.array(np.full(len(first), unigrams.tokens, np.int64)), pa.array(np.add.reduceat(unigrams.base(counts[token]), first)), pa.array(np.add.reduceat(value, first)),
        ]
        out.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
    return pa.Table.from_batches(out)


def summed(rows: DataFrame, n: int) -> np.ndarray:
    """Element-wise sums of ``stats``, of which each partition has one row."""
    found = rows.where(F.col("stats").isNotNull()).agg(*[F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(n)]).first()
    return np.array(found, np.int64)


def katz_scores(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, part_keys: int = PART_KEYS) -> DataFrame:
    blocks = bucketed(make_blocks(docs, block_tokens), "block", text_bytes(docs))
    sizes = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()
    word_parts, parts = 1 + sizes[0] // part_keys, 1 + sizes[1] // 4 // part_keys
    words = stored(send_words(blocks, word_parts).groupBy("part").applyInArrow(sum_words, BACK))
    unigrams = Unigrams(summed(words, K + 3))
    by_block = blocks.groupBy("block")
    pairs = by_block.cogroup(words.groupBy("block")).applyInArrow(lambda left, right: send_pairs(left, right, word_parts, parts), SENT)
    counted = stored(pairs.groupBy("part").applyInArrow(lambda group: sum_pairs(group, unigrams), BACK))
    d = discounts(summed(counted, K + 1))
    return by_block.cogroup(words.unionByName(counted).groupBy("block")).applyInArrow(lambda left, right: score_block(left, right, word_parts, parts, unigrams, d), SCORES)


def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op8_katz_scores": op8_katz_scores}
ORACLE: dict[str, str] = {}

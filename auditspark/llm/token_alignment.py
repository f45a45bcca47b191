r"""Alignment of two tokenizers' tokens over the bytes of each text, by products of sparse incidence matrices.

Tokenizer A is a byte-level BPE, B a piece BPE with byte fallback; both see a space and the text. Token-byte incidence
matrices A and B stand in compressed rows (``Csr``); the row products of Gustavson give A.B' whose entries are overlap
links: how many bytes a token of A shares with one of B. Bytes where tokens of both end cut a text into groups; the
product of the two id-group incidence matrices gives, for each pair of ids, how many pairs of their occurrences share a
group: the links.

(1) No token of either vocabulary spans a place where a space or line end follows another character, so tasks align each
distinct piece between such places once and keep it in a cache of at most ``CACHE`` pieces; a text's figures are sums
over its pieces. Where a piece's bytes are not its tokens' bytes, the whole text is encoded at once and compared. Tasks
also count the texts that hold each linked pair of ids, in tables of at most ``HELD`` pairs. (2) Spark sums these counts.
(3) The counts are looked up for each text by sorted search, in as many shards of at most ``SHARD`` pairs as there are;
a text's sums over shards are added up. The number of pairs is bounded by the vocabularies, not by the corpus.

Defined results: null and empty texts, and texts whose tokens' bytes differ from space and text, have no tokens: zeros
and an empty digest. Rows that repeat or share an id are texts of their own and count so. Special tokens' strings are
plain text. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.llm.common import planes, slices, stored, table, unplanes

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CACHE, HELD, SHARD = 500_000, 1 << 20, 1 << 21
#: Pieces that are encoded in one call.
CHUNK = 2000
SPACE = "▁"
FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]
ALIGNED = f"row long, doc_id long, {', '.join(f'{c} long' for c in FIGURES)}, groups_sha256 string, pairs binary, times binary, pair long, docs long"


@dataclass
class Csr:
    """A sparse matrix of integers in compressed rows: row i has columns ``indices[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of_entries(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> Csr:
        """Entries in any order; equal places are added up."""
        place = rows * shape[1] + columns
        order = np.argsort(place, kind="stable")
        place, values = place[order], values[order]
        first = np.flatnonzero(np.concatenate([place[:1] == place[:1], place[1:] != place[:-1]]))
        sums = np.add.reduceat(values, first) if len(first) else values
        starts = np.concatenate([[0], np.cumsum(np.bincount(place[first] // shape[1], minlength=shape[0]))])
        return cls(starts, place[first] % shape[1], sums, shape[1])

    @classmethod
    def of_spans(cls, sizes: np.ndarray) -> Csr:
        """Rows of ones that cover columns one after another."""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return cls(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.width))])
        return Csr(starts, self.rows()[order], self.values[order], len(self.starts) - 1)

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: each entry (i, k) adds its multiple of the other's row k to row i."""
        begin, size = other.starts[self.indices], np.diff(other.starts)[self.indices]
        ends = np.cumsum(size)
        at = np.repeat(begin - (ends - size), size) + np.arange(int(size.sum()))
        values = np.repeat(self.values, size) * other.values[at]
        return Csr.of_entries(np.repeat(self.rows(), size), other.indices[at], values, (len(self.starts) - 1, other.width))


@dataclass
class Alignment:
    """Of some texts: figures (text, FIGURES), groups as text, and links: pairs ``pairs[starts[i]:starts[i + 1]]``."""

    figures: np.ndarray
    groups: list[bytes]
    starts: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def byte_of() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    def __init__(self, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> None:
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(byte_bpe))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe))
        byte, vocabulary = byte_of(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_end = vocabulary[next(c for c, b in byte.items() if b == 10)]
        self.b_end, self.b_space = self.b.piece_to_id("<0x0A>"), self.b.piece_to_id(SPACE)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.good = np.zeros(1024, bool)
        self.figures = np.zeros((1024, len(FIGURES)), np.int64)
        self.starts = np.zeros(1025, np.int64)
        self.pairs, self.times = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def b_of(self, piece: str) -> list[int]:
        """Ids by B of a piece that begins with a space or a line end; B itself puts a space before what it is given."""
        if piece == " ":
            return [self.b_space]
        return self.b.encode(piece[1:]) if piece[0] == " " else self.b.encode("a" + piece)[1:]

    def align(self, a: list[list[int]], b: list[list[int]]) -> Alignment:
        """Of texts whose tokens' bytes are equal."""
        n = len(a)
        item, ids, sizes = [], [], []
        for found, size in ((a, self.a_size), (b, self.b_size)):
            item.append(np.repeat(np.arange(n), np.fromiter(map(len, found), np.int64, n)))
            ids.append(np.fromiter(chain.from_iterable(found), np.int64, len(item[-1])))
            sizes.append(size[ids[-1]])
        overlap = Csr.of_spans(sizes[0]).times(Csr.of_spans(sizes[1]).transposed())
        ends = [np.cumsum(s) for s in sizes]
        both = np.intersect1d(*ends, assume_unique=True)
        groups = [np.searchsorted(both, e) for e in ends]
        parts = []
        for k, size in enumerate((len(self.a_size), len(self.b_size))):
            known, row = np.unique(item[k] * size + ids[k], return_inverse=True)
            parts.append((known, size, Csr.of_entries(row, groups[k], np.ones(len(row), np.int64), (len(known), len(both)))))
        (a_known, a_size, a_in), (b_known, b_size, b_in) = parts
        links = a_in.times(b_in.transposed())
        row = links.rows()
        pairs = a_known[row] % a_size * b_size + b_known[links.indices] % b_size
        of = a_known[row] // a_size
        starts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
        last = np.searchsorted(ends[0], both)
        counts = [np.bincount(x, minlength=n) for x in (item[0], item[1], item[0][last])]
        n_links = np.bincount(of, links.values, n).astype(np.int64)
        figures = np.stack([*counts, n_links, np.bincount(item[0][overlap.rows()], minlength=n)], axis=1)
        return Alignment(figures, self.texts(ids, [last, np.searchsorted(ends[1], both)], counts[2]), starts, pairs, links.values)

    @staticmethod
    def texts(ids: list[np.ndarray], last: list[np.ndarray], counts: np.ndarray) -> list[bytes]:
        """The groups of each text: ``a1,a2|b1;a3|b2``. ``last``: the last token of each group, by A and by B."""
        words = [list(map(str, i.tolist())) for i in ids]
        cuts = [[0, *(x + 1).tolist()] for x in last]
        groups = [",".join(words[0][i:j]) + "|" + ",".join(words[1][k:m]) for i, j, k, m in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:])]
        ends = np.cumsum(counts).tolist()
        return [";".join(groups[i:j]).encode() for i, j in zip([0, *ends], ends)]

    def equal(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = text.encode()
        return b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw

    def add(self, keys: list[str]) -> None:
        """Encode and align new pieces. Pieces of one word, many in one text, stand in lines there."""
        words = [k for k in keys if len(s := k.split()) == 1 and s[0] == k]
        others = list(set(keys).difference(words))
        for at in range(0, len(words), CHUNK):
            some = words[at : at + CHUNK]
            text = "\n ".join(some)
            a = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids)
            b = np.array(self.b.encode(text))
            cut = [np.flatnonzero(ids == end) for ids, end in ((a, self.a_end), (b, self.b_end))]
            assert len(cut[0]) == len(cut[1]) == len(some) - 1
            found = [[own.tolist() for own in np.split(np.delete(ids, c), c - np.arange(len(c)))] for ids, c in zip((a, b), cut)]
            self.store(some, [" " + k for k in some], *found)
        for at in range(0, len(others), CHUNK):
            some = others[at : at + CHUNK]
            pieces = [k[1:] if k[0] == "\0" else k if k[0] == "\n" else " " + k for k in some]
            a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
            self.store(some, pieces, a, list(map(self.b_of, pieces)))

    def store(self, keys: list[str], pieces: list[str], a: list[list[int]], b: list[list[int]]) -> None:
        good = [self.equal(*x) for x in zip(pieces, a, b)]
        found = self.align([x if g else [] for x, g in zip(a, good)], [x if g else [] for x, g in zip(b, good)])
        first, used = len(self.groups), self.starts[len(self.groups)]
        end, links = first + len(keys), used + len(found.pairs)
        while end >= len(self.good):
            self.good = np.concatenate([self.good, np.zeros_like(self.good)])
            self.figures = np.concatenate([self.figures, np.zeros_like(self.figures)])
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while links > len(self.pairs):
            self.pairs, self.times = (np.concatenate([x, np.zeros_like(x)]) for x in (self.pairs, self.times))
        self.good[first:end], self.figures[first:end] = good, found.figures
        self.starts[first + 1 : end + 1] = used + found.starts[1:]
        self.pairs[used:links], self.times[used:links] = found.pairs, found.times
        self.groups += found.groups
        self.number.update(zip(keys, range(first, end)))

    @staticmethod
    def careful_keys(text: str) -> list[str]:
        """Keys of larger pieces where white space meets white space; ``text`` begins with the space."""
        pieces: list[str] = []
        for part in text.replace("\n", " \n").split(" ")[1:]:
            part = part if part[:1] == "\n" and pieces else " " + part
            if pieces and pieces[-1][-1].isspace():
                pieces[-1] += part
            else:
                pieces.append(part)
        return [p[1:] if len(s := p.split()) == 1 and " " + s[0] == p else p if p[0] == "\n" and not p[-1].isspace() else "\0" + p for p in pieces]

    def whole(self, text: str) -> Alignment:
        """One text at once, for those that have a piece whose tokens have other bytes."""
        ids = [self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)]
        return self.align(*([x] if self.equal(" " + text, *ids) else [[]] for x in ids))

    def aligned(self, texts: list[str]) -> Alignment:
        """The texts' figures, groups and links; the links of a text are sorted by pair."""
        if len(self.number) > CACHE:
            self.clear()
        keys = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        new = {k for own in keys for k in own if k not in self.number}
        if odd := {k for k in new if not k or k[-1].isspace() or "\0" in k}:
            for i, own in enumerate(keys):
                if not odd.isdisjoint(own):
                    keys[i] = self.careful_keys(" " + texts[i])
            new = {k for own in keys for k in own if k not in self.number}
        if new:
            self.add(list(new))
        count = np.fromiter(map(len, keys), np.int64, len(keys))
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(keys)), np.int64, int(count.sum()))
        doc = np.repeat(np.arange(len(keys)), count)
        bad = {i: self.whole(texts[i]) for i in np.unique(doc[~self.good[flat]]).tolist()}
        if bad:
            kept = ~np.isin(doc, list(bad))
            doc, flat, count = doc[kept], flat[kept], np.bincount(doc[kept], minlength=len(keys))
        figures = np.zeros((len(keys), len(FIGURES)), np.int64)
        for k in range(len(FIGURES)):
            figures[:, k] = np.bincount(doc, self.figures[flat, k], len(keys))
        ends, numbers = np.cumsum(count).tolist(), flat.tolist()
        groups = [b";".join(map(self.groups.__getitem__, numbers[i:j])) for i, j in zip([0, *ends], ends)]
        begin, size = self.starts[flat], self.starts[flat + 1] - self.starts[flat]
        stop = np.cumsum(size)
        at = np.repeat(begin - (stop - size), size) + np.arange(int(size.sum()))
        doc, pairs, times = np.repeat(doc, size), self.pairs[at], self.times[at]
        for i, own in bad.items():
            figures[i], groups[i] = own.figures[0], own.groups[0]
            doc, pairs, times = (np.concatenate(x) for x in ((doc, np.full(len(own.pairs), i)), (pairs, own.pairs), (times, own.times)))
        links = Csr.of_entries(doc, pairs, times, (len(keys), len(self.a_size) * len(self.b_size)))
        return Alignment(figures, groups, links.starts, links.indices, links.values)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    if (byte_bpe, piece_bpe) not in _aligners:
        _aligners[byte_bpe, piece_bpe] = Aligner(byte_bpe, piece_bpe)
    return _aligners[byte_bpe, piece_bpe]


def added(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One table of distinct pairs and sums of their counts."""
    pairs, at = np.unique(np.concatenate([p for p, _ in tables]), return_inverse=True)
    return pairs, np.bincount(at, np.concatenate([n for _, n in tables]), len(pairs)).astype(np.int64)


def align_texts(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """A row for each document, its links in ``pairs`` (as steps) and ``times``; and rows with ``pair`` and ``docs`` that
    count the documents of a part of a task which hold the pair, and nothing else."""
    names = [c.strip().split()[0] for c in ALIGNED.split(",")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in ALIGNED.split(",")]

    def row_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in zip(names, kinds)], names=names)

    def counted(held: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(held[0]), 1 << 16):
            pairs, n = (x[at : at + (1 << 16)] for x in held)
            yield row_of(len(pairs), pair=pa.array(pairs), docs=pa.array(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, row = aligner(byte_bpe, piece_bpe), TaskContext.get().partitionId() << 40
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in slices(batches, 256):
            found = tool.aligned([t or "" for t in batch.column(1).to_pylist()])
            places = list(zip(found.starts[:-1].tolist(), found.starts[1:].tolist()))
            columns = {c: pa.array(found.figures[:, k]) for k, c in enumerate(FIGURES)}
            yield row_of(
                batch.num_rows,
                **columns,
                row=pa.array(np.arange(row, row + batch.num_rows)),
                doc_id=batch.column(0),
                groups_sha256=pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in found.groups], pa.string()),
                pairs=pa.array([planes(np.diff(found.pairs[i:j], prepend=0), "<u8") for i, j in places], pa.binary()),
                times=pa.array([planes(found.times[i:j], "<u8") for i, j in places], pa.binary()),
            )
            row += batch.num_rows
            if len(found.pairs):
                waiting.append(np.unique(found.pairs, return_counts=True))
                size += len(waiting[-1][0])
            if size > HELD:
                waiting = [added(waiting)]
                size = len(waiting[0][0])
                if size > HELD // 2:
                    yield from counted(waiting[0])
                    waiting, size = [], 0
        if waiting:
            yield from counted(added(waiting))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """pair, docs and best of every linked pair of ids: the documents that hold it, and whether no pair of its A id has more."""
    counts = aligned.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("docs").alias("docs"))
    own = Window.partitionBy(F.expr(f"pair div {b_size}"))  # at most a row for each id of B
    return counts.select("pair", "docs", (F.col("docs") == F.max("docs").over(own)).alias("best"))


def looked_up(aligned: DataFrame, counts: DataFrame, shards: int, shard: int) -> DataFrame:
    """row, n_best and count_sum of every document over the pairs of one shard."""
    rows = counts.where(F.pmod(F.xxhash64("pair"), F.lit(shards)) == shard).orderBy("pair").toArrow()  # about SHARD at most
    sent = counts.sparkSession.sparkContext.broadcast([rows.column(c).to_numpy() for c in ("pair", "docs", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = sent.value
        for batch in slices(batches):
            steps = [unplanes(x, "<u8") for x in batch.column(1).to_pylist()]
            times = np.concatenate([unplanes(x, "<u8") for x in batch.column(2).to_pylist()]).astype(np.int64)
            doc = np.repeat(np.arange(len(steps)), [len(x) for x in steps])
            pairs = np.concatenate([np.cumsum(x) for x in steps]).astype(np.int64)
            at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
            mine = np.flatnonzero(known[at] == pairs) if len(known) else np.zeros(0, np.int64)
            doc, times, at = doc[mine], times[mine], at[mine]
            sums = np.zeros((2, len(steps)), np.int64)
            np.add.at(sums[0], doc, times * best[at])
            np.add.at(sums[1], doc, times * docs[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], names=["row", "n_best", "count_sum"])

    return aligned.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long")


def token_links(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(1) doc_id, figures, digest of groups, n_best and count_sum of every document; (2) a_id, b_id, docs and best of
    every linked pair of ids."""
    aligned = stored(align_texts(docs, byte_bpe, piece_bpe))
    b_size = len(aligner(byte_bpe, piece_bpe).b_size)
    counts = stored(pair_counts(aligned, b_size))
    own = aligned.where(F.col("pair").isNull())
    shards = max(1, -(-counts.count() // shard))
    parts = [looked_up(own, counts, shards, k) for k in range(shards)]
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.union(part)
    sums = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")))
    rows = own.select("row", "doc_id", *FIGURES, "groups_sha256").join(sums, "row").drop("row")
    pairs = counts.select(F.expr(f"pair div {b_size}").alias("a_id"), F.expr(f"pair % {b_size}").alias("b_id"), "docs", "best")
    return rows, pairs


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links(table(spark, sf_dir, "documents"))[0]


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLE: dict[str, str] = {}

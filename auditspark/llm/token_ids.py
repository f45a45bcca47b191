"""Token ids in binary shards: frequency-ranked ids, byte-aligned variable-length coding, separate control bytes.

Three passes. (1) Tasks encode texts with a public tokenizer, end id appended, store the ids and count them. (2) The counts
are summed; an id's rank by count is its code, so frequent ids take one byte. The table of ranks has one
row for each id of the vocabulary. (3) The stored ids are sorted by doc_id into shards and coded block by block.

File format: Parquet shards in ascending doc_id order, one row for each block of documents: ``shard``, ``block``,
``doc_ids``, ``lengths`` (ids of each document), ``control`` and ``data``. ``control`` holds two bits for each id, four ids
to a byte, low bits first: the number of data bytes less one; ``data`` holds the ranks, little-endian, in that many
bytes. A second table, ``ranks``, lists the ids by rank. Decoding looks control bytes up in numpy tables.

The tokenizer splits words independently before white space that follows other characters, so tasks encode each distinct
piece once and keep its ids in a cache of at most ``CACHE`` pieces for the life of the worker. Texts are taken ``TEXT_BYTES``
at a time; Arrow numbers the distinct pieces among them, and only these are looked up in the cache.

Defined results: null and empty texts give the end id alone; equal doc_ids stand in the order of their ids' digest;
null doc_ids come first; an empty table gives empty shards and an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.llm.common import discard, shared_folder, slices, stored, table

TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Ids of a block, about; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
CACHE = 2_500_000
#: Bytes of texts that are encoded together, about, beside one longer text at most.
TEXT_BYTES = 1 << 22

ENCODED = "doc_id long, n long, crc long, ids binary, counts binary"
SHARD = "shard int, block long, doc_ids array<long>, lengths array<long>, control binary, data binary"


class Encoder:
    """Ids of whole texts, encoded piece by piece with a cache.

    A text is cut before each space or line end that follows another character; the tokenizer never joins the two. A
    piece has as its key the part after its space, or the part from its line end on; keys of texts' first parts begin
    with FIRST, and those of pieces that hold other white space with WHOLE, which no part can. Punctuation that ends a
    part is kept apart, by keys that begin with TAIL."""

    FIRST, WHOLE, TAIL = "\n\n", "\n\n\n", "\n "

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        inside = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.tails = "".join(c for c in string.punctuation if c != "'" and c not in inside)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.start = np.zeros(1 << 18, np.int64)
        self.used = 0

    @classmethod
    def keys(cls, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Keys that hold if every part ends with another character than white space, and how many each text has."""
        kind, sizes = pa.large_string(), np.zeros(len(texts), np.int64)
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        lines = pc.replace_substring(texts.filter(some).cast(kind), "\n", " \n")
        parts = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(cls.FIRST, kind), lines, pa.scalar("", kind)), " ")
        sizes[some.to_numpy(zero_copy_only=False)] = pc.list_value_length(parts).to_numpy()
        return parts.flatten(), sizes

    @classmethod
    def careful_keys(cls, text: str) -> list[str]:
        """Keys of larger pieces where white space meets white space."""
        pieces: list[str] = []
        for i, part in enumerate(text.replace("\n", " \n").split(" ")):
            part = part if not i or part[:1] == "\n" else " " + part
            if pieces and (not pieces[-1] or pieces[-1][-1].isspace()):
                pieces[-1] += part
            else:
                pieces.append(part)
        return [cls.WHOLE + p for p in pieces]

    def text_of(self, key: str) -> str:
        return key[3:] if key.startswith(self.WHOLE) else key[2:] if key.startswith(self.FIRST) else key if key[0] == "\n" else " " + key

    def _add_parts(self, keys: list[str], before: str) -> None:
        """Keys of single words, many in one text, a line each: a line end is a token of its own there. ``before`` stands
        between a line end and a word: a space, or nothing where the keys hold their own line ends."""
        skip = int(not before)
        for at in range(0, len(keys), 4000):
            some = keys[at : at + 4000]
            if len(self.line_end) != 1:
                self._add_others(some)
                continue
            words = [k[skip:] for k in some]
            text = ("\n" + before) + ("\n" + before).join(words)
            if text.split() != words:
                self._add_others([k for k, w in zip(some, words) if w.split() != [w]])
                some = [k for k, w in zip(some, words) if w.split() == [w]]
                if not some:
                    continue
                text = ("\n" + before) + ("\n" + before).join(k[skip:] for k in some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.line_end[0])
            assert len(cut) == len(some) and not cut[0]
            sizes = np.diff(np.append(cut, len(ids)))
            self._store(some, *((sizes, ids) if skip else (sizes - 1, np.delete(ids, cut))))

    def _add_others(self, keys: list[str]) -> None:
        if keys:
            texts = [k[2:] if k.startswith(self.TAIL) else self.text_of(k) for k in keys]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._store(keys, sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))

    def add(self, new: list[str]) -> None:
        """Encode new keys, each given once. Punctuation after a letter begins tokens of its own, so a part that ends with it
        takes the ids of the rest and of the punctuation."""
        number, tails, double = self.number, self.tails, self.FIRST
        ended = [(k, w) for k in new if k[-1] in tails and k[:2] != double and (w := k.rstrip(tails))[-1:].isalpha()]
        apart = {k for k, _ in ended}
        parts = [k for k in new if k[-1] not in tails or k not in apart]
        parts += {w for _, w in ended if w not in number}.difference(parts)
        self._add_parts([k for k in parts if k[0] != "\n"], " ")
        lines = [k for k in parts if k[0] == "\n"]
        self._add_parts([k for k in lines if k[:2] != double], "")
        self._add_others([k for k in lines if k[:2] == double])
        if ended:
            marks = [self.TAIL + k[len(w) :] for k, w in ended]
            self._add_others([m for m in set(marks) if m not in number])
            at = np.array([(number[w], number[m]) for (_, w), m in zip(ended, marks)], np.int64).reshape(-1)
            self._store([k for k, _ in ended], *self._ids_of(at, 2))

    def _ids_of(self, at: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
        """How many ids every ``each`` entries have together, and the ids."""
        begin = self.start[at]
        size = self.start[at + 1] - begin
        begin -= np.cumsum(size) - size
        index = np.repeat(begin, size)
        index += np.arange(len(index))
        return size.reshape(-1, each).sum(axis=1), self.ids[index]

    def _store(self, keys: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        first = len(self.number)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(keys) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[first + 1 : first + len(keys) + 1] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.number.update(zip(keys, range(first, first + len(keys))))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.number) > CACHE:
            self.clear()
        flat, sizes = self._numbers_of(texts)
        per_key, ids = self._ids_of(flat, 1)
        total = np.concatenate([[0], np.cumsum(per_key)])
        return np.split(ids, total[np.cumsum(sizes)[:-1]])

    def _numbers_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all keys of the texts, and how many each text has. A key that stands at several places is looked
        up once."""
        keys, sizes = self.keys(texts)
        ends, numbered = np.cumsum(sizes), keys.dictionary_encode()
        which, distinct = numbered.indices.to_numpy(), numbered.dictionary.to_pylist()
        at = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(at < 0)
        larger: dict[int, list[str]] = {}
        if odd := [i for i in unknown.tolist() if not (k := distinct[i]) or k[-1].isspace()]:
            is_odd = np.zeros(len(distinct), bool)
            is_odd[odd] = True
            rows = np.unique(np.searchsorted(ends, np.flatnonzero(is_odd[which]), side="right")).tolist()
            larger = {i: self.careful_keys(texts[i].as_py()) for i in rows}
            plain = np.ones(len(sizes), bool)
            plain[rows] = False
            used = np.zeros(len(distinct), bool)
            used[which[np.repeat(plain, sizes)]] = True
            unknown = unknown[used[unknown]]
        new = [distinct[i] for i in unknown.tolist()]
        self.add(new + list({k for some in larger.values() for k in some if k not in self.number}))
        at[unknown] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        flat = at[which]
        if larger:
            pieces, done = [], 0
            for i, some in larger.items():
                pieces += [flat[done : ends[i] - sizes[i]], np.array([self.number[k] for k in some], np.int64)]
                done, sizes[i] = ends[i], len(some)
            flat = np.concatenate([*pieces, flat[done:]])
        return flat, sizes


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def by_bytes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of less than ``most`` bytes of texts, beside the first of a slice."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cut = np.flatnonzero(np.diff(ends // most)) + 1 if len(ends) else []
        for a, b in zip([0, *cut], [*cut, len(ends)]):
            if b > a:
                yield batch.slice(a, b - a)


def encode_texts(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """A row for each document; and one for each task with ``counts``, how often it made each id, and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, total = encoder(tokenizer), np.zeros(0, np.int64)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        for batch in by_bytes(batches, TEXT_BYTES):
            found = [np.append(x, np.uint32(end)) for x in tool.encode(batch.column(1))]
            count = np.bincount(np.concatenate(found), minlength=len(total))
            count[: len(total)] += total
            total = count
            blobs = [x.astype("<u4").tobytes() for x in found]
            columns = (batch.column(0).to_pylist(), map(len, found), map(zlib.crc32, blobs), map(packed, found), repeat(None, len(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n", "crc", "ids", "counts"])
        last = (None, None, None, None, total.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(last, kinds)], names=["doc_id", "n", "crc", "ids", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def packed(ids: np.ndarray) -> bytes:
    """Stored between passes: two bytes an id where all fit, with a leading mark."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return (b"\x04" if wide else b"\x02") + ids.astype("<u4" if wide else "<u2").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if blob[0] == 4 else "<u2", offset=1).astype(np.uint32)


def id_counts(encoded: DataFrame) -> DataFrame:
    """id, n: one row for each id that occurs, at most the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                count = np.frombuffer(blob, "<i8")
                total = np.concatenate([total, np.zeros(max(0, len(count) - len(total)), np.int64)])
                total[: len(count)] += count
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return encoded.where(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of some ranks."""
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    used = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[used].tobytes()


#: For each control byte: the sizes of its four values.
SIZES = np.stack([(np.arange(256) >> shift & 3) + 1 for shift in (0, 2, 4, 6)], axis=1)
#: For each size: the mask of the value's bytes in a 32-bit word.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again, by looking up the sizes of each control byte."""
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    word = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        if (longer := np.flatnonzero(size > k)).size:
            word[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return word & MASKS[size]


def write_shards(encoded: DataFrame, ranks: list[int], path: str, block_ids: int = BLOCK_IDS) -> None:
    """Write the shards of ``encoded``, in ascending doc_id order, below ``path``."""
    spark = encoded.sparkSession
    rank_of = np.zeros(max(ranks, default=0) + 1, np.uint32)
    rank_of[np.array(ranks, np.int64)] = np.arange(len(ranks), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rank_of, block = TaskContext.get().partitionId(), sent.value, 0
        docs: list = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            control, data = encode_block(rank_of[np.concatenate(parts)])
            columns = [[shard], [block], [docs], [[len(p) for p in parts]], [control], [data]]
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "block", "doc_ids", "lengths", "control", "data"])

        held = 0
        for batch in slices(batches):
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = unpacked(blob)
                if parts and held + len(ids) > block_ids:
                    yield flush()
                    docs, parts, held, block = [], [], 0, block + 1
                docs.append(doc)
                parts.append(ids)
                held += len(ids)
        if parts:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("crc"), F.col("n")]  # rows without an id are dealt over shards by the rest
    ordered = encoded.where(F.col("counts").isNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("doc_id", "ids").mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(f"{path}/shards")
    spark.createDataFrame([(i, r) for r, i in enumerate(ranks)], "id long, rank long").coalesce(1).write.parquet(f"{path}/ranks")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, decoded from the files; ``start`` counts all ids of earlier documents."""
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # one row for each id of the vocabulary
    sent = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], np.uint32))
    sizes = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = shards.groupBy("shard").agg(F.sum(sizes).alias("n")).orderBy("shard").collect()  # one row for each shard file
    before, sums = {}, 0
    for r in totals:
        before[r["shard"]] = sums
        sums += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = sent.value
        for batch in slices(batches, 8):
            for row in batch.to_pylist():
                sizes = np.array(row["lengths"], np.int64)
                ids = id_of[decode_block(row["control"], row["data"], int(sizes.sum()))].astype("<u4")
                ends = np.cumsum(sizes)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = shards.select("shard", "block", sizes.alias("n")).withColumn("inner", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    offsets = spark.createDataFrame(list(before.items()), "shard int, outer long")
    placed = inner.join(F.broadcast(offsets), "shard").select("shard", "block", (F.col("inner") + F.col("outer")).alias("before"))
    return shards.join(placed, ["shard", "block"]).select("doc_ids", "lengths", "control", "data", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> str:
    """Encode and write ``docs``; returns the folder of the shards."""
    path = shared_folder(docs.sparkSession)
    encoded = stored(encode_texts(docs, tokenizer, end))
    counts = id_counts(encoded).orderBy(F.col("n").desc(), "id").collect()  # at most the vocabulary
    write_shards(encoded, [r["id"] for r in counts], path)
    discard(encoded)
    return path


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(spark, tokenize(table(spark, sf_dir, "documents")))


QUERIES = {"op1_token_ids": op1_token_ids}
ORACLE: dict[str, str] = {}

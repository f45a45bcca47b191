"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts' word pattern ``[^\x20\x09-\x0D]+``; the same bytes that ``bytes.split()`` splits at.
SPACE = b" \t\n\x0b\x0c\r"
#: Upper case A-Z becomes lower case; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and each byte outside ``[0-9A-Za-z\x80-\xFF]`` becomes a space.
ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Rows of one Arrow batch that are handled together.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors can read: below ``spark.checkpoint.dir``, or below a local folder where that setting is
    absent and the session is local, as in tests. On a cluster a local folder would be another one on each machine, and
    reads would miss rows without an error, so there the setting is asked for."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can read")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root}/{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def raw_text(name: str = "text") -> Column:
    """The text's UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def crc32_of(name: str = "doc_id") -> Column:
    """CRC-32 of the id as text."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


def crc32_ids(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) if i is not None else 0 for i in ids], dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def planes(x: np.ndarray, kind: str) -> bytes:
    """The bytes of ``x``, all lowest bytes first: what is mostly zero compresses away."""
    x = x.astype(kind)
    return x.view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T.tobytes()


def unplanes(blob: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, total: int, longest: int, allowed: Column | None = None) -> DataFrame:
    """doc_id, text, good: a bounded sample of labelled texts. Of each class the first by a hash of the id, at most ``rows`` of
    them and ``total`` bytes together, among all documents that have a label and a text of 1 to ``longest`` bytes.

    Labels meet the documents' ids before anything is limited, so labels of other documents take no place. An id with
    both labels counts as good; of texts that share an id the least is taken."""
    usable = F.octet_length("text").between(1, longest)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (F.lit(True) if allowed is None else allowed))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("good"))
    sizes = docs.where(usable).select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("size"))
    known = marks.join(sizes, "doc_id").groupBy("doc_id", "good").agg(F.max("size").alias("size"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = [known.where(F.col("good") == k).orderBy(*order).limit(rows) for k in (0, 1)]
    running = F.sum("size").over(Window.partitionBy("good").orderBy(*order))
    chosen = F.broadcast(first[0].union(first[1]).withColumn("sum", running).where(F.col("sum") <= total).select("doc_id", "good"))
    texts = docs.where(usable).select(F.col("doc_id").cast("long").alias("doc_id"), raw_text()).join(chosen, "doc_id")
    return texts.groupBy("doc_id", "good").agg(F.min("text").alias("text")).select("doc_id", "text", "good")


#: Modules of this subpackage whose tokenizers keep pieces for the life of a Python worker, and where they keep them.
CACHES = (("token_ids", "_encoders"), ("token_alignment", "_aligners"))


def drop_caches() -> None:
    """Free what other operators have kept in this Python worker: a worker serves several jobs, and its memory is one."""
    for name, kept in CACHES:
        if module := sys.modules.get(f"{__package__}.{name}"):
            getattr(module, kept).clear()


#: Bytes of text of a bucket, about; buckets of a table at most (Spark's own limit).
BUCKET_BYTES, MOST_BUCKETS = 1 << 24, 100_000


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]


def bucketed(df: DataFrame, key: str, size: int, spread: bool = False) -> DataFrame:
    """``df``, ``size`` bytes of it, as a table in the shared warehouse, bucketed by ``key``: later groupings and joins by
    it move the other side only. With ``spread`` the rows are first moved to their buckets, for one file a bucket."""
    spark, name = df.sparkSession, f"blocks_{uuid.uuid4().hex}"
    buckets = min(MOST_BUCKETS, max(2 * spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)))
    rows = df.repartition(buckets, key) if spread else df
    rows.write.option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)

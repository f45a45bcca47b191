r"""Product codes of vectors with integer codebooks, nearest entries found by LAESA pivots.

Vectors become integers and are cut into ``PARTS`` equal parts, each part position with a codebook of its own. (1) A few
entries of each first codebook, far from each other, are its pivots for good; every part's distances to its pivots are
computed once and stored beside it. (2) In each round the entries' distances to the pivots are computed; by the
triangle inequality, the largest difference of the two distances to a pivot is a lower bound of the distance of part and
entry. A part's entries are evaluated exactly, in integers, in ascending order of their bounds, until the next bound is
over the least distance found: no entry that could be as near is left out. (3) Tasks add up the parts of each entry and
send a row for each component of a codebook, so a round moves nothing else.

Defined results: vectors that are null or hold null or non-finite components give no row. Vectors of different lengths,
or of lengths that 16 does not divide, are taken to end in zeros, up to the longest rounded up. Components beyond
``limit(width)`` (524288 for 64 components) count as that bound, so that all distances fit in 64 bits; sums over a label
that do not are null. Rows that share an id are rows of their own; where they compete for the first codebook, the lesser
vector comes first; null ids come last. With fewer than 64 vectors the codebooks have as many entries; with none there
are no rows. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import discard, slices, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
PIVOTS = 4
BATCH = 2048
#: Single-precision distances are off by less than this part of them.
LOOSE = np.float32(1e-6)
SUMS = "part int, entry int, at int, total long, n long"


def limit(width: int) -> int:
    """The largest absolute component with which squared distances of whole vectors fit in 62 bits."""
    return 1 << (62 - max(0, width - 1).bit_length()) // 2 - 1


def finite(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector has components only that are finite numbers, as doubles."""
    rows = vectors.withColumn(vector, F.col(vector).cast("array<double>"))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(vector).isNotNull() & good)


def integers(column: pa.ListArray, width: int) -> np.ndarray:
    """floor(256 * x) of each component, a row for each vector, padded with zeros to ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.clip(values, -limit(width), limit(width)).astype(np.int64)
    return out


def choose_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Of each part position's entries some far from each other: the first, then always the farthest from those chosen."""
    out = []
    for own in entries:
        chosen = [0]
        least = ((own - own[0]) ** 2).sum(axis=1)
        while len(chosen) < min(count, len(own)):
            chosen.append(int(least.argmax()))
            least = np.minimum(least, ((own - own[chosen[-1]]) ** 2).sum(axis=1))
        out.append(own[chosen])
    return np.stack(out)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A row for each point: its distances to the pivots."""
    squares = np.stack([((points - p) ** 2).sum(axis=1) for p in pivots], axis=1)
    return np.sqrt(squares.astype(np.float64)).astype(np.float32)


def nearest(points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, from_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry (the first of several) and the squared distance, exact."""
    bound = np.zeros((len(points), len(entries)), np.float32)
    for mine, theirs in zip(to_pivots.T, from_pivots.T):
        np.maximum(bound, np.abs(mine[:, None] - theirs), out=bound)
    bound -= LOOSE * (to_pivots.max(axis=1, initial=0) + from_pivots.max(initial=0))[:, None]
    np.maximum(bound, 0, out=bound)
    bound *= bound
    bound *= 1 - LOOSE
    best = np.full(len(points), np.iinfo(np.int64).max)
    at = np.zeros(len(points), np.int64)
    rows, left = np.arange(len(points)), bound
    while len(rows):
        entry = left.argmin(axis=1)
        open_ = left[np.arange(len(rows)), entry] <= best[rows]
        if not open_.all():
            rows, left, entry = rows[open_], left[open_], entry[open_]
        gap = points[rows] - entries[entry]
        found = np.einsum("ij,ij->i", gap, gap)
        nearer = (found < best[rows]) | ((found == best[rows]) & (entry < at[rows]))
        best[rows[nearer]], at[rows[nearer]] = found[nearer], entry[nearer]
        left[np.arange(len(rows)), entry] = np.inf
    return at, best


class Codebooks:
    """The codebooks of all part positions (part, entry, position) with their fixed pivots."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray) -> None:
        self.entries, self.pivots = entries, pivots
        self.from_pivots = np.stack([distances(e, p) for e, p in zip(entries, pivots)])

    def assign(self, points: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the vectors ``points`` (row, part, position) and their errors."""
        codes, error = np.zeros(points.shape[:2], np.int64), np.zeros(len(points), np.int64)
        for part in range(PARTS):
            own = np.ascontiguousarray(points[:, part])
            codes[:, part], found = nearest(own, to_pivots[:, part], self.entries[part], self.from_pivots[part])
            error += found
        return codes, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def cut(vectors: DataFrame, width: int, pivots: np.ndarray, label: str) -> DataFrame:
    """vec_id, label, parts and the parts' distances to their pivots, stored."""
    kind = vectors.schema[label].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH):
            whole = integers(batch.column(2), width)
            points = whole.reshape(len(whole), PARTS, -1)
            far = np.stack([distances(points[:, k], pivots[k]) for k in range(PARTS)], axis=1)
            blobs = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (whole.astype("<i4"), far.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *blobs], names=["vec_id", "label", "parts", "far"])

    rows = vectors.select("vec_id", F.col(label).alias("label"), "embedding")
    return stored(rows.mapInArrow(run, f"vec_id long, label {kind}, parts binary, far binary"))


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Parts (row, part, position) and their distances to pivots (row, part, pivot) of a stored batch."""
    parts, far = (b"".join(batch.column(c).to_pylist()) for c in ("parts", "far"))
    shape = (batch.num_rows, PARTS, -1)
    return np.frombuffer(parts, "<i4").reshape(shape).astype(np.int64), np.frombuffer(far, "<f4").reshape(shape)


def improved(cuts: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of the mean of its parts; unused ones stay."""
    sent = cuts.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        count, size = books.entries.shape[1:]
        total, n = np.zeros(books.entries.shape, np.int64), np.zeros((PARTS, count), np.int64)
        for batch in slices(batches, BATCH):
            points, far = unpacked(batch)
            codes, _ = books.assign(points, far)
            for part in range(PARTS):
                n[part] += np.bincount(codes[:, part], minlength=count)
                for at in range(size):  # sums of a batch are exact as doubles
                    total[part, :, at] += np.bincount(codes[:, part], points[:, part, at], count).astype(np.int64)
        part, entry = np.nonzero(n)
        used = [np.repeat(x, size) for x in (part, entry)]
        at = np.tile(np.arange(size), len(part))
        columns = [*(pa.array(x, pa.int32()) for x in (*used, at)), pa.array(total[*used, at]), pa.array(n[*used])]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "at", "total", "n"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")]
    sums = cuts.select("parts", "far").mapInArrow(run, SUMS).groupBy("part", "entry", "at").agg(*wide)
    entries = books.entries.copy()
    for r in sums.collect():  # a row for each component of the codebooks
        entries[r["part"], r["entry"], r["at"]] = int(r["total"]) // int(r["n"])
    return Codebooks(entries, books.pivots)


def coded(cuts: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    sent, kind = cuts.sparkSession.sparkContext.broadcast(books), cuts.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH):
            codes, error = sent.value.assign(*unpacked(batch))
            code = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            columns = [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return cuts.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def learn(vectors: DataFrame, label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks] | None:
    """The stored parts of ``vectors`` (vec_id, embedding, label; finite) and the codebooks learned on all of them; None
    where there is no vector."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    if not first:
        return None
    width = -(-max(1, vectors.agg(F.max(F.size("embedding")).alias("n")).first()["n"]) // PARTS) * PARTS
    start = integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), width)
    entries = np.ascontiguousarray(start.reshape(len(start), PARTS, -1).transpose(1, 0, 2))
    books = Codebooks(entries, choose_pivots(entries))
    cuts = cut(vectors, width, books.pivots, label)
    for _ in range(rounds):
        books = improved(cuts, books)
    return cuts, books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector of finite components."""
    kept = finite(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"))
    learned = learn(kept)
    if learned is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    cuts, books = learned
    rows = stored(coded(cuts, books))
    discard(cuts)
    sums = stored(rows.groupBy("label").agg(F.try_sum("error").alias("label_error")))
    same = rows["label"].eqNullSafe(sums["label"])
    return rows.join(sums, same).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _assigned(step: int) -> str:
    gap = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i])))"
    return f"""d{step} AS (SELECT id, label, part.p, x, j, {gap} AS d FROM part JOIN c{step} ON c{step}.p = part.p),
a{step} AS (SELECT id, any_value(label) AS label, p, any_value(x) AS x, arg_min(j, d * 64 + j) AS j, min(d) AS d FROM d{step} GROUP BY id, p)"""


def _moved(step: int) -> str:
    return f"""m{step} AS (SELECT p, j, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS v
  FROM a{step}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL),
c{step + 1} AS (SELECT c{step}.p, c{step}.j, coalesce(l, e) AS e FROM c{step}
  LEFT JOIN (SELECT p, j, list(v ORDER BY i) AS l FROM m{step} GROUP BY p, j) n ON n.p = c{step}.p AND n.j = c{step}.j)"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLE = {
    "op13_vector_codes": f"""
WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT id, label, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM kept, unnest(range(16)) AS t(p)),
c0 AS (SELECT p, id - 1 AS j, x AS e FROM part WHERE id <= 64),
{_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
coded AS (SELECT id, any_value(label) AS label, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a2 GROUP BY id),
digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, j)) AS s FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY coded.label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM coded JOIN kept USING (id), digest"""
}

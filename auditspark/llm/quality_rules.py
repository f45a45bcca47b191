r"""Quality rules: counts of words, symbols and repetition, and a trained n-gram model against a fixed threshold.

The model is a logistic regression over hashed word uni- and bigrams and character 3- to 5-grams, fitted on a
bounded, seeded sample of ``labels.quality`` rows and calibrated on the part of the sample that the fit did not see.
Documents are scored in Arrow batches; only the weights (``DIM`` doubles) are sent to the tasks.

Defined results: null or empty text counts as no words (so it fails the base rules); a null ``doc_id`` is carried
through; repeated rows give repeated results; an empty table gives an empty result; without usable labels of both
classes the model accepts every document and only the base rules decide. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import LOWER, SPACE, labelled, mix64, raw_text, slices, table

DIM = 1 << 17
#: Labelled rows and bytes of each class that the model is fitted on at most, and the longest text taken into the sample.
SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_BYTES = 1500, 6 << 20, 1 << 17
#: Steps of the fit; features that a step handles at a time.
STEPS, CHUNK = 60, 1 << 21
#: Documents whose calibrated probability of good quality is below this are rejected.
KEEP_AT = 0.3
SYMBOLS = b"#*$%&|<>"
NOT_COUNTED = SPACE + bytes(range(0x80, 0xC0))

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n = len(words)
    lines = text.split(b"\n")
    dup_lines = 0
    if len(lines) > 1:
        seen: dict[bytes, int] = {}
        for line in lines:
            if line in seen:
                dup_lines += bool(line.strip(SPACE))
            else:
                seen[line] = 1
    repeats = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        base = len(number)
        _, pair = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
        _, window, count = np.unique(pair[:-1] * base + ids[2:], return_inverse=True, return_counts=True)
        twice = count[window] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : shift + n - 2] |= twice
        repeats = int(covered.sum())
    return n, len(text.translate(None, NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), dup_lines, repeats


def hashed_features(text: bytes) -> np.ndarray:
    """Hash slots of all character 3- to 5-grams and of all words and word pairs of the lower-cased text."""
    if not text:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(b" " + text.translate(LOWER) + b" ", np.uint8)
    raw = np.where((raw >= 9) & (raw <= 13), np.uint8(32), raw).astype(np.uint64)
    grams = [raw]
    for n in range(1, 5):
        grams.append(grams[-1][:-1] * np.uint64(0x100000001B3) + raw[n:] if len(grams[-1]) > 1 else grams[-1][:0])
    out = [mix64(grams[n - 1] + np.uint64(n << 40)) for n in (3, 4, 5)]
    space = raw == 32
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if len(starts):
        ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        index = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))[np.maximum(np.arange(len(raw)) - starts[0], 0)]
        mixed = mix64(raw + (np.clip(index, 0, None).astype(np.uint64) << np.uint64(8)))
        mixed[space] = 0
        words = np.add.reduceat(mixed, starts)
        assert len(ends) == len(starts)
        out.append(mix64(words))
        out.append(mix64(words[:-1] * np.uint64(31) + words[1:]))
    return (np.concatenate(out) & np.uint64(DIM - 1)).astype(np.int64)


def vector_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text, and the roots of their shares."""
    slots = hashed_features(text)
    if len(slots) < DIM // 16:
        slot, count = np.unique(slots, return_counts=True)
    else:
        count = np.bincount(slots, minlength=DIM)
        slot = np.flatnonzero(count)
        count = count[slot]
    return slot, np.sqrt(count / max(1, len(slots)))


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, seed: int = 7, steps: int = STEPS) -> Model | None:
    """Fit on four fifths of the sample, calibrate on the rest; where either part lacks a class, as in a sample of few texts,
    both on all of it. None without both classes."""
    if not len(vectors) or good.min() == good.max():
        return None
    order = np.random.default_rng(seed).permutation(len(vectors))
    held = np.arange(len(vectors)) % 5 == 0
    if any(len(np.unique(good[order[part]])) < 2 for part in (held, ~held)):
        held[:] = False
    order = np.concatenate([order[~held], order[held]])
    n, good = int((~held).sum()), good[order].astype(np.float64)
    sizes = np.array([len(vectors[i][0]) for i in order])
    slot, value = (np.concatenate([vectors[i][k] for i in order]) for k in (0, 1))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    some = np.searchsorted(ends, np.arange(0, ends[-1], CHUNK), side="right") - 1
    cuts = np.unique(np.concatenate([some, [0, n, len(sizes)]])).tolist()

    def margins(weights: np.ndarray, rows: slice) -> np.ndarray:
        out = np.zeros(len(sizes))
        for a, b in zip(cuts, cuts[1:]):
            if rows.start <= a and b <= rows.stop:
                at = slice(ends[a], ends[b])
                total = np.concatenate([[0.0], np.cumsum(value[at] * weights[slot[at]], dtype=np.float64)])
                out[a:b] = total[ends[a + 1 : b + 1] - ends[a]] - total[ends[a:b] - ends[a]]
        return out

    share = max(1e-9, good[:n].mean())
    cost = np.where(good[:n] > 0, 0.5 / share, 0.5 / max(1e-9, 1 - share))
    cost /= max(1e-9, cost.sum())
    w, b0 = np.zeros(DIM), 0.0
    m, mb, s, sb = np.zeros(DIM), 0.0, np.zeros(DIM), 0.0
    for step in range(1, steps + 1):
        z = margins(w.astype(np.float32), slice(0, n))[:n] + b0
        g = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[:n])
        gw, gb = 1e-6 * w, g.sum()
        for a, b in zip(cuts, cuts[1:]):
            if b <= n:
                at = slice(ends[a], ends[b])
                gw += np.bincount(slot[at], value[at] * np.repeat(g[a:b], sizes[a:b]).astype(np.float32), DIM)
        m, mb, s, sb = 0.9 * m + 0.1 * gw, 0.9 * mb + 0.1 * gb, 0.99 * s + 0.01 * gw * gw, 0.99 * sb + 0.01 * gb * gb
        scale = 0.3 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w, b0 = w - scale * m / (np.sqrt(s) + 1e-8), b0 - scale * mb / (np.sqrt(sb) + 1e-8)
    rest = n if n < len(sizes) else 0
    z = margins(w.astype(np.float32), slice(rest, len(sizes))) + b0
    slope, shift = calibrate(z[rest:], good[rest:])
    return Model(w, b0, slope, shift)


def calibrate(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets, by Newton's method; the slope stays positive."""
    up, down = good.sum(), len(good) - good.sum()
    target = np.where(good > 0, (up + 1) / (up + 2), 1 / (down + 2))
    unit = max(1e-9, margin.std())
    x, a, b = margin / unit, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(d * x).sum() + 1e-3 * (a - 1), d.sum()])
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3) / unit, b


def margin_of(text: bytes, model: Model) -> float:
    slot, value = vector_of(text)
    return float((value * model.weights[slot]).sum() + model.bias)  # not a dot product, which may start threads in every task


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL, longest: int = SAMPLE_BYTES) -> Model | None:
    """Tasks hash the sample's texts to vectors; one task, whose input the sample's bound limits, fits the model; the
    driver gets its weights only."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            made = [vector_of(t) for t in batch.column(1).to_pylist()]
            blobs = (pa.array((v[k].astype(kind).tobytes() for v in made), pa.binary()) for k, kind in enumerate((np.int32, np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(made), np.int32)), batch.column(0), batch.column(2), *blobs], names=["fit", "doc_id", "good", "slots", "roots"])

    def fitted(group: pa.Table) -> pa.Table:
        order = np.argsort(group["doc_id"].to_numpy())
        slots, roots = group["slots"].to_pylist(), group["roots"].to_pylist()
        model = fit([(np.frombuffer(slots[i], np.int32), np.frombuffer(roots[i], np.float32)) for i in order], group["good"].to_numpy()[order])
        rows = [(model.weights.tobytes(), model.bias, model.slope, model.shift)] if model else []
        kinds = (pa.binary(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["weights", "bias", "slope", "shift"])

    vectors = labelled(docs, labels, "quality", rows, total, longest).mapInArrow(hashed, "fit int, doc_id long, good int, slots binary, roots binary")
    found = vectors.groupBy("fit").applyInArrow(fitted, "weights binary, bias double, slope double, shift double").collect()
    return Model(np.frombuffer(found[0]["weights"], np.float64), *found[0][1:]) if found else None


def score(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The counts, the model's probability and the verdict of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            counts = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            chance = model.probability(np.array([margin_of(t, model) for t in texts])) if model else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (chance >= keep_at)), pa.array(chance)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text()).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """``docs``, all columns, without the documents that the rules reject; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                n, _, _, _, repeats = base_counts(t := t or b"")
                bad = n < 50 or 100 * repeats > 50 * n
                keep.append(not bad and (model is None or bool(model.probability(np.array([margin_of(t, model)]))[0] >= keep_at)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE: dict[str, str] = {}

"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

Each text is cut into pieces of ``PIECE`` bytes; the whole text is compressed piece by piece with either dictionary.
The feature is the difference of the two compressed sizes over their sum, as a margin for the class whose dictionary
compresses better; a logistic map, fitted on labelled rows that the dictionaries were not built from, makes it a score.

The fit sees at most ``SAMPLE_ROWS`` rows and ``SAMPLE_TOTAL`` bytes of each class, of texts of at most ``SAMPLE_BYTES``,
chosen by a hash of the id among labelled documents whose crc32(doc_id as text) mod 5 is not 0. What is sent to the tasks is two dictionaries of at most
``DICTIONARY_BYTES`` and two numbers.

Defined results: null and empty texts score the share of good rows in the sample; without labels of both classes
every score is 0.5; a null id is not held out; repeated rows give repeated results; an empty table an empty result.
Only doc_id and text are read from the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import crc32_of, labelled, raw_text, slices, table
from auditspark.llm.quality_rules import calibrate

FOLDS = 5
#: Rows and bytes of a class that the fit sees at most, and the longest text that it may see.
SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_BYTES = 1500, 6 << 20, 1 << 17
DICTIONARY_BYTES, PIECE, LEVEL = 112_640, 1024, 1
PREDICT_AT = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Classifier:
    good: bytes
    bad: bytes
    slope: float
    shift: float
    prior: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(content)
            words.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def score(self, margin: float | None) -> float:
        if margin is None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def margin_of(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> float | None:
    """(size with the bad dictionary - size with the good one) / their sum; None for an empty text."""
    if not text:
        return None
    good, bad = (sum(len(c.compress(text[i : i + PIECE])) for i in range(0, len(text), PIECE)) for c in compressors)
    return (bad - good) / (bad + good)


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where the texts are too few to train on, their own content."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def fit(good: list[bytes], bad: list[bytes]) -> Classifier | None:
    """Dictionaries from two thirds of either class, the logistic map from the rest."""
    if min(len(good), len(bad)) < 3:
        return None
    model = Classifier(*(dictionary([t for i, t in enumerate(x) if i % 3]) for x in (good, bad)), 1.0, 0.0, len(good) / (len(good) + len(bad)))
    tools = model.compressors()
    margins = np.array([margin_of(t, tools) for x in (good, bad) for t in x[::3]])
    slope, shift = calibrate(margins, np.repeat([1.0, 0.0], [len(good[::3]), len(bad[::3])]))
    return Classifier(model.good, model.bad, slope, shift, model.prior)


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL, longest: int = SAMPLE_BYTES) -> tuple[list[bytes], list[bytes]]:
    """Good and bad texts of the training folds, each class in the order of the ids."""
    found = sorted(labelled(docs, labels, label, rows, total, longest, crc32_of() % FOLDS != 0).collect())
    return [bytes(t) for _, t, good in found if good], [bytes(t) for _, t, good in found if not good]


def classify(docs: DataFrame, model: Classifier | None, predict_at: float = PREDICT_AT) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors() if model else None
        for batch in slices(batches):
            scores = np.array([model.score(margin_of(t, tools)) if model else 0.5 for t in batch.column(2).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= predict_at).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc32_of() % FOLDS == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, raw_text()).mapInArrow(run, SCHEMA)


def op3_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(*sample(docs, table(spark, sf_dir, "labels"))))


QUERIES = {"op3_compression_classifier": op3_compression_classifier}
ORACLE: dict[str, str] = {}

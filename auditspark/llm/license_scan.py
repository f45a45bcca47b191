r"""License scans: fuzzy search for short notices with exact seeds and bounded-error verification.

Texts and notices lower-case A-Z and take words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``; the search runs over the words
joined by single spaces. A notice that may differ by ``k`` edits is split into k + 1 pieces: k edits leave one piece
whole, so every match lies around an exact place of some piece. The places of pieces give candidate windows, and the
regex library, matching with at most k errors, verifies edits inside each window and reports the best spans. The words of
a notice that tell it from its neighbours (a name, a version, noncommercial) are outside the part that may differ.

Base phrases are consecutive words, found exactly on word borders. Defined results: null or empty text has no words,
no labels and the score 0; a text with a base phrase scores 1, otherwise the score is the best verified match's
share of unedited characters; ids may be null; repeated rows give repeated results; an empty table an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import ALNUM, raw_text, slices, table

#: Phrase and label, fixed by the contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Label, notice, and the edits that it may have. Words in braces tell licences apart and stand as they are; a match that one
#: of the words in brackets follows is another licence's.
NOTICES = (
    ("mit", "under the {mit} license", 2),
    ("mit", "under a {mit} license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("apache-2", "apache license version {2}", 2),
    ("apache", "licensed under the {apache} license", 3),
    ("cc-by-nc", "creative commons attribution {noncommercial}", 4),
    ("cc-by-nc", "creative commons attribution {non commercial}", 4),
    ("cc-by", "creative {commons} attribution [noncommercial non sharealike share noderivatives noderivs no]", 3),
    ("bsd", "redistribution and use in source and binary forms", 5),
    ("gpl", "{gnu} general public license", 3),
    ("lgpl", "gnu {lesser} general public license", 3),
    ("agpl", "gnu {affero} general public license", 3),
    ("mpl-2", "{mozilla} public license version {2}", 3),
    ("mpl", "{mozilla} public license", 3),
    ("proprietary", "all rights {reserved}", 2),
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:int>>"


@dataclass(frozen=True)
class Notice:
    label: str
    text: bytes
    edits: int
    parts: tuple[tuple[bytes, bool], ...]  # each with whether it stands as it is
    others: frozenset[bytes]  # words that must not follow

    @classmethod
    def of(cls, label: str, notice: str, edits: int) -> Notice:
        own, _, others = notice.encode().partition(b" [")
        parts = [(x, bool(k % 2)) for k, x in enumerate(regex.split(rb"( ?\{[^}]*\} ?)", own)) if x]
        parts = [(x.replace(b"{", b"").replace(b"}", b""), exact) for x, exact in parts]
        return cls(label, b"".join(x for x, _ in parts), edits, tuple(parts), frozenset(others.rstrip(b"]").split()))

    def pattern(self) -> object:
        """Matches with at most ``edits`` errors in each part that may differ; in all is left to be counted."""
        own = [regex.escape(x, literal_spaces=True) if exact else rb"(?:%s){e<=%d}" % (regex.escape(x, literal_spaces=True), self.edits) for x, exact in self.parts]
        return regex.compile(b"(?b)" + b"".join(own))

    def seeds(self) -> list[tuple[bytes, int]]:
        """edits + 1 pieces that make up the text, each with its place in it."""
        n = self.edits + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        return [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:])]


@cache
def compiled(notices: tuple[tuple[str, str, int], ...]) -> list[tuple[Notice, list[tuple[bytes, int]], object]]:
    made = [Notice.of(*n) for n in notices]
    return [(x, x.seeds(), x.pattern()) for x in made]


def places(text: bytes, piece: bytes) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def fuzzy(text: bytes, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> list[tuple[str, int, int, int, int]]:
    """Label, start, end (bytes of ``text``), edits and the notice's length of the verified matches, which are runs of whole
    words. Of matches of one notice that overlap, the one with the fewest edits stands, then the first, then the longest.

    A seed's place gives the few bytes at which a match around it can begin; each word there, with each word's end at
    a possible distance, is a span that the regex library matches whole with bounded errors."""
    out = []
    for notice, seeds, pattern in compiled(notices):
        k, n = notice.edits, len(notice.text)
        begins = {s for piece, offset in seeds for at in places(text, piece) for s in range(max(0, at - offset - k), at - offset + k + 1)}
        matches = []
        for a in sorted(begins):
            if a >= len(text) or text[a] == 32 or (a and text[a - 1] != 32):
                continue
            for b in range(max(a + 1, a + n - k), min(len(text), a + n + k) + 1):
                if (b == len(text) or text[b] == 32) and text[b - 1] != 32 and (m := pattern.fullmatch(text, a, b)) and sum(m.fuzzy_counts) <= k:
                    if not notice.others or text[b + 1 : b + 33].partition(b" ")[0] not in notice.others:
                        matches.append((sum(m.fuzzy_counts), a, -b))
        taken: list[tuple[int, int]] = []
        for edits, a, b in sorted(matches):
            if all(-b <= x or a >= y for x, y in taken):
                taken.append((a, -b))
                out.append((notice.label, a, -b, edits, n))
    return out


def base_places(text: bytes) -> list[tuple[int, str]]:
    """First word and label of every place of a base phrase."""
    padded = b" " + text + b" "
    return sorted((padded.count(b" ", 0, at), label) for phrase, label in BASE for at in places(padded, b" " + phrase.encode() + b" "))


def scan_text(text: bytes, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> tuple:
    words = text.translate(ALNUM).split()
    joined = b" ".join(words)
    base = base_places(joined)
    found = fuzzy(joined, notices)
    base_labels = {label for _, label in base}
    score = 1.0 if base else max((1 - edits / n for _, _, _, edits, n in found), default=0.0)
    spans = [{"label": label, "start": joined.count(b" ", 0, a), "end": joined.count(b" ", 0, b) + 1, "edits": edits} for label, a, b, edits, _ in found]
    labels = sorted(base_labels | {x[0] for x in found})
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(base_labels)), ",".join(labels), score, spans


def scan(docs: DataFrame, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> DataFrame:
    """Counts, labels, score and the spans of verified matches (in words) of every document; ``notices`` are (label, words
    joined by single spaces, edits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))]
        for batch in slices(batches):
            rows = [scan_text(t, notices) for t in batch.column(1).to_pylist()]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text()).mapInArrow(run, SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE: dict[str, str] = {}

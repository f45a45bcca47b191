"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

from auditspark.llm.common import LOWER, mix64

WORDS = 5
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    """At least ``n`` powers of an odd constant, modulo 2 ** 64."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _STEP)])
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    r"""64-bit hashes of the words ``[^\x20\x09-\x0D]+`` of all texts, A-Z lower-cased, and the number of words of each."""
    joined = b" " + b" ".join(texts).translate(LOWER)
    raw = np.frombuffer(joined, np.uint8)
    space = _IS_SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    text_starts = 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, text_starts))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    offset = np.arange(len(raw), dtype=np.int64)
    offset[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(raw))))
    offset[: starts[0]] = 0
    offset[space] = 0
    value = _VALUES[raw] * _powers_to(int(offset.max()) + 1)[offset]
    value[space] = 0
    return mix64(np.add.reduceat(value, starts)), counts


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    hashes, counts = word_hashes(texts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    factors = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += hashes[k : k + n] * factors[k]
    rolled = mix64(rolled + np.uint64(words))
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix64((hashes[a:b] * factors[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())

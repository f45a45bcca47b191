"""The substring contract by a dictionary of all 50-byte strings."""

from __future__ import annotations

import hashlib


def dedup(rows: list[tuple]) -> list[tuple]:
    least: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        if i is not None:
            for p in range(len(t) - 49):
                w = t[p : p + 50]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if i is not None and least[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out

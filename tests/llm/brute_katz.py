"""The Katz model of the contract by plain dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict


K = 5


def discounts(n: list[int]) -> list[float]:
    """Katz's discounts of counts 0 to K from n[r - 1] events seen r times, r up to K + 1: those that keep the discounted
    mass in proportion to Good and Turing's, as d(r) = 1 - m (1 - (r + 1) n(r + 1) / (r n(r))) with the m that gives the
    unseen the mass n(1); half a count where there are no such numbers."""
    half = [1.0] + [(r - 0.5) / r for r in range(1, K + 1)]
    if any(x <= 0 for x in n):
        return half
    unseen = 1 - (K + 1) * n[K] / n[0]
    if unseen == 0:
        return half
    out = [1.0]
    for r in range(1, K + 1):
        d = 1 - (1 - (r + 1) * n[r] / (r * n[r - 1])) / unseen
        out.append(d if 0 < d < 1 else half[r])
    return out


UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: str | None) -> list[str]:
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)), " end"]


def probabilities(learned: list[list[str]]):
    """base(w) and p(w, u) of a model of these token lists."""
    one = Counter(t for x in learned for t in x)
    two = Counter(p for x in learned for p in zip([" start", *x], x))
    context = Counter(u for x in learned for u in [" start", *x[:-1]])
    n, v = sum(one.values()), len(one)
    d1 = discounts([sum(c == r for c in one.values()) for r in range(1, K + 2)])
    d2 = discounts([sum(c == r for c in two.values()) for r in range(1, K + 2)])
    d = lambda table, c: table[c] if c <= K else 1.0
    left = 1 - sum(d(d1, c) * c / n for c in one.values())
    scale, left = (1.0, left) if left > 1e-12 else (n / (n + 1), 1 / (n + 1))
    p1 = lambda w: d(d1, one[w]) * one[w] / n * scale if w in one else left
    after = defaultdict(list)
    for (u, w), c in two.items():
        after[u].append((w, c))

    def p2(w: str, u: str) -> float:
        if not context[u]:
            return p1(w)
        s = 1.0 if any(c <= K for _, c in after[u]) else context[u] / (context[u] + 1)
        if (u, w) in two:
            return s * d(d2, two[u, w]) * two[u, w] / context[u]
        mass = 1 - sum(s * d(d2, c) * c / context[u] for _, c in after[u])
        return mass / (1 - sum(p1(x) for x, _ in after[u])) * p1(w)

    return (lambda w: math.log10((one[w] + 1) / (n + v + 1))), p2, one, n


def scores(rows: list[tuple]) -> list[tuple]:
    texts = [(i, zlib.crc32(str(i).encode()) % 7 == 2, tokens(t)) for i, t in rows]
    base, p2, one, n = probabilities([x for _, held, x in texts if not held])
    return [(i, held, len(x), sum(w in one for w in x), n, sum(map(base, x)), sum(math.log10(p2(w, u)) for u, w in zip([" start", *x], x))) for i, held, x in texts]

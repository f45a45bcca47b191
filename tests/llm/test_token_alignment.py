"""Token alignment against whole-text encodings and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from auditspark.llm import token_alignment as ta

SCHEMA = "doc_id long, text string, row long, n_a string, pairs int"


@pytest.fixture(scope="module")
def tool():
    return ta.Aligner()


def plain(tool, text: str | None) -> tuple:
    """n_a, n_b, groups, Counter of linked id pairs, number of overlaps."""
    nothing = (0, 0, [], Counter(), 0)
    if not text:
        return nothing
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(tool.a_bytes[i] for i in a) != raw or b"".join(tool.b_bytes[i] for i in b) != raw:
        return nothing
    groups, i, j, x, y = [[[], []]], 0, 0, 0, 0
    overlaps = 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            x += len(tool.a_bytes[a[i]])
            groups[-1][0].append(a[i])
            i += 1
        else:
            y += len(tool.b_bytes[b[j]])
            groups[-1][1].append(b[j])
            j += 1
        if x == y:
            groups.append([[], []])
    groups.pop()
    ends = [np.cumsum([0, *(len(t[k]) for k in ids)]).tolist() for t, ids in ((tool.a_bytes, a), (tool.b_bytes, b))]
    spans = [list(zip(e, e[1:])) for e in ends]
    at = 0
    for s, e in spans[0]:
        while spans[1][at][1] <= s:
            at += 1
        k = at
        while k < len(b) and spans[1][k][0] < e:
            overlaps += 1
            k += 1
    return len(a), len(b), groups, Counter((p, q) for g in groups for p in g[0] for q in g[1]), overlaps


def expected(tool, rows: list[tuple]) -> list[tuple]:
    found = [plain(tool, t) for _, t in rows]
    docs = Counter(p for f in found for p in f[3])
    most: dict[int, int] = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (i, _), (n_a, n_b, groups, links, overlaps) in zip(rows, found):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        best = sum(n for p, n in links.items() if docs[p] == most[p[0]])
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((i, n_a, n_b, len(groups), sum(links.values()), overlaps, best, sum(n * docs[p] for p, n in links.items()), digest))
    return out


def odd_texts(n: int) -> list[str | None]:
    rng = random.Random(5)
    bits = ["the", "mixing", "naïve", "Über", "日本語", "👍🏽", "don't", "x" * 40, "1234567", "...", "<|endoftext|>", "</s>", "<0x0A>", "▁", "ﬁ", "\0", "\x1c", "\t", "\r\n", "\n", "\n\n", "  ", "   ", " ", " ", "\xa0", "　", "é", "İ", "a\0b", "−", "{\r", "ß", "🇩🇪"]
    some = [None, "", " ", "\n", "  ", "a", " a", "a ", "\na", "a\n", "\n\n  a", "\0", "\0 \0", "a" * 3000, "日本" * 400, "👍🏽" * 200, "\n" * 90, " " * 70, "▁", "a ▁b", "the ▁ the", " a\n b\t\nc "]
    for _ in range(n):
        join = rng.choice(["", " ", " ", "\n"])
        some.append(join.join(rng.choice(bits) for _ in range(rng.randint(1, 25))))
    return some


def test_texts(tool):
    texts = odd_texts(1500)
    for at in range(0, len(texts), 200):
        some = texts[at : at + 200]
        found = tool.aligned([t or "" for t in some])
        for k, t in enumerate(some):
            n_a, n_b, groups, links, overlaps = plain(tool, t)
            text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups).encode()
            assert found.figures[k].tolist() == [n_a, n_b, len(groups), sum(links.values()), overlaps], repr(t)
            assert found.groups[k] == text, repr(t)
            own = slice(found.starts[k], found.starts[k + 1])
            b_size = len(tool.b_size)
            assert {(p // b_size, p % b_size): n for p, n in zip(found.pairs[own].tolist(), found.times[own].tolist())} == links


@pytest.mark.parametrize("shard", [ta.SHARD, 40])
def test_rows(spark, tool, shard):
    texts = odd_texts(120) + ["the same text"] * 3
    rows = [(None if k % 50 == 3 else k // 2, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    found, pairs = ta.token_links(docs, shard=shard)
    columns = ["doc_id", *ta.FIGURES, "n_best", "count_sum", "groups_sha256"]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found.collect()) == sorted(map(repr, expected(tool, rows)))
    docs_of = Counter(p for _, t in rows for p in plain(tool, t)[3])
    assert {(r["a_id"], r["b_id"]): r["docs"] for r in pairs.collect()} == docs_of


def test_parts_of_counts(spark, tool, monkeypatch):
    """Counts that leave a task in several parts are the same."""
    texts = odd_texts(300)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).coalesce(1)
    monkeypatch.setattr(ta, "HELD", 10)
    found, _ = ta.token_links(docs)
    assert sorted((r["doc_id"], r["count_sum"]) for r in found.collect()) == sorted((e[0], e[7]) for e in expected(tool, rows))


def test_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert ta.token_links(docs)[0].collect() == []
    only = ta.token_links(spark.createDataFrame([(1, None, 0, "", 0), (2, "", 0, "", 0)], SCHEMA))[0].collect()
    assert sorted((r["doc_id"], r["n_links"], r["count_sum"], r["groups_sha256"]) for r in only) == [(1, 0, 0, ""), (2, 0, 0, "")]


@pytest.mark.parametrize("seed", range(3))
def test_products(seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 3, shape) * (rng.random(shape) < 0.3) for shape in ((7, 9), (9, 5)))
    sparse = [ta.Csr.of_entries(*np.nonzero(m), m[np.nonzero(m)], m.shape) for m in (a, b)]

    def dense(m: ta.Csr) -> np.ndarray:
        out = np.zeros((len(m.starts) - 1, m.width), np.int64)
        out[m.rows(), m.indices] = m.values
        return out

    assert (dense(sparse[0].times(sparse[1])) == a @ b).all()
    assert (dense(sparse[0].transposed()) == a.T).all()


def test_caches_are_dropped(tool):
    from auditspark.llm import common

    ta._aligners["a", "b"] = tool
    common.drop_caches()
    assert not ta._aligners

"""The Jaccard join of documents against all pairs of sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from auditspark.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, n string, node int, shingle int, component long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain(rows: list[tuple]) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[find(a)] = find(b)
    ids: dict[int, list] = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    return [(i, len(sets[k]), min((x for x in ids[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def edited(rng: random.Random, words: list[str], edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        kind = rng.random()
        out[k : k + 1] = [] if kind < 0.2 else [out[k], rng.choice(words)] if kind < 0.4 else [f"e{rng.randrange(40)}"]
    return out


def family(seed: int) -> list[tuple]:
    """Families of one to many edits, chains of edits, shared passages, short texts, copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([30, 300]))]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows: list[list[str]] = []
    for size, most in ((12, 3), (12, 9), (8, 1)):
        base = prose(rng.randint(40, 160))
        rows += [edited(rng, base, rng.randint(0, most)) for _ in range(size)]
    chain = prose(80)
    for _ in range(12):
        chain = edited(rng, chain, 1)
        rows.append(chain)
    passage = prose(25)
    rows += [prose(rng.randint(5, 60)) + passage + prose(rng.randint(5, 60)) for _ in range(12)]
    rows += [prose(rng.randint(0, 9)) for _ in range(25)] + [passage] * 4
    texts = [" ".join(r) for r in rows] + [None, "", " \n", "ONE", "one", "One two", "a b c d", "A b c d e"]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(None, texts[0]), (None, texts[1] + " tail"), (None, "alone here without an id"), (3, texts[3]), (3, texts[40]), (-7, texts[5])]
    rng.shuffle(out)
    return out


def found(spark, rows: list[tuple]) -> list[tuple]:
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    return [tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in nj.join_documents(docs).collect()]


@pytest.mark.parametrize("way", ["as it is", "no centres", "long prefixes", "lowest level"])
def test_all_pairs(spark, monkeypatch, way):
    if way == "no centres":
        monkeypatch.setattr(nj, "star_pairs", lambda prefix: spark.createDataFrame([], "a long, b long"))
    elif way == "long prefixes":
        monkeypatch.setattr(nj, "VERIFY", 1e6)
        monkeypatch.setattr(nj, "star_pairs", lambda prefix: spark.createDataFrame([], "a long, b long"))
    elif way == "lowest level":
        monkeypatch.setattr(nj, "chosen", lambda n, alone, times: (1, max(0, min(len(times), n - -(-85 * n // 100) + 1 - alone))))
    rows = family(len(way))
    assert sorted(map(repr, found(spark, rows))) == sorted(map(repr, plain(rows)))


def test_levels_follow_cost():
    """Lists of one other entry are read at the lowest level; long lists at its start lengthen the prefix."""
    assert nj.chosen(100, 10, np.full(90, 2)) == (1, 6) or nj.chosen(100, 10, np.full(90, 2))[0] > 1
    few, many = np.array([2] * 90), np.array([400] * 8 + [500] * 82)
    assert nj.chosen(100, 15, few)[0] <= nj.chosen(100, 10, many)[0]
    assert nj.chosen(100, 16, few) [1] <= 85
    level, size = nj.chosen(100, 5, many)
    assert size == 100 - 85 + level - 5


def test_variants_without_a_hub(spark):
    """Variants that are all too far from each other make no pair rows, however many there are."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(300)]
    made = []
    for size in (40, 160):
        rows = []
        for i in range(size):
            words = list(base)
            for at in rng.sample(range(300), 9):
                words[at] = f"own{i}_{at}"
            rows.append((i, " ".join(words)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        nodes = spark.createDataFrame([(k, nj.set_key(s), h) for k, (s, h) in enumerate(zip(nj.shingle_sets([t.encode() for _, t in rows], 4), [r[1] for r in nj.keyed(docs).collect()]))], "node long, set_key binary, row_key long")
        prefix = nj.prefixes(nj.full_sets(docs, nodes, 4))
        named = spark.createDataFrame([], "node long, component long")
        made.append(nj.far_pairs(prefix, named).count())
    assert made == [0, 0]


def test_empty(spark):
    assert nj.join_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_oracle(spark, sf_dir, duck, same_rows):
    (name, query), *_ = nj.QUERIES.items()
    same_rows(query(spark, sf_dir).toPandas(), duck.execute(nj.ORACLE[name]).df())

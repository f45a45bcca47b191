"""Product codes of vectors against plain integers, on random and odd tables."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from auditspark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, error string, parts int"


def plain(rows: list[tuple]) -> list[tuple]:
    """vec_id, code, error, label_error, digest, by trying every entry."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max([len(r[1]) for r in kept] + [1]) // 16) * 16
    most = vc.limit(width)
    whole = [[min(max(math.floor(256 * x), -most), most) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    size = width // 16
    books = [[v[p * size : (p + 1) * size] for v in whole[:64]] for p in range(16)]

    def assigned(v: list, p: int) -> tuple:
        part = v[p * size : (p + 1) * size]
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(books[p]))

    for _ in range(2):
        moved = []
        for p in range(16):
            groups: dict[int, list] = {}
            for v in whole:
                groups.setdefault(assigned(v, p)[1], []).append(v[p * size : (p + 1) * size])
            moved.append([[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(books[p])])
        books = moved
    found = [[assigned(v, p) for p in range(16)] for v in whole]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by: dict = {}
    for r, e in zip(kept, errors):
        by[r[2]] = by.get(r[2], 0) + e
    return [(r[0], "".join(f"{j:02x}" for _, j in f), e, by[r[2]], digest) for r, f, e in zip(kept, found, errors)]


def rows_of(kind: str) -> list[tuple]:
    rng = random.Random(kind)
    if kind == "few":
        return [(i, [rng.uniform(-1, 1) for _ in range(32)], i % 2) for i in range(5)]
    if kind == "ties":
        return [(i, [rng.choice([-0.01, 0.0, 0.003, 0.5]) for _ in range(64)], None if i % 3 else i % 4) for i in range(200)]
    if kind == "odd":
        ragged = [(i if i % 9 else None, [rng.gauss(0, 1) for _ in range(rng.choice([0, 1, 15, 16, 17, 40]))], rng.choice([None, 1, 2])) for i in range(120)]
        bad = [(1, None, 1), (2, [0.0, None], 1), (3, [math.nan] * 16, 1), (4, [math.inf], None), (5, [1.0] * 40, 7), (5, [1.0] * 40, 7), (-3, [1e30, -1e30, 5e5], 8)]
        return ragged + bad
    return [(i, [rng.gauss(0, 0.2) + (i % 5) / 7 for _ in range(64)], i % 10) for i in range(400)]


@pytest.mark.parametrize("kind", ["plain", "few", "ties", "odd"])
def test_all_entries(spark, kind):
    rows = rows_of(kind)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    found = [tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in vc.vector_codes(table).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, plain(rows)))


def test_nothing(spark):
    table = spark.createDataFrame([(1, None, 1, "x", 1)], SCHEMA)
    assert vc.vector_codes(table).collect() == [] and vc.vector_codes(table.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_prune(seed):
    rng = np.random.default_rng(seed)
    scale = [3, 200, 1 << 20, 1 << 27][seed]
    entries, points = rng.integers(-scale, scale, (64, 4)), rng.integers(-scale, scale, (500, 4))
    points[:64] = entries
    pivots = vc.choose_pivots(entries[None])[0]
    at, best = vc.nearest(points, vc.distances(points, pivots), entries, vc.distances(entries, pivots))
    squares = ((points[:, None] - entries) ** 2).sum(axis=2)
    assert (best == squares.min(axis=1)).all() and (at == squares.argmin(axis=1)).all()


def test_oracle(spark, sf_dir, duck, same_rows):
    (name, query), *_ = vc.QUERIES.items()
    same_rows(query(spark, sf_dir).toPandas(), duck.execute(vc.ORACLE[name]).df())


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from auditspark.llm import common

    unset = SimpleNamespace(get=lambda key, default: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert common.shared_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file:///")

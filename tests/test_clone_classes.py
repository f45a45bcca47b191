"""Classes of clones against plain counting of neighbours, and their growth."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from auditspark.operators import clones

FILES = "repo string, file_id long, content string"


def plain(files, size=3):
    """(repo, first window) -> places, by looking at every occurrence of every window."""
    at = {}
    for repo, i, content in files:
        lines = [" ".join(x.split()) for x in content.split("\n")]
        numbered = [(n, x) for n, x in enumerate(lines, 1) if x]
        for p in range(len(numbered) - size + 1):
            at[repo, i, p] = (tuple(x for _, x in numbered[p : p + size]), numbered[p][0], numbered[p + size - 1][0])
    places = defaultdict(list)
    for (repo, i, p), (w, _, _) in at.items():
        places[repo, w].append((i, p))
    shared = {k for k, v in places.items() if len({i for i, _ in v}) > 1}

    def always(repo, w, step):
        near = {at.get((repo, i, p + step), (None,))[0] for i, p in places[repo, w]}
        return near.pop() if len(near) == 1 else None

    found = []
    for repo, i in {k[:2] for k in at}:
        p = 0
        while (repo, i, p) in at:
            w = at[repo, i, p][0]
            if (repo, w) not in shared:
                p += 1
                continue
            start, first = p, w
            while (x := at.get((repo, i, p + 1))) and x[0] == always(repo, at[repo, i, p][0], 1) and always(repo, x[0], -1) == at[repo, i, p][0] and (repo, x[0]) in shared:
                p += 1
            found.append((repo, i, start, at[repo, i, start][1], at[repo, i, p][2], p - start + size, first))
            p += 1
    return found


@pytest.mark.parametrize("seed", range(3))
def test_random_files(spark, seed):
    rng = random.Random(seed)
    blocks = [[f"line {b} {k}" for k in range(rng.randint(2, 7))] for b in range(6)] + [["same"] * 6]
    files = []
    for i in range(14):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice(blocks) + [""] * rng.randint(0, 2) + [f"own {rng.randrange(40)}"] * rng.randint(0, 1)
        files.append((rng.choice("rs"), i, "\n".join(lines)))
    found = clones.clone_runs(spark.createDataFrame(files, FILES).repartition(3), 3).collect()
    expected = plain(files)
    assert sorted((r["repo"], r["file_id"], r["pos"], r["start_line"], r["end_line"], r["lines"]) for r in found) == sorted(e[:6] for e in expected)
    by_class = defaultdict(set)
    for r in found:
        by_class[r["repo"], r["clone"]].add((r["file_id"], r["pos"]))
    by_window = defaultdict(set)
    for e in expected:
        by_window[e[0], e[6]].add((e[1], e[2]))
    assert sorted(map(sorted, by_class.values())) == sorted(map(sorted, by_window.values()))


def test_copies_make_a_row_each(spark):
    body = "\n".join(f"x{k} = {k}" for k in range(40))
    for n in (3, 30):
        files = spark.createDataFrame([("r", i, body) for i in range(n)], FILES)
        runs = clones.clone_runs(files)
        assert runs.count() == n
        (one,) = clones.clone_classes(runs).collect()
        assert (one["lines"], one["places"], one["files"], one["first_file"], one["first_line"]) == (40, n, n, 0, 1)


def test_repeats_within_a_file_only(spark):
    body = "\n".join([f"x{k} = {k}" for k in range(10)] * 3)
    assert clones.clone_runs(spark.createDataFrame([("r", 1, body), ("s", 2, body)], FILES)).count() == 0
    assert clones.clone_runs(spark.createDataFrame([], FILES)).collect() == []

"""What the two levels of op6 send: runs that a smaller document has in full ask nothing more."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest

from auditspark.llm import substring_dedup as op6

from .brute_substrings import dedup


def block(name: int, rows: list[tuple[int, bytes]]) -> op6.Block:
    ids, texts = zip(*rows)
    return op6.Block(pa.table({"block": pa.array([name] * len(rows), pa.int64()), "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary())}))


def test_only_the_least_document_of_a_content_is_asked_again():
    rng = random.Random(5)
    passage = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(400))
    clipped = passage[:205]
    blocks = [block(0, [(1, passage)]), block(1, [(2, passage)]), block(2, [(3, clipped)]), block(3, [(4, passage), (5, clipped)])]
    sent = pa.concat_tables([b.send(1, b.keys, b.content, op6.WIDTHS[1], b.least) for b in blocks])
    told = op6.least_documents(sent, 1).to_pylist()
    asked = []
    for b in blocks:
        _, is_open = b.settle([r for r in told if r["block"] == b.name], 1, 1, b.keys, b.least)
        b.open_windows(is_open)
        asked.append(len(b.full_keys))
    assert asked[0] and asked[2] and asked[1] == asked[3] == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clipped_and_edited_copies(spark, seed):
    """Passages cut off and edited at many places, in long and short texts and of few letters, over many small blocks."""
    rng = random.Random(seed)
    letters = ["ab", "abcdefghijklmnop ", "aé漢 x"][seed - 1]
    passages = ["".join(rng.choice(letters) for _ in range(n)) for n in (60, 90, 150, 400)] + ["a" * 200]
    rows = []
    for i in rng.sample(range(-200, 1000), 150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2)) if rng.random() < 0.6 else (0, len(p))
            part = list(p[a:b])
            if part and rng.random() < 0.4:
                part[rng.randrange(len(part))] = rng.choice("XYZ")
            parts.append("".join(part))
        rows.append((i, rng.choice(["", " ", "--"]).join(parts)))
    rows += [(rows[k][0], rows[k + 1][1]) for k in range(5)] + [(None, rows[7][1]), (2000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = sorted((str(r[0]), r[1], r[4]) for r in dedup(rows))
    for size, keys in ((2000, 300), (op6.BLOCK_BYTES, op6.PART_KEYS)):
        found = op6.substring_dedup(docs, size, keys).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found) == expected

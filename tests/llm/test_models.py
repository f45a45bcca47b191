"""Operators and pipeline stages against plain recomputations: quotients, dictionaries, edit distances, verdicts, rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from auditspark.llm import common, compression_classifier, decontaminate, katz, license_scan, line_dedup, mixing, near_dedup, quality_rules, token_ids

from .brute_near import groups
from .test_messy import contamination, odd, result, texts, words  # noqa: F401


def test_highest_quotients(spark):
    """Seats go one by one to the highest quotient votes / (2 seats + 1), ties to the first, none above a row's limit."""
    rng = random.Random(3)
    for group in range(6):
        rows = [(f"s{k}", k, float(rng.choice([0, 1, 5, 7, 7, 30, 1000, rng.randint(1, 500)])), rng.choice([2, 9, 10_000])) for k in range(rng.randint(1, 9))]
        seats = min(rng.choice([0, 1, 7, 40, 333]), sum(m for *_, v, m in rows if v > 0))
        won = Counter()
        for _ in range(seats):
            open_ = [(-v / (2 * won[s] + 1), k, s) for s, k, v, m in rows if v > 0 and won[s] < m]
            won[min(open_)[2]] += 1
        if any(won[s] == m for s, _, v, m in rows if v > 0):
            continue  # a row at its limit: how the rest is shared depends on when the limit is met
        df = spark.createDataFrame(rows, "source string, place int, votes double, most long")
        found = mixing.apportion(df, [], "votes", [F.col("place")], F.lit(seats), "most").collect()
        assert {r["source"]: r["quota"] for r in found} == {s: won[s] for s, *_ in rows}, group


def test_classifier_from_its_dictionaries(spark, odd):
    """The score again from the sizes that zstandard gives with either dictionary."""
    docs, labels = common.table(spark, odd, "documents"), common.table(spark, odd, "labels")
    good, bad = compression_classifier.sample(docs, labels)
    marks = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            marks[r["doc_id"]] = max(marks.get(r["doc_id"], 0), r["quality"])
    short = {}
    for i, t in texts():
        if t and i in marks and len(t.encode()) <= compression_classifier.SAMPLE_BYTES:
            short[i] = min(short.get(i, t.encode()), t.encode())
    assert (sorted(good), sorted(bad)) == tuple(sorted(t for i, t in short.items() if marks[i] == k) for k in (1, 0))
    model = compression_classifier.fit(good, bad)

    def size(text, content):
        tool = zstandard.ZstdCompressor(level=compression_classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(tool.compress(text[i : i + compression_classifier.PIECE])) for i in range(0, len(text), compression_classifier.PIECE))

    by_id = {i: t for i, t in texts() if i != 6}
    for r in result(spark, compression_classifier, odd):
        if r[0] in by_id:
            text = (by_id[r[0]] or "").encode()
            if not text:
                assert r[2] == pytest.approx(model.prior)
                continue
            a, b = size(text, model.good), size(text, model.bad)
            assert r[2] == pytest.approx(1 / (1 + np.exp(-(model.slope * (b - a) / (a + b) + model.shift))), abs=1e-9)


@pytest.mark.parametrize("module", [compression_classifier, quality_rules])
def test_sample_among_many_labels(spark, module):
    """Fifty times more labels than documents: all labelled documents are in the sample."""
    docs = spark.createDataFrame([(i, f"text number {i} of a few words") for i in range(40)], "doc_id long, text string")
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert common.labelled(docs, labels, "quality", 20, 1 << 20, 1 << 10).count() == 40
    assert common.labelled(docs, labels, "quality", 10, 1 << 20, 1 << 10).count() == 20
    assert common.labelled(docs, labels, "quality", 20, 5 * 40, 1 << 10).count() < 20


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def notice_distance(text: str, notice: str) -> int:
    """Edits that make ``text`` of the notice, its words in braces standing as they are."""
    if "{" not in notice:
        return distance(text, notice)
    first, exact, rest = re.fullmatch(r"(.*?)( ?\{[^}]*\} ?)(.*)", notice).groups()
    exact = exact.replace("{", "").replace("}", "")
    at = [m.start() for m in re.finditer(f"(?={re.escape(exact)})", text)]
    return min((distance(text[:i], first) + notice_distance(text[i + len(exact) :], rest) for i in at), default=1 << 20)


def bare(notice: str) -> str:
    return notice.partition(" [")[0].replace("{", "").replace("}", "")


def spans_by_distance(text: str, notices) -> list[tuple]:
    """All runs of whole words within a notice's edits; of those that overlap the one with the fewest."""
    starts = [m.start() for m in re.finditer(r"[^ ]+", text)]
    ends = [m.end() for m in re.finditer(r"[^ ]+", text)]
    out = []
    for label, notice, k in notices:
        own, _, others = notice.partition(" [")
        size, others = len(bare(notice)), others.rstrip("]").split()
        near = [(d, a, -b) for a in starts for b in ends if a < b and abs(b - a - size) <= k and (d := notice_distance(text[a:b], own)) <= k]
        near = sorted(x for x in near if text[-x[2] :].split()[:1] == [] or text[-x[2] :].split()[0] not in others)
        taken = []
        for d, a, b in near:
            if all(-b <= x or a >= y for x, y in taken):
                taken.append((a, -b))
                out.append((label, a, -b, d))
    return sorted(out)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Apache License Version 1", ""), ("the Apache License, version 3 of it", ""), ("Apache License Version 2.0", "apache-2"), ("Apache Licence Verson 2", "apache-2"), ("licensed under the Apache License Version 1.1", "apache"),
        ("Creative Commons Attribution Commercial", "cc-by"), ("Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc"), ("creative commons atribution non commercial", "cc-by-nc"), ("Creative Commons Attribution ShareAlike", ""),
        ("the general public license", ""), ("GNU General Public Licence", "gpl"), ("GNU Lesser General Public License", "lgpl"), ("gnu affero general public license", "agpl"), ("GNU public library", ""),
        ("under the bit license", ""), ("under a MIT licence", "mit"), ("under an mit license", "mit"), ("undr the mit license", "mit"), ("under the exit license", ""),
        ("Mozilla Public License Version 1.1", "mpl"), ("Mozilla Public License, version 2.0", "mpl,mpl-2"), ("Godzilla public license", ""), ("all rights reversed", ""), ("All rigths reserved.", "proprietary"), ("cc by nd", ""),
    ],
)
def test_neighbouring_licences(text, labels):
    assert license_scan.scan_text(text.encode())[5] == labels


def test_fuzzy_notices_by_edit_distance():
    rng = random.Random(7)
    fill = ["foo", "bar", "license", "under", "the", "a", "x", "mit", "public", "noncommercial", "2"]
    for _ in range(300):
        label, notice, k = rng.choice(license_scan.NOTICES)
        own = list(bare(notice))
        for _ in range(rng.randint(0, k + 1)):
            at = rng.randrange(len(own))
            kind = rng.random()
            if kind < 0.4:
                own[at] = rng.choice("abc xyz")
            elif kind < 0.7:
                del own[at]
            else:
                own.insert(at, rng.choice("abc xyz"))
        text = " ".join(f"{' '.join(rng.choices(fill, k=3))} {''.join(own)} {' '.join(rng.choices(fill, k=3))}".split())
        found = sorted((x[0], x[1], x[2], x[3]) for x in license_scan.fuzzy(text.encode()))
        assert found == spans_by_distance(text, license_scan.NOTICES), text


def test_license_spans(spark, odd):
    rows = {r["doc_id"]: r for r in license_scan.op5_license_scan(spark, odd).collect()}
    for i, t in texts():
        if i in (18, 12, 13, 10):
            joined = " ".join(words(t))
            expected = spans_by_distance(joined, license_scan.NOTICES)
            assert sorted((s["label"], s["edits"]) for s in rows[i]["spans"]) == sorted((x[0], x[3]) for x in expected)
            labels = set(filter(None, rows[i]["base_labels"].split(","))) | {x[0] for x in expected}
            assert rows[i]["labels"] == ",".join(sorted(labels))
    own = license_scan.scan(spark.createDataFrame([(1, "free for all uzes here")], "doc_id long, text string"), (("free", "free for all uses", 1),)).first()
    assert own["labels"] == "free" and own["spans"][0]["edits"] == 1


def test_quality_held_out(spark):
    """A model of four fifths of the labels ranks the rest, and its verdict is its probability against the threshold."""
    folder = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    held = labels.where(common.crc32_of() % 5 == 0)
    model = quality_rules.train(docs, labels.where(common.crc32_of() % 5 != 0))
    rows = quality_rules.score(docs.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id").collect()
    good, bad = (np.array([r["probability"] for r in rows if r["quality"] == k]) for k in (1, 0))
    assert ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()) > 0.95
    assert (good >= quality_rules.KEEP_AT).mean() > 0.95 and (bad >= quality_rules.KEEP_AT).mean() < 0.4
    assert all(r["kept"] == (not r["base_failed"] and r["probability"] >= quality_rules.KEEP_AT) for r in rows)
    w = model.weights
    for r in docs.limit(30).collect():
        slots = quality_rules.hashed_features((r["text"] or "").encode())
        count = np.bincount(slots, minlength=quality_rules.DIM)
        margin = (np.sqrt(count / max(1, len(slots))) * w).sum() + model.bias
        assert quality_rules.margin_of((r["text"] or "").encode(), model) == pytest.approx(margin, abs=1e-9)


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stage_rows(spark, odd):
    """Each stage on the rows that the one before kept, by plain rules: which rows stay, with which texts."""
    docs = common.table(spark, odd, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, odd)
    model = quality_rules.train(docs, common.table(spark, odd, "labels"))
    expected = Counter()
    for i, t in texts():
        raw = (t or "").encode()
        n, _, _, _, repeats = quality_rules.base_counts(raw)
        if n >= 50 and 2 * repeats <= n and (model is None or model.probability(np.array([quality_rules.margin_of(raw, model)]))[0] >= quality_rules.KEEP_AT):
            expected[i, t] += 1
    assert rows_of(good) == expected and good.schema == docs.schema
    one = stages["near_dedup"](spark, docs, odd)
    kept = {r[0] for r in groups([(i, t) for i, t in texts() if i is not None]) if r[3]}
    assert rows_of(one) == Counter((i, t) for i, t in texts() if i is None or i in kept)
    assert one.columns == docs.columns
    items = [(r[0], words(r[1])) for r in common.table(spark, odd, "benchmark").collect()]
    clean = stages["decontaminate"](spark, docs, odd)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, t in texts() if not contamination(t, items)[4])
    mixed = stages["mix_sources"](spark, docs, odd)
    counts = Counter(r["doc_id"] for r in mixed.collect())
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.whole_copies(mixing.mix(docs)).collect()}
    for i, t in set(texts()):
        if i != 6:
            assert counts[i] == copies.get((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))), 0)
    assert set(rows_of(mixed)) <= set(texts())
    tokens = stages["token_ids"](spark, docs, odd)
    assert sorted(map(repr, map(tuple, tokens.collect()))) == sorted(map(repr, map(tuple, result(spark, token_ids, odd))))


def test_clashing_columns(spark, odd, tmp_path):
    """Columns of odd names in labels, benchmark and pages change nothing."""
    folder = str(tmp_path)
    for name in ("documents", "labels", "benchmark", "pages"):
        df = common.table(spark, odd, name)
        for extra in ("good", "text_", "size", "id", "sum", "kept", "lines", "drop", "_host", "n", "items"):
            if extra not in df.columns:
                df = df.withColumn(extra, F.lit(extra))
        df.write.parquet(f"{folder}/{name}.parquet")
    for module in (quality_rules, compression_classifier, decontaminate, line_dedup):
        assert sorted(map(repr, result(spark, module, folder))) == sorted(map(repr, result(spark, module, odd)))


def test_pair_counts_of_more_than_32_bits():
    """Counts of a pair that two blocks hold come back whole, however large their sum is."""

    def sent(block: int, n: int):
        one = np.array([1])
        return katz.sent(block, [(0, [1, 1], np.array([5], np.uint64).tobytes() + common.planes(one, "<u4"), np.array([9], np.uint64).tobytes(), common.planes(np.array([n]), "<u4"), common.planes(np.array([n]), "<u8"))])

    group = pa.Table.from_batches([sent(1, 2**32 - 1), sent(2, 8)])
    found = katz.sum_pairs(group, katz.Unigrams(np.array([0] * (katz.K + 1) + [1, 10])))
    assert [int(common.unplanes(x, "<u8")[0]) for x in found["a"].to_pylist()] == [2**32 + 7] * 2


@pytest.mark.parametrize("n", [2, 3, 7, 19, 40])
def test_fit_of_few_texts(n):
    """However few labelled texts there are, both classes make a model that ranks them."""
    texts = [(b"plain calm words of a good text %d" if i % 2 else b"zzxx $$ qq vv noise %d ##") % i for i in range(n)]
    model = quality_rules.fit([quality_rules.vector_of(t) for t in texts], np.array([i % 2 for i in range(n)]))
    margins = [quality_rules.margin_of(t, model) for t in texts]
    assert model.slope > 0 and min(m for i, m in enumerate(margins) if i % 2) > max(m for i, m in enumerate(margins) if not i % 2)
    assert quality_rules.fit([quality_rules.vector_of(t) for t in texts], np.ones(n, int)) is None

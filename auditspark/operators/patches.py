"""Unified diffs: lines of a patch with their numbers in the new file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions import text
from auditspark.operators import segments


HEADER = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def as_lines(patches: DataFrame) -> DataFrame:
    """patch_id, pos, line of patches that are texts (patch_id, patch); patches of lines are given back."""
    if "patch" not in patches.columns:
        return patches
    return patches.select("patch_id", F.posexplode(text.split_lines(F.col("patch"))).alias("pos", "line"))


def patch_lines(patches: DataFrame, piece: int = segments.PIECE) -> DataFrame:
    """patch_id, pos, line, is_header, number: each line with the number that its hunk gives it. ``patches`` are texts or
    lines (patch_id, pos from 0, line); a long patch is numbered in pieces."""
    header = F.regexp_extract("line", HEADER, 1)
    start = F.when(header != "", header.cast("int"))
    advances = (~F.col("line").startswith("-")).cast("int")
    rows = segments.counters(as_lines(patches), ["patch_id"], "pos", start, advances, piece)
    return rows.select("patch_id", "pos", "line", (header != "").alias("is_header"), F.col("value").cast("int").alias("number"))


def added_in(patch: Column) -> Column:
    """Array of (number, text) of the lines that the text of a patch adds: those of a hunk are counted from its header, those
    before the first header from 0. A text stands in one row, so its lines are counted there."""

    def hunks(lines: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.when(x.startswith("@@"), F.regexp_extract(x, HEADER, 1)).otherwise("").alias("start"))), lambda h: h["start"] != "")
        return text.let(F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit("0").alias("start"))), starts), lambda heads: F.flatten(F.transform(heads, lambda h, j: added(h, F.slice(lines, h["at"] + 2, F.coalesce(F.get(heads, j + 1)["at"], F.size(lines)) - h["at"] - 1)))))

    def added(head: Column, body: Column) -> Column:
        stays = F.filter(body, lambda x: ~x.startswith("-"))
        numbered = F.transform(stays, lambda x, k: F.struct((head["start"].cast("int") + k).alias("number"), x.alias("text")))
        return F.transform(F.filter(numbered, lambda x: x["text"].startswith("+")), lambda x: F.struct(x["number"].alias("number"), F.substring(x["text"], 2, 1 << 30).alias("text")))

    return text.let(text.split_lines(patch), hunks)


def added_lines(patches: DataFrame) -> DataFrame:
    """patch_id, number, text of the lines that a patch adds."""
    if "patch" in patches.columns:
        return patches.select("patch_id", F.explode(F.array(added_in(F.col("patch")))).alias("added")).select("patch_id", F.explode("added").alias("a")).select("patch_id", "a.*")
    rows = patch_lines(patches).where(F.col("line").startswith("+") & ~F.col("is_header"))
    return rows.select("patch_id", "number", F.substring("line", 2, 1 << 30).alias("text"))


def diff_position(patches: DataFrame, targets: DataFrame) -> DataFrame:
    """patch_id, target, position: the place, counted from the first header, of each target line; null if not shown."""
    rows = patch_lines(patches)
    first = rows.where(F.col("line").startswith("@@")).groupBy("patch_id").agg(F.min("pos").alias("first"))
    shown = rows.where(~F.col("line").startswith("@@") & ~F.col("line").startswith("-")).join(first, "patch_id").where(F.col("pos") > F.col("first"))
    hits = shown.select("patch_id", F.col("number").alias("target"), (F.col("pos") - F.col("first") + 1).alias("position")).groupBy("patch_id", "target").agg(F.min("position").alias("position"))
    return targets.join(hits, ["patch_id", "target"], "left")


def on_modified_lines(findings: DataFrame, patches: DataFrame) -> DataFrame:
    """Findings (patch_id, line, ...) on added lines, and all of those whose patch adds none. Each is read once."""
    if "patch" in patches.columns:
        numbers = F.array_distinct(F.transform(added_in(F.col("patch")), lambda x: x["number"]))
        own = patches.select("patch_id", F.explode(F.array(numbers)).alias("_added")).groupBy("patch_id").agg(F.array_distinct(F.flatten(F.collect_list("_added"))).alias("_added"))
        joined = findings.join(own, "patch_id", "left")
        return joined.where((F.coalesce(F.size("_added"), F.lit(0)) <= 0) | F.array_contains("_added", F.col("line"))).drop("_added")
    added = added_lines(patches).select("patch_id", F.col("number").alias("line"))
    kept = findings.join(added, ["patch_id", "line"], "left_semi")
    some = added.select("patch_id").distinct()
    return kept.unionByName(findings.join(some, "patch_id", "left_anti"))

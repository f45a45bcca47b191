"""Dependencies of manifests: parsing of requirement lines and package files, and classification against advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions import text
from auditspark.operators.relational import severity_rank


def requirements(manifests: DataFrame) -> DataFrame:
    """manifest_id, pos, name, spec, resolved of requirement lines; comments, options and lines of another form are skipped.
    ``manifests`` are texts (manifest_id, content) or lines (manifest_id, pos, line)."""
    if "content" in manifests.columns:
        manifests = manifests.select("manifest_id", F.posexplode(text.split_lines(F.col("content"))).alias("pos", "line"))
    lines = manifests.select("manifest_id", "pos", text.strip(F.col("line")).alias("line"))
    form = r"^([A-Za-z0-9_.\-]+)\s*((?:[=<>!~]=?=?\s*[^;\s,]+\s*,?\s*)*)(?:;.*)?$"
    kept = lines.where(~F.col("line").rlike("^(#|-|$)") & F.col("line").rlike(form))
    spec = text.strip(F.regexp_extract("line", form, 2))
    pin = F.coalesce(F.nullif(F.regexp_extract(spec, r"==\s*([^,\s]+)", 1), F.lit("")), F.nullif(F.regexp_extract(spec, r"~=\s*([^,\s]+)", 1), F.lit("")))
    return kept.select("manifest_id", "pos", F.regexp_extract("line", form, 1).alias("name"), spec.alias("spec"), pin.alias("resolved"))


def package_json(manifests: DataFrame) -> DataFrame:
    """manifest_id, name, spec, resolved of both dependency maps; specs that are no strings are skipped."""
    shape = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
    parsed = manifests.select("manifest_id", F.from_json("content", shape).alias("j"))
    empty = F.create_map().cast("map<string,string>")
    both = F.array_union(F.map_entries(F.coalesce("j.dependencies", empty)), F.map_entries(F.coalesce("j.devDependencies", empty)))
    rows = parsed.select("manifest_id", F.posexplode(both).alias("pos", "e")).where(~F.col("e.value").rlike(r"^[\[{]"))
    return rows.select("manifest_id", "pos", F.col("e.key").alias("name"), F.col("e.value").alias("spec"), F.nullif(F.regexp_extract("e.value", r"(\d+\.\d+\.\d+)", 1), F.lit("")).alias("resolved"))


def classify(packages: DataFrame, advisories: DataFrame, latest: DataFrame) -> DataFrame:
    """status, severity and advisory of each package (id, ecosystem, name, resolved).

    ``advisories`` (ecosystem, name, ord, range, advisory, advisory_severity): the first in order whose range has the version
    wins. Otherwise two major versions behind ``latest`` (ecosystem, name, latest_major) is outdated; the rest unknown."""
    own = packages.withColumn("version", text.version_triple(F.coalesce("resolved", F.lit(""))))
    keys = ["ecosystem", "name"]
    hit = own.select("id", *keys, "version").join(advisories, keys).where(F.col("version").isNotNull() & text.version_in_range(F.col("version"), F.col("range")))
    first = hit.groupBy("id").agg(F.min(F.struct("ord", "advisory", "advisory_severity")).alias("a"))
    joined = own.join(first, "id", "left").join(latest, keys, "left")
    behind = F.col("version") < F.struct((F.col("latest_major") - 1).alias("major"), F.lit(0).alias("minor"), F.lit(0).alias("patch"))
    status = F.when(F.col("a").isNotNull(), "known_vulnerable").when(behind, "outdated").otherwise("unknown")
    return joined.select("id", *keys, "resolved", status.alias("status"), F.coalesce("a.advisory_severity", F.lit("")).alias("severity"), F.coalesce("a.advisory", F.lit("")).alias("advisory"))


def keep_first(packages: DataFrame, *scope: str) -> DataFrame:
    """Of equal packages (ecosystem, lower-case name, version) within ``scope`` the first in order of ``ord``."""
    place = F.row_number().over(Window.partitionBy(*scope, "ecosystem", F.lower("name"), F.coalesce("resolved", "spec", F.lit(""))).orderBy("ord"))
    return packages.withColumn("place", place).where(F.col("place") == 1).drop("place")


def report_order() -> list:
    rank = F.when(F.col("status") == "known_vulnerable", 0).when(F.col("status") == "outdated", 1).otherwise(2)
    return [rank, severity_rank(F.col("severity")), F.lower("name"), F.col("id")]

"""Packages of manifest and lock files, each format as one expression over the content; and the report on them.

Every expression gives an array of (name, spec, resolved) in the order of the file. Patterns are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.text import let, split_lines, strip
from auditspark.operators import dependencies, tree

ENTRY = "array<struct<name:string,spec:string,resolved:string>>"


def entry(name: Column, spec: Column, resolved: Column) -> Column:
    return F.struct(name.alias("name"), spec.alias("spec"), resolved.alias("resolved"))


def some(text: Column) -> Column:
    """Null for empty text."""
    return F.nullif(text, F.lit(""))


def group(text: Column, pattern: str, n: int = 1) -> Column:
    return F.regexp_extract(text, pattern, n)


def lines_with(lines: Column, pattern: str, make) -> Column:
    return F.transform(F.filter(lines, lambda s: s.rlike(pattern)), make)


def found(text: Column, pattern: str, make, groups: int = 2) -> Column:
    """One entry for each match, made of its groups."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)).alias(f"g{k}") for k in range(groups)]
    return F.transform(F.arrays_zip(*parts), lambda x: make(*[x[f"g{k}"] for k in range(groups)]))


def numeric(version: Column, strip_off: str) -> Column:
    """The version without leading signs, where it then begins with a digit."""
    bare = F.regexp_replace(version, f"^[{strip_off}]+", "")
    return F.when(bare.rlike(r"^\d"), bare)


REQUIREMENT = r"^([A-Za-z0-9_.\-]+)\s*([<>=!~\^].*)?$"


def requirements(content: Column) -> Column:
    def make(s: Column) -> Column:
        spec = strip(group(s, REQUIREMENT, 2))
        pin = F.coalesce(some(group(spec, r"==\s*([A-Za-z0-9_.\-]+)")), some(group(spec, r"~=\s*([A-Za-z0-9_.\-]+)")))
        return entry(group(s, REQUIREMENT), some(spec), pin)

    return lines_with(F.filter(F.transform(split_lines(content), strip), lambda s: ~s.rlike("^(#|-|$)")), REQUIREMENT, make)


def pyproject(content: Column) -> Column:
    block = group(content, r"(?ms)^dependencies\s*=\s*\[(.*?)\]")
    quoted = F.transform(F.regexp_extract_all(block, F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1)), strip)
    spec = lambda s: strip(group(s, REQUIREMENT, 2))
    declared = lines_with(quoted, REQUIREMENT, lambda s: entry(group(s, REQUIREMENT), some(spec(s)), some(group(spec(s), r"(?:==|>=)\s*([0-9][A-Za-z0-9_.\-]*)"))))
    form = r"^\s*([A-Za-z0-9_.\-]+)\s*=\s*[\"']([^\"']+)[\"']"
    poetry = lines_with(split_lines(group(content, r"(?s)\[tool\.poetry\.dependencies\](.*?)(?:\n\[|\z)")), form, lambda s: entry(group(s, form), group(s, form, 2), numeric(group(s, form, 2), r"\^~")))
    both = F.concat(declared, F.filter(poetry, lambda x: F.lower(x["name"]) != "python"))
    return let(both, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, 1, i), lambda y: F.lower(y["name"]) == F.lower(x["name"]))))


def json_maps(content: Column, first: str, second: str) -> Column:
    """The entries of two maps of a JSON object, those whose value is no object or array."""
    parsed = F.from_json(content, f"struct<`{first}`:map<string,string>,`{second}`:map<string,string>>")
    empty = F.create_map().cast("map<string,string>")
    entries = [F.map_entries(F.coalesce(parsed[x], empty)) for x in (first, second)]
    return F.filter(F.concat(*entries), lambda e: ~F.coalesce(e["value"], F.lit("{")).rlike(r"^[\[{]"))


def package_json(content: Column) -> Column:
    return F.transform(json_maps(content, "dependencies", "devDependencies"), lambda e: entry(e["key"], some(e["value"]), some(group(e["value"], r"(\d+\.\d+\.\d+)"))))


def composer_json(content: Column) -> Column:
    kept = F.filter(json_maps(content, "require", "require-dev"), lambda e: e["key"] != "php")
    return F.transform(kept, lambda e: entry(e["key"], e["value"], some(group(e["value"], r"(\d+\.\d+(?:\.\d+)?)"))))


def go_mod(content: Column) -> Column:
    form = r"^\s*([\w./\-]+\.[\w./\-]+)\s+v([A-Za-z0-9.\-+]+)"
    return lines_with(F.transform(split_lines(content), strip), form, lambda s: entry(group(s, form), F.concat(F.lit("v"), group(s, form, 2)), group(s, form, 2)))


def gemfile(content: Column) -> Column:
    form = r"^\s*gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?"
    return lines_with(split_lines(content), form, lambda s: entry(group(s, form), some(group(s, form, 2)), numeric(group(s, form, 2), "~><= ")))


def lock(content: Column) -> Column:
    """Package sections, else names with versions in parentheses, else the two maps of a JSON lock."""
    same = lambda name, version: entry(name, version, version)
    sections = found(content, r"(?s)name\s*=\s*[\"']([^\"']+)[\"'].*?version\s*=\s*[\"']([^\"']+)[\"']", same)
    gems = found(content, r"(?m)^\s{2,}([A-Za-z0-9_.\-]+)\s+\((\d[\w.\-+]*)\)", same)
    parsed = F.from_json(content, "struct<default:map<string,struct<version:string>>,develop:map<string,struct<version:string>>>")
    empty = F.create_map().cast("map<string,struct<version:string>>")
    maps = F.concat(*[F.map_entries(F.coalesce(parsed[x], empty)) for x in ("default", "develop")])
    version = lambda e: some(F.regexp_replace(F.coalesce(e["value"]["version"], F.lit("")), "^=+", ""))
    return F.when(content.contains("[[package]]"), sections).when(F.size(gems) > 0, gems).otherwise(F.transform(maps, lambda e: entry(e["key"], version(e), version(e))))


def cargo_toml(content: Column) -> Column:
    form, table = r"^([A-Za-z0-9_\-]+)\s*=\s*[\"']([^\"']+)[\"']", r"^([A-Za-z0-9_\-]+)\s*=\s*\{"
    lines = F.transform(split_lines(group(content, r"(?s)\[dependencies\](.*?)(?:\n\[|\z)")), strip)
    make = lambda s: F.when(s.rlike(form), entry(group(s, form), group(s, form, 2), numeric(group(s, form, 2), r"\^~"))).otherwise(entry(group(s, table), some(F.lit("")), some(F.lit(""))))
    return lines_with(lines, f"{form}|{table}", make)


def cargo_lock(content: Column) -> Column:
    return found(content, r'name\s*=\s*"([^"]+)"\s*\nversion\s*=\s*"([^"]+)"', lambda name, version: entry(name, version, version))


def pom(content: Column) -> Column:
    blocks = F.regexp_extract_all(content, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    of = lambda b, tag: group(b, rf"<{tag}>([^<]+)</{tag}>")

    def make(b: Column) -> Column:
        version = strip(of(b, "version"))
        return entry(F.concat(strip(of(b, "groupId")), F.lit(":"), strip(of(b, "artifactId"))), some(version), F.when(version.rlike(r"^\d[\w.\-]*$"), version))

    return F.transform(F.filter(blocks, lambda b: (of(b, "groupId") != "") & (of(b, "artifactId") != "")), make)


def gradle(content: Column) -> Column:
    form = r"(?:implementation|api|compile|runtimeOnly|testImplementation|compileOnly)\s+[`'\"]([^:'\"]+):([^:'\"]+):([^'\"]+)[`'\"]"
    return found(content, form, lambda g, a, v: entry(F.concat(g, F.lit(":"), a), v, F.when(v.rlike(r"^\d[\w.\-]*$"), v)), 3)


PARSERS = {
    "requirements.txt": requirements, "pyproject.toml": pyproject, "Pipfile": lock, "Pipfile.lock": lock, "poetry.lock": lock, "package.json": package_json, "go.mod": go_mod, "Gemfile": gemfile, "Gemfile.lock": lock,
    "Cargo.toml": cargo_toml, "Cargo.lock": cargo_lock, "pom.xml": pom, "build.gradle": gradle, "build.gradle.kts": gradle, "composer.json": composer_json,
}


def packages(manifests: DataFrame) -> DataFrame:
    """``manifests`` (repo, path, ecosystem, content) as rows repo, path, ecosystem, pos, name, spec, resolved; a file's name
    chooses its parser."""
    by: dict = {}
    for name, parser in PARSERS.items():
        by.setdefault(parser, []).append(name)
    parts = []
    for parser, names in by.items():  # a plan of each format, so that a row is parsed by its own format only
        own = manifests.where(F.substring_index("path", "/", -1).isin(*names))
        parts.append(own.select("repo", "path", "ecosystem", F.posexplode(parser(F.col("content")).cast(ENTRY)).alias("pos", "e")).select("repo", "path", "ecosystem", "pos", "e.*"))
    return reduce(DataFrame.unionByName, parts)


def unique_packages(rows: DataFrame) -> DataFrame:
    """Of each repository's equal packages the first by manifest and place."""
    return dependencies.keep_first(rows.withColumn("ord", F.struct("path", "pos")), "repo").drop("ord")


def advisory_url(advisory: Column) -> Column:
    prefix = F.substring_index(advisory, "-", 1)
    return F.when(prefix == "CVE", F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), advisory)).when(prefix.isin("GHSA", "PYSEC"), F.concat(F.lit("https://github.com/advisories/"), advisory)).otherwise("")


def report(classified: DataFrame, status: str | None = None, ecosystem: str | None = None, severity: str | None = None) -> DataFrame:
    """Rows by status, severity and name, each with its place and the repository's summary; filters drop rows, but leave the
    summary as it is."""
    whole = Window.partitionBy("repo")
    count = lambda s: F.count_if(F.col("status") == s).over(whole)
    rows = classified.withColumn("total", F.count(F.lit(1)).over(whole)).withColumn("vulnerable", count("known_vulnerable")).withColumn("outdated", count("outdated"))
    for column, value in (("status", status), ("ecosystem", ecosystem), ("severity", severity)):
        if value is not None:
            rows = rows.where(F.lower(column) == value.lower())
    return rows.withColumn("place", F.row_number().over(whole.orderBy(*dependencies.report_order())))


def manifest_rows(files: DataFrame, ignored: bool = False) -> DataFrame:
    return packages(tree.manifests(files, ignored))

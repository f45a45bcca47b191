"""What a code host and a scan service say: commits, pull requests, lists of scans, messages, labels.

JSON answers are read with fixed schemas. Texts and limits are fixed values of the service."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.text import let, occurrences, strip
from auditspark.operators.external import has_any
from auditspark.operators.relational import first_by

COMMIT = "struct<sha:string,parents:array<string>,author:string,message:string,stats:struct<additions:long,deletions:long>,files:array<struct<filename:string,status:string,additions:long,deletions:long,changes:long,patch:string,raw_url:string>>>"
PULL = "struct<number:long,title:string,author:string,state:string,additions:long,deletions:long,head_sha:string,base_sha:string>"
REPOSITORY = "struct<stars:long,forks:long,issues:long,languages:map<string,long>>"


def recent_commits(commits: DataFrame, most: int = 30) -> DataFrame:
    """The newest commits (repo, sha, author, date, message) of each repository, with the first line of their message."""
    newest = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("date"), F.desc("sha")))
    rows = commits.withColumn("place", newest).where(F.col("place") <= most)
    return rows.select("repo", "place", F.substring("sha", 1, 8).alias("short_sha"), F.coalesce("author", F.lit("unknown")).alias("author"), "date", F.substring(F.substring_index(F.coalesce("message", F.lit("")), "\n", 1), 1, 200).alias("message"))


def commit_details(answers: DataFrame) -> DataFrame:
    """id and what its JSON answer says of a commit; without totals, those of the files are summed."""
    own = answers.select("id", F.from_json("json", COMMIT).alias("c"))
    total = lambda name: F.coalesce(F.col(f"c.stats.{name}"), F.aggregate(F.col("c.files"), F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f[name], F.lit(0))))
    return own.select("id", "c.sha", F.get("c.parents", 0).alias("parent_sha"), total("additions").alias("additions"), total("deletions").alias("deletions"), F.size("c.files").alias("files"))


def changed_files(answers: DataFrame) -> DataFrame:
    return answers.select("id", F.explode(F.from_json("json", COMMIT)["files"]).alias("f")).select("id", "f.*")


def pull_requests(answers: DataFrame, state: str | None = None) -> DataFrame:
    """The headers of pull requests, the largest number first within a repository."""
    own = answers.select("repo", F.from_json("json", PULL).alias("p")).select("repo", "p.*")
    own = own if state is None else own.where(F.col("state") == state)
    return own.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("number"))))


def repository_metadata(answers: DataFrame) -> DataFrame:
    own = answers.select("repo", F.from_json("json", REPOSITORY).alias("r")).select("repo", "r.*")
    entries = F.coalesce(F.map_entries("languages"), F.array().cast("array<struct<key:string,value:long>>"))
    top = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("n"), e["key"].alias("name"))))
    return own.select("repo", "stars", "forks", "issues", top["name"].alias("language"), F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["value"]).alias("bytes"))


HOST = "github.com"


def repository_name(url: Column) -> Column:
    """owner/name of a link to a repository or of a path; null where there are not two parts."""
    linked = rf"{HOST.replace('.', chr(92) + '.')}[:/]([^/]+)/([^/.]+)"

    def decide(s: Column) -> Column:
        parts = F.filter(F.split(s, "/"), lambda p: p != "")
        at = F.array_position(parts, HOST)
        after = F.when((at > 0) & (at + 1 < F.size(parts)), F.concat_ws("/", F.get(parts, at.cast("int")), F.get(parts, at.cast("int") + 1)))
        last = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
        found = F.concat_ws("/", F.regexp_extract(s, linked, 1), F.regexp_extract(s, linked, 2))
        return F.when(s.rlike(linked), found).when(F.size(parts) == 2, last).when(F.size(parts) > 2, F.coalesce(after, last))

    return let(strip(F.coalesce(url, F.lit(""))), decide)


def relative_label(seconds: Column) -> Column:
    """How long ago, from seconds past; negative ones are ahead."""
    n = F.floor(F.abs(seconds))
    unit = lambda size, word: F.concat(F.floor(n / size).cast("string"), F.lit(f" {word}"), F.when(F.floor(n / size) == 1, "").otherwise("s"))
    label = F.when(n < 3600, unit(60, "minute")).when(n < 86400, unit(3600, "hour")).otherwise(unit(86400, "day"))
    return F.when(n < 60, "just now").when(seconds >= 0, F.concat(label, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), label))


def utc_time(text: Column) -> Column:
    """A time as text to a time without zone in UTC; text without a zone is UTC already."""
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.when(zoned, F.to_utc_timestamp(F.to_timestamp(text), F.current_timezone())).otherwise(F.try_to_timestamp(F.regexp_replace(text, "T", " "))).cast("timestamp_ntz")


#: Characters that a page printer lacks, and what stands for them.
PRINTED = {
    "“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "•": "*", "→": "->", "✔": "[Yes]", "✖": "[No]", "\U0001f40d": "Python", "\U0001f7e8": "JS", "\U0001f537": "TS", "☕": "Java",
    "⚙️": "C/C++", "\U0001f980": "Rust", "\U0001f418": "PHP", "\U0001f439": "Go", "\U0001f34e": "Swift", "\U0001f310": "HTML/CSS", "\U0001f680": "Launch", "⚠️": "Warning", "\U0001f6d1": "Error", "✅": "OK", "❌": "Fail",
    "\U0001f4c1": "Folder", "\U0001f4c4": "File", "\U0001f4a1": "Tip", "\U0001f50d": "Scan", "\U0001f4ca": "Chart", "\U0001f6e1️": "Security", "\U0001f4af": "100", "⭐": "Star", "\U0001f374": "Fork",
}


def printable(text: Column) -> Column:
    """Text for a printer of Latin letters: known signs in words, others as question marks."""
    for sign, words in PRINTED.items():
        text = F.replace(text, F.lit(sign), F.lit(words))
    return F.regexp_replace(text, r"[^\x00-\xFF]", "?")


def error_class(message: Column) -> Column:
    """auth, rate_limit, model or other, by what a message says."""
    m = F.lower(message)
    auth = has_any(m, ("401", "403", "invalid_api_key", "invalid api key", "unauthorized", "authentication")) | (m.contains("api key") & m.contains("expired"))
    rate = has_any(m, ("429", "rate_limit", "rate limit", "quota", "limit exceeded", "too many requests"))
    gone = has_any(m, ("does not exist", "not found", "no longer supported", "decommissioned", "deprecated", "do not have access", "does not have access", "not have permission", "unavailable", "404", "model_not_found"))
    return F.when(auth, "auth").when(rate, "rate_limit").when(m.contains("model") & gone, "model").otherwise("other")


def friendly_error(provider: Column, message: Column) -> Column:
    """What a user is told of a failed call."""
    name, kind = F.initcap(F.trim(F.lower(provider))), error_class(message)
    said = lambda before, after: F.concat(F.lit(before), name, F.lit(after))
    return (
        F.when(kind == "auth", said("The ", " API key is missing, invalid, or expired. Please update your API key in Settings."))
        .when(kind == "rate_limit", said("The ", " API rate limit was exceeded. Please wait a moment and try again."))
        .when(kind == "model", said("The selected ", " model is not available on your account. Please choose a different model in Settings."))
        .otherwise("LLM provider is not configured correctly. Please update your API key and model in Settings.")
    )


def fix_checks(fixes: DataFrame) -> DataFrame:
    """id, ok, message, imports_ok of proposed files (id, path, code): Python parses, scripts have balanced braces and
    parentheses, others are not empty. Parsing runs in Arrow batches, on Python files only."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    own = fixes.withColumn("ext", ext)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *python_check(code or "")) for key, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.bool_(), pa.string(), pa.bool_()))], names=["id", "ok", "message", "imports_ok"])

    python = own.where(F.col("ext").isin(".py", "")).select("id", "code").mapInArrow(parse, "id long, ok boolean, message string, imports_ok boolean")
    braces, parens = (occurrences(F.col("code"), a) - occurrences(F.col("code"), b) for a, b in ("{}", "()"))
    script = F.when(braces != 0, F.format_string("Unbalanced braces: %d", braces)).when(parens != 0, F.format_string("Unbalanced parentheses: %d", parens)).otherwise("Syntax OK (brace/paren balance)")
    plain = F.when(strip(F.col("code")) == "", "Empty code").otherwise("Syntax OK (basic check)")
    message = F.when(F.col("ext").isin(".js", ".ts", ".jsx", ".tsx"), script).otherwise(plain)
    rest = own.where(~F.col("ext").isin(".py", "")).select("id", message.alias("message"))
    return python.unionByName(rest.select("id", F.col("message").startswith("Syntax OK").alias("ok"), "message", F.lit(True).alias("imports_ok")))


def python_check(code: str) -> tuple[bool, str, bool]:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as error:
        return False, f"Python syntax error at line {getattr(error, 'lineno', None)}", True
    names = [a.name for x in ast.walk(tree) if isinstance(x, ast.Import) for a in x.names] + [x.module for x in ast.walk(tree) if isinstance(x, ast.ImportFrom) and x.module]
    return True, "Syntax OK", all(n.replace("_", "").replace(".", "").isalnum() for n in names)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The keyed digest in hexadecimal digits, of two plain digests."""
    pads = [bytes(b ^ x for b in key.ljust(64, b"\0")) for x in (0x36, 0x5C)]
    inner, outer = (F.unhex(F.lit(p.hex())) for p in pads)
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signed(events: DataFrame, key: bytes, body: str = "body", signature: str = "signature") -> DataFrame:
    """The webhook events whose signature fits their body."""
    return events.where(F.col(signature) == F.concat(F.lit("sha256="), hmac_sha256(F.col(body), key)))


def with_latest(left: DataFrame, history: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Each row with the newest row of ``history`` for its keys, where there is one."""
    return left.join(first_by(history, keys, F.desc(time), F.desc(tie)), keys, "left")


def rematerialised(hits: DataFrame, cached: DataFrame) -> DataFrame:
    """The cached results (source_id, ...) of each hit (source_id, analysis_id) under the hit's own id."""
    return hits.join(cached, "source_id").drop("source_id")


def heartbeats(events: DataFrame, silence_s: float = 5.0) -> DataFrame:
    """key, at of the heartbeats of a progress channel: one where no event follows another, not terminal, for a while."""
    own = Window.partitionBy("key").orderBy("at", "event_id")
    quiet = events.withColumn("next", F.lead("at").over(own)).where(~F.col("terminal") & (F.coalesce("next", F.lit(float("inf"))) - F.col("at") > silence_s))
    return quiet.select("key", (F.col("at") + silence_s).alias("at"), "event_id")

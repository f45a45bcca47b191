"""Findings that come from outside: reading them from noisy text, weighing them, packing the texts sent for them.

Word lists, scores and limits are fixed values of the service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions.text import let, split_lines, strip

SEVERITY_SCORE = {"Critical": 0.95, "High": 0.85, "Medium": 0.75, "Low": 0.60, "Info": 0.30}
SMELL_SCORE = {"Critical": 0.90, "High": 0.85, "Medium": 0.75, "Low": 0.55, "Info": 0.30}
KEEP_AT = 0.75
FALSE_ISSUES = ("missing error handling", "missing authentication", "hardcoded secret", "hardcoded api key", "hardcoded key", "insecure cryptography", "weak cryptography")
#: What a line shows, and the issues that are false then.
FALSE_LINES = (
    (r"(?i)BaseSettings|pydantic\.BaseModel|@dataclass", ("missing auth", "hardcoded secret", "hardcoded api")),
    (r"(?i)\.SETTINGS\.|settings\.|SETTINGS\.|Config\.|config\.", ("hardcoded secret", "hardcoded api", "exposed credential", "credential leak", "hardcoded path", "hardcoded database")),
    (r"(?i)os\.getenv|os\.environ\.get|os\.environ\[", ("hardcoded secret", "hardcoded api", "exposed credential", "credential leak")),
    (r"(?i)^import\s+|^from\s+", ("missing auth", "missing authentic", "insecure", "missing input validation")),
    (r"(?i)load_dotenv\(\)", ("missing error handling", "hardcoded", "security risk")),
    (r"(?i)print\(|logger\.|logging\.", ("information disclosure", "information leak", "sensitive data")),
)
#: Categories of security findings that are known.
CATEGORIES = ("Security", "Authentication", "Authorization", "Secrets", "Injection", "Input Validation", "Dependency Risks", "Cryptography", "File Upload", "Session Security", "API Security")
#: What a line shows, and the words of smells that are made up then.
FAKE_LINES = ((r"(?i)^import\s+|^from\s+", ("long import", "too many import")), (r"(?i)load_dotenv\(\)", ("missing error handling", "error handling")), (r"(?i)#\s*TODO|#\s*FIXME", ("comment", "todo")))
#: Second arguments of reads of the environment that give nothing away, and words in those that do.
SAFE_DEFAULTS = (
    "dev", "development", "prod", "production", "local", "localhost", "test", "testing", "default", "sqlite:///test.db", "postgresql://", "mysql://", "mongodb://", "redis://", "0.0.0.0", "127.0.0.1", "", "none",
)
SECRET_WORDS = ("key", "secret", "password", "token", "auth", "pwd")
SMELL_TYPES = (
    "long function", "long method", "long class", "duplicate code", "high complexity", "excessive complexity", "unused variable", "unused import", "dead code", "magic number", "magic string", "deep nesting", "excessive nesting",
    "god object", "large file", "large parameter list", "too many parameters", "long parameter list",
)
FAKE_SMELLS = (
    "long import list", "long list of imports", "too many imports", "missing error handling", "poor naming", "bad naming", "comment smell", "too many comments", "missing comments", "line too long", "long line", "long lines",
    "inconsistent indentation", "trailing whitespace", "missing docstring", "missing type hint", "missing type annotation", "unnecessary import",
)
CHUNK_LINES, BATCH_UNITS, BATCH_CHARS = 400, 4, 14_000
LAYERS = {
    "frontend/ui": ("frontend", "client", "ui", "web", "views", "pages", "components"), "backend/api": ("backend", "api", "server", "routers", "routes", "controllers", "views"),
    "services/domain": ("services", "domain", "core", "business", "usecases"), "data/models": ("models", "entities", "repositories", "db", "database", "dao"), "tests": ("tests", "test", "spec", "__tests__"),
    "scripts/tooling": ("scripts", "tools", "bin"), "docs": ("docs", "documentation"), "infrastructure": ("infra", "infrastructure", "deploy", "k8s", "terraform"),
}
ENTRY_NAMES = ("main.py", "app.py", "manage.py", "wsgi.py", "asgi.py", "index.js", "index.ts", "index.tsx", "main.js", "main.ts", "server.js", "server.ts", "app.js", "app.ts", "cli.py", "__init__.py")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    test = text.contains(words[0])
    for w in words[1:]:
        test = test | text.contains(w)
    return test


def _graded(issue: Column, suggestion: Column, severity: Column, table: dict[str, float]) -> Column:
    base = F.lit(0.5)
    for name, value in table.items():
        base = F.when(severity == name, value).otherwise(base)
    base = base - F.when(F.length(issue) < 20, 0.15).otherwise(0.0) - F.when(F.length(suggestion) < 30, 0.10).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))


def shows(line: Column, before: Column, said: Column, table: tuple) -> Column:
    """Does the line or the quoted code show what makes the words of the finding doubtful?"""
    found = F.lit(False)
    for pattern, words in table:
        found = found | ((strip(line).rlike(pattern) | F.lower(before).rlike(pattern)) & has_any(said, words))
    return found


def words_of(issue: Column, suggestion: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(issue, F.lit("")), F.coalesce(suggestion, F.lit(""))))


def security_confidence(issue: Column, suggestion: Column, severity: Column, line: Column, before: Column, category: Column | None = None) -> Column:
    """0 where line and issue are both known false, 0.5 where the line alone is, 0.3 where the category is none that is
    known; otherwise by severity and wording."""
    said = words_of(issue, suggestion)
    false_line = shows(line, before, said, FALSE_LINES)
    graded = _graded(issue, F.coalesce(suggestion, F.lit("")), severity, SEVERITY_SCORE)
    if category is not None:
        graded = F.when((F.coalesce(category, F.lit("")) != "") & ~category.isin(*CATEGORIES), 0.3).otherwise(graded)
    return F.when(false_line & has_any(said, FALSE_ISSUES), 0.0).when(false_line, 0.5).otherwise(graded)


def smell_confidence(issue: Column, suggestion: Column, severity: Column, line: Column | None = None, before: Column | None = None) -> Column:
    """0 where the words or the line are of a smell that is made up, 0.3 where the smell is none that is known."""
    said = words_of(issue, suggestion)
    made_up = has_any(said, FAKE_SMELLS)
    if line is not None:
        made_up = made_up | shows(line, F.lit("") if before is None else before, said, FAKE_LINES)
    return F.when(made_up, 0.0).when(~has_any(said, SMELL_TYPES), 0.3).otherwise(_graded(issue, F.coalesce(suggestion, F.lit("")), severity, SMELL_SCORE))


def risky_default(code: Column) -> Column:
    """Has the first call that ends in a quoted argument one that looks like a secret?"""
    form = r",\s*(['\"])(.*?)\1\s*\)"
    value = F.regexp_extract(code, form, 2)
    telling = has_any(F.lower(value), SECRET_WORDS) | value.rlike(r"^[A-Za-z0-9_\-+]{8,}$")
    return code.rlike(form) & ~F.lower(value).isin(*SAFE_DEFAULTS) & (F.length(value) > 6) & telling


def is_settings(line: Column, before: Column) -> Column:
    """Is the finding on a read of the environment without a risky default, or on a class of settings?"""
    either = lambda word: F.contains(line, F.lit(word)) | F.contains(before, F.lit(word))
    reads = (either("os.getenv") | either("os.environ")) & ~risky_default(F.concat_ws(" ", line, before))
    return reads | either("BaseSettings") | (F.contains(line, F.lit("class")) & either("Settings"))


def accepted(findings: DataFrame, line: Column) -> DataFrame:
    """The findings (severity, category, issue, suggestion, before_code, and others as they are) that are sure enough and on
    no settings, with what they lack filled in. ``line`` is the text of the finding's line."""
    text, before = F.coalesce(strip(line), F.lit("")), F.coalesce("before_code", F.lit(""))
    sure = security_confidence(F.coalesce("issue", F.lit("")), F.col("suggestion"), F.coalesce("severity", F.lit("Low")), text, before, F.col("category"))
    filled = {"severity": "Medium", "category": "Security", "issue": "Potential vulnerability found", "suggestion": "Please verify and secure this code.", "before_code": ""}
    kept = findings.withColumn("_sure", sure).where((F.col("_sure") >= KEEP_AT) & ~is_settings(text, before)).drop("_sure")
    return kept.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in filled.items()})


RECOMMENDED = (
    ("critical", "Fix %d critical security issue(s) first"), ("high", "Review %d high-severity security finding(s)"), ("vulnerable", "Update %d vulnerable dependenc(y/ies)"),
    ("quality", "Refactor %d code quality issue(s)"), ("outdated", "Update %d outdated dependenc(y/ies)"),
)


def recommendations(most: int = 4) -> Column:
    """What to do first, by the columns critical, high, vulnerable, quality and outdated; null counts as none."""
    each = [F.when(F.col(c) > 0, F.format_string(text, F.col(c).cast("long"))) for c, text in RECOMMENDED]
    return F.slice(F.filter(F.array(*each), lambda x: x.isNotNull()), 1, most)


UNLIKELY = r"^(#|//|/\*|\*|import |from |package )"


def evidence_holds(lines: Column, number: Column, before: Column, issue: Column) -> Column:
    """Does a finding fit the file? Its line exists; the code that it quotes and the line contain each other, or a longer word
    of the issue stands in the line; failing these, the line is one that can have a finding at all."""
    tidy = lambda s: F.lower(F.regexp_replace(strip(s), r"\s+", " "))

    def decide(actual: Column) -> Column:
        line, said = tidy(actual), tidy(F.coalesce(before, F.lit("")))
        words = F.filter(F.split(F.lower(issue), r"\s+"), lambda w: F.length(w) > 3)
        named = F.exists(words, lambda w: F.contains(line, w))
        comment = actual.rlike(r"^(#|//|/\*|\*)") | (actual == "")
        quoted = F.contains(line, said) | F.contains(said, line) | named | ~(actual.rlike(UNLIKELY) | (actual == ""))
        return F.when(said != "", quoted).otherwise(named | ~comment)

    return F.when((number < 1) | (number > F.size(lines)), False).otherwise(let(strip(F.get(lines, number - 1)), decide))


def findings_from_text(content: Column, schema: str) -> Column:
    """An array of findings from an answer: fenced, plain, or within other text; a single object is an array of one."""
    fenced = F.regexp_extract(content, r"```(?:json)?\s*([\s\S]*?)```", 1)
    text = strip(F.when(content.rlike(r"```(?:json)?\s*[\s\S]*?```"), fenced).otherwise(content))

    def parse(s: Column) -> Column:
        array = lambda x: F.from_json(x, f"array<{schema}>")
        single = lambda x: F.transform(F.filter(F.array(F.from_json(x, schema)), lambda v: v.isNotNull()), lambda v: v)
        inner = F.regexp_extract(s, r"(\[\s*\{[\s\S]*\}\s*\])", 1)
        one = F.regexp_extract(s, r"(\{\s*\"file\"[\s\S]*\})", 1)
        return F.when(s.startswith("["), array(s)).when(s.startswith("{"), single(s)).when(inner != "", array(inner)).when(one != "", single(one))

    return F.coalesce(let(text, parse), F.array().cast(f"array<{schema}>"))


def variants_from_text(rows: DataFrame, column: str) -> DataFrame:
    """The other columns of ``rows`` with pos and value, a variant, of each finding in the answer: its items where it is
    an array, or itself. An answer is fenced, or whole JSON, or has an array of objects or an object of a file in it."""
    fenced = F.regexp_extract(column, r"```(?:json)?\s*([\s\S]*?)```", 1)
    answer = strip(F.when(F.col(column).rlike(r"```(?:json)?\s*[\s\S]*?```"), fenced).otherwise(F.coalesce(column, F.lit(""))))
    within = [F.nullif(F.regexp_extract("_answer", form, 1), F.lit("")) for form in (r"(\[\s*\{[\s\S]*\}\s*\])", r'(\{\s*"file"[\s\S]*\})')]
    parsed = rows.withColumn("_answer", answer).withColumn("_json", F.coalesce(*[F.try_parse_json(x) for x in (F.col("_answer"), *within)]))
    kept = [c for c in rows.columns if c != column]
    kind = F.schema_of_variant("_json")
    many = F.try_variant_get("_json", "$", "array<variant>")
    items = F.when(kind.startswith("ARRAY"), many).when(kind.startswith("OBJECT"), F.array("_json"))
    return parsed.select(*kept, F.posexplode(items).alias("pos", "value"))


def chunks(files: DataFrame, lines: int = CHUNK_LINES) -> DataFrame:
    """repo, file_id, chunk, chars: pieces of ``lines`` lines; an empty file is one empty piece."""
    own = files.select("repo", "file_id", F.explode(F.array(split_lines(F.col("content")))).alias("ls"))
    number = F.greatest(F.lit(1), F.ceil(F.size("ls") / lines)).cast("int")
    rows = own.select("repo", "file_id", "ls", F.explode(F.sequence(F.lit(1), number)).alias("chunk"))
    return rows.select("repo", "file_id", "chunk", F.length(F.array_join(F.slice("ls", (F.col("chunk") - 1) * lines + 1, F.lit(lines)), "\n")).alias("chars"))


def pack(units: DataFrame, key: str, units_most: int = BATCH_UNITS, chars_most: int = BATCH_CHARS) -> DataFrame:
    """Greedy batches of a file's units in order: a unit over the limit closes the batch and stands alone.

    A fold over one file's units; files are packed apart, so a fold stays as long as its file."""
    ordered = units.groupBy("repo", key).agg(F.sort_array(F.collect_list(F.struct("chunk", "chars"))).alias("units"))

    def step(acc: Column, u: Column) -> Column:
        big = u["chars"] > chars_most
        full = (acc["count"] > 0) & ((acc["count"] >= units_most) | (acc["total"] + u["chars"] > chars_most) | big)
        batch = acc["batch"] + full.cast("int")
        placed = F.array_append(acc["out"], F.struct(u["chunk"].alias("chunk"), u["chars"].alias("chars"), batch.alias("batch")))
        return F.struct(
            (batch + big.cast("int")).alias("batch"), F.when(big, 0).when(full, 1).otherwise(acc["count"] + 1).cast("int").alias("count"), F.when(big, 0).when(full, u["chars"]).otherwise(acc["total"] + u["chars"]).cast("long").alias("total"), placed.alias("out")
        )

    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("count"), F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<chunk:int,chars:int,batch:int>>").alias("out"))
    return ordered.select("repo", key, F.explode(F.aggregate("units", start, step)["out"]).alias("u")).select("repo", key, "u.*")


def layers(paths: DataFrame) -> DataFrame:
    """repo, layer, evidence: top directories that mark a layer."""
    top = paths.where(F.col("path").contains("/")).select("repo", F.lower(F.substring_index("path", "/", 1)).alias("dir")).distinct()
    marks = F.filter(F.array(*[F.when(F.col("dir").isin(*v), k) for k, v in LAYERS.items()]), lambda x: x.isNotNull())
    return top.select("repo", "dir", F.explode(marks).alias("layer")).groupBy("repo", "layer").agg(F.array_join(F.sort_array(F.collect_set("dir")), ",").alias("evidence"))


def entry_points(paths: DataFrame) -> DataFrame:
    """Files that start something, at most two directories deep."""
    depth = F.size(F.split("path", "/")) - 1
    return paths.where(F.substring_index("path", "/", -1).isin(*ENTRY_NAMES) & (depth <= 2)).select("repo", "path", F.when(depth == 0, "root").otherwise("package").alias("level"))

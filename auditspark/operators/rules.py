"""Declarative security rules over whole files, and code rules over lines.

A rule is a pattern with what it reports; patterns, severities and texts are fixed values of the service. Patterns are
searched in whole texts and matches reported by line. Rules that look around their match, or drop matches by what
stands near, have functions of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions import text
from auditspark.operators import clones, inventory


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    severity: str
    cwe: str
    issue: str


def _rules(name: str, cwe: str, *rows: tuple[str, str, str]) -> list[Rule]:
    return [Rule(name, "(?i)" + pattern, severity, cwe, issue) for pattern, issue, severity in rows]


#: Fixed values.
RULES = [
    *_rules(
        "xss", "CWE-79",
        (r"\.innerHTML\s*=", "innerHTML Assignment", "High"), (r"dangerouslySetInnerHTML", "dangerouslySetInnerHTML", "High"), (r"document\.write\s*\(", "document.write()", "High"),
        (r"\.insertAdjacentHTML\s*\(", "insertAdjacentHTML", "High"), (r"v-html\s*=", "v-html (Vue)", "High"), (r"\{\{\{.*\}\}\}", "Unescaped Template Variable", "High"),
    ),
    *_rules("csrf", "CWE-352", *[(p, "CSRF Protection Disabled", "High") for p in (r"@csrf_exempt", r"csrf_exempt\s*=", r"@csrf\.exempt", r"\[IgnoreAntiforgeryToken\]")]),
    *_rules(
        "command_injection", "CWE-78",
        (r"os\.system\s*\(", "os.system() call", "Critical"), (r"subprocess\..*shell\s*=\s*True", "subprocess with shell=True", "Critical"), (r"subprocess\.Popen\s*\(", "subprocess.Popen() (check shell)", "High"),
        (r"child_process\.exec\s*\(", "child_process.exec()", "Critical"), (r"child_process\.execSync\s*\(", "child_process.execSync()", "Critical"), (r"Runtime\.getRuntime\(\)\.exec\s*\(", "Runtime.exec()", "Critical"),
        (r"\bsystem\s*\(", "system() in PHP/C", "Critical"), (r"\bpassthru\s*\(", "passthru() in PHP", "Critical"), (r"`[^`]*\$\{?[^`]+`", "Shell command substitution with user input", "Critical"),
    ),
    *_rules(
        "unsafe_eval", "CWE-95",
        (r"\beval\s*\(", "eval()", "Critical"), (r"\bexec\s*\(", "exec() (Python/JS)", "Critical"), (r"new\s+Function\s*\(", "new Function() constructor", "Critical"),
        (r"setTimeout\s*\([\"']", "setTimeout with string argument", "High"), (r"setInterval\s*\([\"']", "setInterval with string argument", "High"),
    ),
    *_rules(
        "insecure_storage", "CWE-922",
        (r"(?:localStorage|sessionStorage)\s*\.\s*setItem\s*\(", "Storing sensitive data in Web Storage", "High"), (r"(?:localStorage|sessionStorage)\s*\.\s*getItem\s*\(", "Reading sensitive data from Web Storage", "Medium"),
        (r"IndexedDB.*(?:password|secret|token|key)", "Sensitive data in IndexedDB", "Medium"), (r"File\.write.*(?:password|secret|key|token)", "Writing secrets to a file", "Critical"),
    ),
    *_rules("insecure_storage", "CWE-502", (r"(?:pickle\.dump|pickle\.load|joblib\.dump|joblib\.load)", "Insecure deserialization (pickle/joblib)", "Critical"), (r"yaml\.load\s*\(", "Unsafe YAML deserialization", "Critical")),
    *_rules("jwt_misconfiguration", "CWE-327", (r"(?:algorithm|alg)\s*[=:]\s*['\"]*(?:none|HS256|HS128)['\"]*", "Weak JWT Algorithm", "Critical"), (r"jwt\.decode\s*\([^)]*verify\s*=\s*False", "JWT Decode With Verification Disabled", "Critical")),
    *_rules("jwt_misconfiguration", "CWE-798", (r"(?:jwt[_-]?secret|jwt[_-]?key|token[_-]?secret|signing[_-]?key)\s*[=:]\s*['\"]([^'\"]{16,})['\"]", "Hardcoded JWT Secret", "Critical")),
    *_rules("jwt_misconfiguration", "CWE-613", (r"jwt\.(?:decode|verify|verifyToken)\s*\([^)]*\)", "JWT Decode Without Explicit Expiration Check", "High")),
    *_rules(
        "ssrf", "CWE-918",
        (r"requests\.(?:get|post|put|delete|patch|head|options)\s*\([^)]*url\s*=", "requests call with user-controlled URL", "High"), (r"urllib\.request\.urlopen\s*\(", "urllib request with potential user input", "High"),
        (r"httpx\.(?:get|post|put|delete|patch|head|options)\s*\([^)]*url\s*=", "httpx call with user-controlled URL", "High"), (r"aiohttp\.ClientSession.*\.(?:get|post|put|delete)\s*\(", "aiohttp request with potential user input", "High"),
        (r"axios\.(?:get|post|put|delete|patch)\s*\([^)]*url", "axios call with user-controlled URL", "High"), (r"fetch\s*\([^)]*url", "fetch call with potential user-controlled URL", "Medium"),
        (r"curl\s+[^-]", "shell curl command with potential user input", "High"), (r"guzzle|HttpClient|HttpClient\.(?:get|post|send)", "HTTP client call with potential user input", "Medium"),
    ),
    *_rules(
        "path_traversal", "CWE-22",
        (r"open\s*\([^)]*\+[^)]*", "open() with concatenated path", "High"), (r"(?:os\.path\.join|pathlib\.Path)\([^)]*user|input|request|param|query[^)]*\)", "File path construction with user input", "High"),
        (r"send_file\s*\([^)]*user|input|request|param", "send_file() with user-controlled path", "Critical"), (r"StaticHandler|static_file|file_path.*user|input|request", "Static file handler with user-controlled path", "High"),
        (r"zipfile|tarfile|shutil\.unpack|extractall", "Archive extraction with potential path traversal", "High"), (r"os\.(?:remove|unlink|rename|chmod|chown)\s*\(", "File operation with potential user-controlled path", "High"),
        (r"(?:File|StreamWriter|StreamReader)\s*\([^)]*\+", "File I/O with concatenated path", "High"),
    ),
    *_rules(
        "unsafe_deserialization", "CWE-502",
        (r"pickle\.loads?\s*\(", "pickle.load/loads()", "Critical"), (r"marshal\.loads?\s*\(", "marshal.load/loads()", "Critical"), (r"shelve\.open\s*\(", "shelve.open()", "High"),
        (r"yaml\.load\s*\([^)]*Loader\s*=\s*yaml\.(?:FullLoader|UnsafeLoader|CLoader)", "Unsafe YAML loader", "Critical"), (r"XMLParser|lxml\(|xml\.etree|ElementTree|etree\.\(|parse\s*\(", "XML parser with potential XXE risk", "High"),
        (r"jsonpickle\.(?:loads?|decode)", "jsonpickle deserialization", "High"), (r"numpy\.load\s*\(", "numpy.load() with potential pickle", "High"), (r"joblib\.load\s*\(", "joblib.load() deserialization", "High"),
        (r"ObjectInputStream|readObject\s*\(", "Java ObjectInputStream deserialization", "Critical"), (r"Unmarshal\s*\(|json\.Unmarshal|encoding/json\.Unmarshal", "Go deserialization with potential type confusion", "Medium"),
    ),
]

#: Rules with look-around.
LOOKING = [
    *_rules("command_injection", "CWE-78", (r"(?<!os\.)(?<!subprocess\.)(?<!child_process\.)(?<!Runtime\.getRuntime\(\)\.)\bexec\s*\(", "exec() in PHP/Node (or generic)", "High")),
    *_rules("insecure_storage", "CWE-922", (r"cookie.*(?:password|secret|token|jwt)(?!.*httponly)", "Cookie without httpOnly/Secure flags for sensitive data", "High")),
]

#: Pattern, severity, issue of hardcoded secrets; the value is the group, or the whole match.
SECRETS = (
    (r"(?:api[_-]?key|apikey|api[_-]?secret|api[_-]?token)\s*[=:]\s*['\"]([A-Za-z0-9_\-\.\+/=]{16,})['\"]", "Critical", "Hardcoded API Key"),
    (r"(?:jwt[_-]?secret|jwt[_-]?key|token[_-]?secret|auth[_-]?secret)\s*[=:]\s*['\"]([A-Za-z0-9_\-\.\+/=]{10,})['\"]", "Critical", "Hardcoded JWT / Auth Secret"),
    (r"(?:password|pwd|passwd|db[_-]?password|root[_-]?password)\s*[=:]\s*['\"]([^'\"]{6,})['\"]", "Critical", "Hardcoded Password"),
    (r"(?:secret|secret[_-]?key|private[_-]?key|access[_-]?token|auth[_-]?token)\s*[=:]\s*['\"]([A-Za-z0-9_\-\.\+/=]{16,})['\"]", "High", "Hardcoded Secret / Token"),
    (r"(?:postgresql|mysql|mongodb|redis|sqlite)://[^\s'\"]*:[^\s'\"]*@", "High", "Connection String with Embedded Credentials"),
)
LEGITIMATE = r"(?i)(?:os\.getenv|os\.environ|config\s*\(|settings\.|environ\.get|\.env|load_dotenv|get_config|secret_manager|vault|KeyVault|SETTINGS\.|@dataclass|pydantic\.BaseModel|BaseSettings|getenv\s*\(|environ\.get)"
PLACEHOLDER = r"(?i)^(your[_\-]?(key|secret|token|password)|placeholder|changeme|example|demo|test|dummy|none|xxxx)"
SQL_WORDS = r"(?i)(?:execute|executemany|query|raw_query|cursor|session\.execute|db\.execute|conn\.execute|run\s*query|text\s*\(|SQL\s*\))"
SQL_JOINED = (r"['\"]\s*\+\s*(?!\s*['\"])", r"f['\"][^'\"]*\{[^}]+\}", r"['\"]\s*%\s*[srd]", r"['\"]\s*\.format\s*\(")
ROUTES = (r"(?i)@router\.(?:get|post|put|delete|patch)\b", r"(?i)@app\.(?:get|post|put|delete|patch|route)\b", r"(?i)@(?:blueprint|bp)\.(?:get|post|put|delete|patch|route)\b")
AUTHORIZED = r"(?i)(?:login_required|auth_required|authenticated|get_current_user|@roles_allowed|@permission_required|@jwt_required|oauth2_scheme|Depends\(get_current_user|\[Authorize\]|\[Authenticate\]|AuthorizeAttribute|EnsureAuthenticated|requireAuth|isAuthenticated)"
OPEN_ROUTES = r"(?i)health|ping|static|favicon|webhook"

KEYS = ["repo", "file_id", "path"]


def found_in(files: DataFrame, hits: Column) -> DataFrame:
    """The keys of ``files`` and the fields of each of the hits, an array that reads content, ``small`` (the content in small
    letters), path, ``lang`` and the ``lines`` of a text; each of these is made once."""
    lang = F.when(inventory.file_type(F.col("path")) == "source", inventory.language(F.col("path")))
    lined = files.select(*KEYS, "content", F.lower("content").alias("small"), lang.alias("lang"), clones.once(text.lined(F.col("content"))).alias("lines"))
    return lined.select(*KEYS, clones.once(hits).alias("hits")).select(*KEYS, F.explode("hits").alias("h")).select(*KEYS, "h.*")


def some(columns: list[Column]) -> Column:
    """The array of those that are not null."""
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def pattern_hits(content: Column, small: Column, rules: list[Rule]) -> Column:
    """Array of (line, name, severity, cwe, issue): all matches of all rules; the same line and beginning of an issue counts
    once, by the first rule."""
    begins = [r.issue[:60] for r in rules]
    facts = F.array(*[F.struct(*[F.lit(getattr(r, c)).alias(c) for c in ("name", "severity", "cwe", "issue")]) for r in rules])
    of = lambda k, r: F.struct(F.lit(begins.index(begins[k])).alias("group"), F.lit(k).alias("k"), text.marked(content, r.pattern).alias("marked"))
    hits = some([F.when(text.matches(content, small, r.pattern), of(k, r)) for k, r in enumerate(rules)])
    places = F.flatten(F.transform(hits, lambda h: F.transform(text.marked_lines(content, h["marked"]), lambda n: F.struct(h["group"].alias("group"), n.alias("line"), h["k"].alias("k")))))
    first = lambda own: lambda x, i: (i == 0) | (F.get(own, i - 1)["group"] != x["group"]) | (F.get(own, i - 1)["line"] != x["line"])
    kept = text.let(F.sort_array(places), lambda own: F.filter(own, first(own)))
    return F.transform(kept, lambda x: text.let(F.get(facts, x["k"]), lambda f: F.struct(x["line"].alias("line"), *[f[c].alias(c) for c in ("name", "severity", "cwe", "issue")])))


def pattern_findings(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``pattern_hits``: one pass over the files, each of which has its keys for itself."""
    lower = files.select(*KEYS, "content", clones.once(F.lower("content")).alias("small"))
    own = lower.select(*KEYS, clones.once(pattern_hits(F.col("content"), F.col("small"), rules)).alias("hits"))
    return own.select(*KEYS, F.explode("hits").alias("h")).select(*KEYS, "h.*")


def near(lines: Column, number: Column, before: int, after: int) -> Column:
    """The lines around line ``number`` as one text; ``lines`` is ``text.lined``, as for all that follow."""
    start = F.greatest(F.lit(1), number - before)
    return F.array_join(F.transform(F.slice(lines, start, number + after - start + 1), lambda x: x["line"]), "\n")


def secret_hits(content: Column, small: Column, lines: Column) -> Column:
    """Array of (line, severity, issue): assignments of literal credentials, but for placeholders and lines near reads of the
    environment."""

    def of(pattern: str, severity: str, issue: str) -> Column:
        full = "(?i)" + pattern
        values = F.regexp_extract_all(content, F.lit(full), F.lit(1 if "(" in pattern.replace("(?:", "") else 0))
        return F.when(text.matches(content, small, full), F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), text.marked(content, full).alias("marked"), values.alias("values")))

    def kept(h: Column) -> Column:
        pairs = F.arrays_zip(text.marked_lines(content, h["marked"]).alias("line"), h["values"].alias("value"))
        good = F.filter(pairs, lambda x: ~near(lines, x["line"], 2, 0).rlike(LEGITIMATE) & ~x["value"].rlike(PLACEHOLDER))
        return F.transform(F.array_distinct(F.transform(good, lambda x: x["line"])), lambda n: F.struct(n.alias("line"), h["severity"].alias("severity"), h["issue"].alias("issue")))

    return F.flatten(F.transform(some([of(*row) for row in SECRETS]), kept))


def hardcoded_secrets(files: DataFrame) -> DataFrame:
    return found_in(files, secret_hits(F.col("content"), F.col("small"), F.col("lines")))


def open_route_hits(content: Column, lines: Column) -> Column:
    """Lines of routes without an authorization mark within two lines before and four after."""
    numbers = F.array_distinct(F.concat(*[text.match_lines(content, p) for p in ROUTES]))
    kept = F.filter(numbers, lambda n: ~near(lines, n, 2, 4).rlike(AUTHORIZED) & ~F.get(lines, n - 1)["line"].rlike(OPEN_ROUTES))
    return F.when(content.contains("@"), kept).otherwise(F.array().cast("array<int>"))


def missing_authorization(files: DataFrame) -> DataFrame:
    return found_in(files, F.transform(open_route_hits(F.col("content"), F.col("lines")), lambda n: F.struct(n.alias("line"))))


def joins_sql(stripped: Column) -> Column:
    """Is a line, not a comment, one that names a query call and joins strings?"""
    joined = F.lit(False)
    for p in SQL_JOINED:
        joined = joined | stripped.rlike(p)
    return stripped.rlike(SQL_WORDS) & joined & ~text.is_comment(stripped, ("#", "//", "--", "*", "/*"))


def sql_injection(lines: DataFrame) -> DataFrame:
    """Lines, not comments, that name a query call and join strings."""
    return lines.where(joins_sql(text.strip(F.col("line"))))


def unnamed_number(stripped: Column) -> Column:
    """The first number of a code line that should have a name, or null."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(stripped, r'"[^"]*"', '""'), "'[^']*'", "''"), r"#[^#]*$", "")
    numbers = F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z_])(\d+\.?\d*)(?![A-Za-z_])"), F.lit(1))
    unnamed = F.filter(numbers, lambda x: text.let(x.cast("double"), lambda v: ~v.isin(0.0, 1.0, 2.0, 10.0, 100.0) & (v <= 10000)))
    constant = text.let(F.regexp_extract(stripped, r"^(\w+)\s*=", 1), lambda name: (name != "") & (F.upper(name) == name))
    skip = text.is_comment(stripped, ("#", "//", "--", "*", "/*")) | (stripped.contains("range") & stripped.rlike(r"range\s*\(")) | constant
    return F.when(stripped.rlike(r"\d"), F.when(~skip, F.get(unnamed, 0)))


def magic_numbers(lines: DataFrame, cap: int = 5) -> DataFrame:
    """The first number of a code line that should have a name; at most ``cap`` lines of a file."""
    found = lines.withColumn("number", clones.once(unnamed_number(text.strip(F.col("line"))))).where(F.col("number").isNotNull())
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*KEYS).orderBy("line_no"))).where(F.col("place") <= cap).drop("place")


def magic_hits(lines: Column, cap: int = 5) -> Column:
    numbers = F.transform(lines, lambda x: F.struct(x["no"].alias("line"), unnamed_number(x["s"]).alias("number")))
    return F.slice(F.filter(numbers, lambda x: x["number"].isNotNull()), 1, cap)


def unused_hits(content: Column, path: Column, lines: Column, cap: int = 5) -> Column:
    """Array of (line_no, name): names imported in Python files that no other line has as a word."""
    is_import = lambda x: x["s"].startswith("import ") | x["s"].startswith("from ")
    names = lambda s: F.split(F.regexp_extract(s, r"^(?:from\s+\S+\s+)?import\s+(.+)$", 1), ",")
    one = lambda n: text.strip(F.substring_index(text.strip(n), " as ", 1))
    rest = F.array_join(F.transform(F.filter(lines, lambda x: ~is_import(x)), lambda x: x["s"]), "\n")
    imported = F.flatten(F.transform(F.filter(lines, is_import), lambda x: F.transform(names(x["s"]), lambda n: F.struct(x["no"].alias("line_no"), one(n).alias("name")))))
    used = lambda rest, name: rest.contains(name) & F.regexp(rest, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b")))
    found = text.let(rest, lambda r: F.slice(F.filter(imported, lambda x: ~x["name"].isin("*", "") & ~used(r, x["name"])), 1, cap))
    return F.when(path.endswith(".py") & content.contains("import "), found).otherwise(F.array().cast("array<struct<line_no:int,name:string>>"))


def unused_imports(files: DataFrame, cap: int = 5) -> DataFrame:
    return found_in(files, unused_hits(F.col("content"), F.col("path"), F.col("lines"), cap))


def todo_markers(lines: DataFrame) -> DataFrame:
    """The first marker of each line and the text after it."""
    pattern = r"\b(TODO|FIXME|HACK|XXX|WORKAROUND)\b[:\s]?(.{0,120})"
    line = F.col("line")
    return lines.where(line.rlike(pattern)).select(*KEYS, "line_no", F.regexp_extract(line, pattern, 1).alias("marker"), text.strip(F.regexp_extract(line, pattern, 2)).alias("note"))


def declared(content: Column, pattern: str) -> Column:
    """What a text that has functions by a pattern, whose groups are name and list, has of them: marked, names, lists; or null."""
    of = lambda g: F.regexp_extract_all(content, F.lit(pattern), F.lit(g))
    return F.when(content.rlike(pattern), F.struct(text.marked(content, pattern).alias("marked"), of(1).alias("names"), of(2).alias("lists")))


def parameter_hits(content: Column, found: Column, most: int = 5) -> Column:
    """Array of (line, name, params): functions, ``declared`` in a text, with more than ``most`` parameters."""

    def counted(d: Column) -> Column:
        zipped = F.arrays_zip(text.marked_lines(content, d["marked"]).alias("line"), d["names"].alias("name"), d["lists"].alias("args"))
        rows = F.transform(zipped, lambda f: F.struct(f["line"].alias("line"), f["name"].alias("name"), F.size(F.filter(F.split(f["args"], ","), lambda x: text.strip(x) != "")).alias("params")))
        return F.filter(rows, lambda f: f["params"] > most)

    return F.flatten(F.transform(some([found]), counted))


def long_parameter_lists(files: DataFrame, most: int = 5) -> DataFrame:
    """Functions with more than ``most`` parameters."""
    own = files.select(*KEYS, clones.once(parameter_hits(F.col("content"), declared(F.col("content"), PARAMETERS["Python"]), most)).alias("hits"))
    return own.select(*KEYS, F.explode("hits").alias("h")).select(*KEYS, "h.*")


#: By language: where a function begins (its name is a group), and how many lines it may have.
FUNCTIONS = {
    "Python": (r"(?m)^(\s*)def\s+(\w+)\s*\(", 50),
    "JavaScript": (r"(?m)^(\s*)(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>))", 60),
    "TypeScript": (r"(?m)^(\s*)(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*[=:])", 60),
    "Java": (r"(?m)^(\s*)(?:public|private|protected|static|final|async)*\s*\w+(?:<[^>]+>)?\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*\{", 60),
    "Go": (r"(?m)^(\s*)func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", 60),
}
#: Parameter lists; those of script functions have no pattern that the service's count would ever reach.
PARAMETERS = {
    "Python": r"def\s+(\w+)\s*\(([^)]*)\)",
    "Java": r"(?:public|private|protected|static|final|async)*\s*\w+(?:<[^>]+>)?\s+(\w+)\s*\(([^)]*)\)",
    "Go": r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(([^)]*)\)",
}


def long_hits(content: Column, lang: Column, lines: Column, cap: int = 3) -> Column:
    """Array of (line, name, length, severity): functions with more lines than their language, null for a text that is no
    source, allows. A function ends before the first later line, its second or a later one, that is not blank and not
    indented deeper than its first.

    Only as many lines as are allowed tell whether a function is too long; its end is looked for if it is reported."""

    def of(name: str, pattern: str, most: int) -> Column:
        names = F.regexp_extract_all(content, F.lit(pattern), F.lit(2))
        if name.endswith("Script"):
            names = F.zip_with(names, F.regexp_extract_all(content, F.lit(pattern), F.lit(3)), lambda a, b: F.when(a != "", a).otherwise(b))
        return F.when((F.size(lines) > most) & content.rlike(pattern), F.struct(F.lit(most).alias("most"), text.marked(content, pattern).alias("marked"), names.alias("names")))

    def measured(d: Column) -> Column:
        starts = F.arrays_zip(text.marked_lines(content, d["marked"]).alias("line"), d["names"].alias("name"))
        ends = lambda f: lambda x: (x["s"] != "") & (x["indent"] <= F.get(lines, f["line"] - 1)["indent"])
        long = F.filter(starts, lambda f: (F.size(lines) - f["line"] > d["most"]) & ~F.exists(F.slice(lines, f["line"] + 2, d["most"]), ends(f)))
        end = lambda f: F.coalesce(F.get(F.filter(F.slice(lines, f["line"] + 2, F.size(lines)), ends(f)), 0)["no"] - 1, F.size(lines))
        named = lambda f: F.when(f["name"] == "", "anonymous").otherwise(f["name"])
        shaped = lambda f: text.let(end(f) - f["line"], lambda n: F.struct(f["line"].alias("line"), named(f).alias("name"), n.alias("length"), F.when(n > 2 * d["most"], "High").otherwise("Medium").alias("severity")))
        return F.transform(F.slice(long, 1, cap), shaped)

    found = F.when(lang.isNull() | (F.size(lines) <= min(most for _, most in FUNCTIONS.values())), None)
    for name, (pattern, most) in FUNCTIONS.items():
        mine = lang == name if name != "Python" else (lang == name) | ~lang.isin(*FUNCTIONS)
        found = found.when(mine, of(name, pattern, most))
    return F.flatten(F.transform(some([found]), measured))


def long_functions(files: DataFrame, cap: int = 3) -> DataFrame:
    return found_in(files, long_hits(F.col("content"), F.col("lang"), F.col("lines"), cap))


def list_hits(content: Column, lang: Column, most: int = 5, cap: int = 3) -> Column:
    """Array of (line, name, params): functions with more than ``most`` parameters, by the pattern of the file's language;
    others are read as Python."""
    found = F.when(lang.isNull() | lang.isin("JavaScript", "TypeScript") | ~content.contains("("), None)
    for name in ("Java", "Go"):
        found = found.when(lang == name, declared(content, PARAMETERS[name]))
    found = found.otherwise(declared(content, PARAMETERS["Python"]))
    return F.slice(F.sort_array(parameter_hits(content, found, most)), 1, cap)


def parameter_lists(files: DataFrame, most: int = 5, cap: int = 3) -> DataFrame:
    return found_in(files, list_hits(F.col("content"), F.col("lang"), most, cap))


def top_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("(root)")


def imports(files: DataFrame) -> DataFrame:
    """One row for each import of a Python, script or Go file: top directory of the file, and the package named. A relative
    import of a script counts for the directory above the last part of the path that it names, or not at all."""
    python = r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"
    script = r"(?:import\s+[^'\"]*?from\s*|require\s*\(\s*)['\"]([^'\"]+)['\"]"
    go = r'(?m)^\s*"([\w./\-]+)"'
    content, ext, parts = F.col("content"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)), F.split("path", "/")
    of = lambda p, g: F.regexp_extract_all(content, F.lit(p), F.lit(g))

    def package(s: Column) -> Column:
        named = F.substring_index(F.regexp_replace(s, r"^[./]+", ""), "/", 1)
        above = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (i > 0) & (F.get(parts, i) == named))
        relative = F.get(parts, F.array_max(above) - 1)
        return F.when(s.startswith("."), relative).when(s.startswith("@"), F.substring_index(s, "/", 2)).otherwise(F.substring_index(s, "/", 1))

    names = F.when(ext == "py", F.zip_with(of(python, 1), of(python, 2), lambda a, b: F.substring_index(F.when(a != "", a).otherwise(b), ".", 1)))
    names = names.when(ext.isin("js", "jsx", "ts", "tsx", "mjs", "cjs"), F.transform(of(script, 1), package)).when(ext == "go", F.transform(of(go, 1), lambda s: F.substring_index(s, "/", -1)))
    return files.select("repo", "path", top_of(F.col("path")).alias("src"), F.explode(names).alias("name")).where(F.coalesce("name", F.lit("")) != "")


def import_edges(files: DataFrame) -> DataFrame:
    """repo, src, dst, n, internal: imports by top directory; a name that is no top directory is external."""
    tops = files.where(F.col("path").contains("/")).select("repo", F.substring_index("path", "/", 1).alias("name")).distinct().withColumn("known", F.lit(True))
    joined = imports(files).join(tops, ["repo", "name"], "left").where(F.col("known").isNull() | (F.col("src") != F.col("name")))
    return joined.groupBy("repo", "src", F.col("name").alias("dst"), F.coalesce("known", F.lit(False)).alias("internal")).agg(F.count(F.lit(1)).alias("n"))


def import_report(edges: DataFrame, most_internal: int = 60, most_external: int = 25) -> DataFrame:
    """The edges between directories and the outside packages that are most imported, with their place in each repository."""
    inner = edges.where("internal").select("repo", F.lit("internal").alias("kind"), "src", "dst", "n")
    outer = edges.where(~F.col("internal")).groupBy("repo", "dst").agg(F.sum("n").alias("n")).select("repo", F.lit("external").alias("kind"), F.lit("").alias("src"), "dst", "n")
    ranked = inner.unionByName(outer).withColumn("place", F.row_number().over(Window.partitionBy("repo", "kind").orderBy(F.desc("n"), "src", "dst")))
    return ranked.where(F.col("place") <= F.when(F.col("kind") == "internal", most_internal).otherwise(most_external))


def mutual_imports(edges: DataFrame) -> DataFrame:
    inner = edges.where("internal")
    back = inner.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return inner.where(F.col("src") < F.col("dst")).join(back, ["repo", "src", "dst"], "left_semi").select("repo", "src", "dst")


def god_components(edges: DataFrame, least: int = 30, share: float = 0.6) -> DataFrame:
    """Repositories where one directory takes more than ``share`` of at least ``least`` internal imports."""
    into = edges.where("internal").groupBy("repo", "dst").agg(F.sum("n").alias("n"))
    total = into.groupBy("repo").agg(F.sum("n").alias("total"), F.max(F.struct("n", "dst")).alias("top"))
    return total.where((F.col("total") >= least) & (F.col("top.n") / F.col("total") > share)).select("repo", F.col("top.dst").alias("component"), F.col("top.n").alias("n"), "total")


def nesting_hits(lines: Column, most: int = 4) -> Column:
    """Array of (depth, line): the first deepest line of a text with code more than ``most`` levels deep."""
    depth = lambda x: F.when(x["indent"] >= 4, F.floor(x["indent"] / 4)).when(F.substring(x["line"], F.lit(1), x["indent"]).contains("\t"), x["indent"]).otherwise(0).cast("int")
    code = F.filter(lines, lambda x: (x["indent"] > most) & (x["s"] != "") & ~text.is_comment(x["s"], ("#", "//", "--", "/*")))
    top = F.array_max(F.transform(code, lambda x: F.struct(depth(x).alias("depth"), (-x["no"]).alias("back"))))
    return F.filter(F.transform(F.array(top), lambda t: F.struct(t["depth"].alias("depth"), (-t["back"]).alias("line"))), lambda t: t["depth"] > most)


def scan(files: DataFrame, code: bool = False) -> DataFrame:
    """repo, file_id, path, kind, line, name, severity, issue: all twelve security rule sets and all smells on each text.

    ``files`` has (repo, file_id, path, content), a row for each text; the content may be a file, a patch or what a patch
    adds, lines being lines of it. No two rule sets give an issue in the same words, so each set drops its own repeats.
    All rules are arrays of one row: texts are read once, and nothing is shuffled. ``code``: also ``before``, the line
    without white space at its ends, and ``block``, the line with the two after it."""
    content, small, path, lang, lines, lit = *map(F.col, ("content", "small", "path", "lang", "lines")), F.lit

    def shaped(hits: Column, kind: str, line: str | None, name: str | None, severity: str | None, issue: Callable[[Column], Column]) -> Column:
        of = lambda x: F.struct(lit(kind).alias("kind"), (x if line is None else x[line]).cast("int").alias("line"), (x["name"] if name is None else lit(name)).alias("name"), (x["severity"] if severity is None else lit(severity)).alias("severity"), issue(x).alias("issue"))
        return F.transform(hits, of)

    said = lambda *parts: lambda x: F.concat(*[lit(p) if k % 2 == 0 else x[p].cast("string") for k, p in enumerate(parts)])
    sql = F.when(content.rlike(SQL_WORDS), F.filter(lines, lambda x: joins_sql(x["s"]))).otherwise(F.slice(lines, 1, 0))
    parts = [
        shaped(pattern_hits(content, small, [*RULES, *LOOKING]), "security", "line", None, None, lambda x: x["issue"]),
        shaped(secret_hits(content, small, lines), "security", "line", "hardcoded_secrets", None, lambda x: x["issue"]),
        shaped(sql, "security", "no", "sql_injection", "Critical", lambda x: lit("SQL Injection — String Concatenation in Query")),
        shaped(open_route_hits(content, lines), "security", None, "missing_authorization", "High", lambda x: lit("Missing Authorization Guard on API Endpoint")),
        shaped(magic_hits(lines), "code_smell", "line", "magic_number", "Medium", said("Magic Number: ", "number")),
        shaped(unused_hits(content, path, lines), "code_smell", "line_no", "unused_import", "Low", said("Unused Import: '", "name", "'")),
        shaped(long_hits(content, lang, lines), "code_smell", "line", "long_function", None, said("Long Function: ", "name", " (", "length", " lines)")),
        shaped(list_hits(content, lang), "code_smell", "line", "long_parameter_list", "Medium", said("Long Parameter List: ", "name", "(", "params", " params)")),
        shaped(clones.blocks_of(lines), "code_smell", "line_no", "duplicate_code", "Medium", said("Duplicate Code Block (", "n", " occurrences)")),
        shaped(nesting_hits(lines), "code_smell", "line", "deep_nesting", "Medium", said("Deep Nesting: ", "depth", " levels deep (threshold: 4)")),
    ]
    hits = F.concat(*parts)
    if code:
        line = lambda x: F.coalesce(F.get(lines, x["line"] - 1)["s"], lit(""))
        block = lambda x: F.array_join(F.transform(F.slice(lines, F.greatest(x["line"], lit(1)), 3), lambda y: y["line"]), "\n")
        hits = F.transform(hits, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "line", "name", "severity", "issue")], line(x).alias("before"), block(x).alias("block")))
    return found_in(files, hits)


def impact(findings: DataFrame) -> DataFrame:
    """repo, file_id, path, security_impact: the sentence by the worst severity; texts without security findings have no row."""
    counts = findings.where(F.col("kind") == "security").groupBy(*KEYS).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("Critical", "High", "Medium")], F.count(F.lit(1)).alias("n"))
    said = lambda n, word: F.concat(F.col(n).cast("string"), F.lit(f" {word} security pattern(s) detected in the added code."))
    sentence = F.when(F.col("Critical") > 0, said("Critical", "critical")).when(F.col("High") > 0, said("High", "high-severity")).when(F.col("Medium") > 0, said("Medium", "medium-severity")).otherwise(said("n", "low-severity"))
    return counts.select(*KEYS, sentence.alias("security_impact"))

"""Cyclomatic complexity of functions. A parser is needed, so files go through Arrow batches: Python to ``ast``, JavaScript
and TypeScript to patterns and a count of braces. Patterns are fixed values."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "repo long, file_id long, name string, line_start int, line_end int, complexity int, nesting int"
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.match_case)
_BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try)


def decisions(node: ast.AST) -> int:
    """Decision points below a node, nested functions included; ``with`` is none."""
    n = 0
    for x in ast.walk(node):
        n += isinstance(x, _BRANCHES)
        n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
        n += 1 + len(x.ifs) if isinstance(x, ast.comprehension) else 0
    return n


def nesting(node: ast.AST) -> int:
    """Blocks within blocks; an ``elif`` stands in the block before it."""
    deepest, todo = 0, [(node, 0)]
    while todo:
        x, depth = todo.pop()
        depth += isinstance(x, _BLOCKS)
        deepest = max(deepest, depth)
        todo += [(y, depth) for y in ast.iter_child_nodes(x)]
    return deepest


def functions_of(source: str) -> list[tuple]:
    """name, first and last line, complexity and nesting of each function; none where the source does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple] = []
    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    while todo:
        node, owner = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((f"{owner}.{node.name}" if owner else node.name, node.lineno, node.end_lineno or node.lineno, 1 + decisions(node), nesting(node)))
            todo += [(x, owner) for x in node.body]
        elif isinstance(node, ast.ClassDef):
            todo += [(x, node.name) for x in node.body]
        else:
            todo += [(x, owner) for x in ast.iter_child_nodes(node)]
    return sorted(out, key=lambda f: (f[1], f[0]))


#: Strings and comments, which count for nothing, in the order in which they go: templates, two kinds of quotes, block and
#: line comments. A quote in a comment thus begins a string, if another follows in its line.
NOISE = (
    (re.compile(r"`(?:\\.|[^`\\])*`"), "``"), (re.compile(r'"(?:\\.|[^"\\\n])*"'), '""'), (re.compile(r"'(?:\\.|[^'\\\n])*'"), "''"),
    (re.compile(r"/\*.*?\*/", re.DOTALL), ""), (re.compile(r"//[^\n]*"), ""),
)
SCRIPT_FUNCTIONS = [
    re.compile(r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\("),
    re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"),
    re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?function\b"),
    re.compile(r"^\s+(?:async\s+)?([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{", re.MULTILINE),
]
SCRIPT_BRANCH = re.compile(r"\b(if|for|while|case|catch)\b|\?\?|\|\||&&|\?.*:|\bdefault:")
NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "function"}


def blocks_of(text: str) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Places of all opening braces, and of those that are closed: where, and how deep braces stand within, themselves
    included. One pass with a stack."""
    opened, closed, stack = [], {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            opened.append(m.start())
            stack.append([m.start(), 1])
        elif stack:
            begin, deepest = stack.pop()
            closed[begin] = (m.start(), deepest)
            if stack:
                stack[-1][1] = max(stack[-1][1], deepest + 1)
    return opened, closed


def script_functions_of(source: str) -> list[tuple]:
    """As ``functions_of``, for JavaScript and TypeScript. A function's body is the next block in braces; one without any
    brace after it is a single line, and one whose block is not closed has no body."""
    text = source
    for pattern, rest in NOISE:
        text = pattern.sub(rest, text)
    ends = [m.start() for m in re.finditer("\n", text)]
    opened, closed = blocks_of(text)
    found = {(m.start(1), m[1]): m for pattern in reversed(SCRIPT_FUNCTIONS) for m in pattern.finditer(text)}
    out = []
    for (_, name), m in sorted(found.items()):
        if name in NOT_NAMES:
            continue
        first, k = bisect_left(ends, m.start()) + 1, bisect_left(opened, m.end() - 1)
        if k == len(opened):
            out.append((name, first, first, 1, 0))
            continue
        end, deepest = closed.get(opened[k], (opened[k], 0))
        branches = sum(1 for _ in SCRIPT_BRANCH.finditer(text, opened[k], end))
        out.append((name, first, bisect_left(ends, end) + 1, 1 + branches, deepest))
    return out


def _measured(files: DataFrame, functions: dict[str, object]) -> DataFrame:
    """``functions``: what finds the functions of a file, by extension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["repo"], r["file_id"], *f) for r in batch.to_pylist() if (find := functions.get(r["extension"])) for f in find(r["content"] or "")]
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 4]
            names = ["repo", "file_id", "name", "line_start", "line_end", "complexity", "nesting"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=names)

    return files.select(F.col("repo").cast("long"), F.col("file_id").cast("long"), "content", "extension").mapInArrow(run, SCHEMA)


def python_complexity(files: DataFrame) -> DataFrame:
    return _measured(files.withColumn("extension", F.lit("py")), {"py": functions_of})


def file_complexity(files: DataFrame) -> DataFrame:
    """Functions of Python, JavaScript and TypeScript files, chosen by the extension of ``path``."""
    own = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)))
    kinds = {"py": functions_of, **dict.fromkeys(("js", "jsx", "mjs", "cjs", "ts", "tsx"), script_functions_of)}
    return _measured(own.where(F.col("extension").isin(*kinds)), kinds).join(own.select("repo", "file_id", "path"), ["repo", "file_id"])


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return F.when(ext == "py", "Python").when(ext.isin("ts", "tsx"), "TypeScript").otherwise("JavaScript")


def reported(functions: DataFrame, least: int = 8, most: int = 80) -> DataFrame:
    """The most complex functions of each repository, ``most`` of those of at least ``least``, with severity and place."""
    length = F.col("line_end") - F.col("line_start") + 1
    rows = functions.where(F.col("complexity") >= least).withColumn("length_lines", length).withColumn("severity", severity(F.col("complexity"), length))
    order = Window.partitionBy("repo").orderBy(F.desc("complexity"), F.desc("length_lines"), "path", "line_start", "name")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).withColumn("language", language_of(F.col("path")))


def report_summary(functions: DataFrame, least: int = 8, most: int = 80) -> DataFrame:
    """Of each repository: functions measured and their mean complexity, and counts of the reported ones."""
    every = functions.groupBy("repo").agg(F.count(F.lit(1)).alias("functions"), F.round(F.avg("complexity"), 2).alias("average_complexity"), F.count_if(F.col("complexity") >= least).alias("over"))
    shown = reported(functions, least, most).groupBy("repo").agg(
        F.count(F.lit(1)).alias("reported"), F.count_if(F.col("severity") == "High").alias("high"), F.count_if(F.col("severity") == "Medium").alias("medium"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("reported", "high", "medium")]
    return every.join(shown, "repo", "left").select("repo", "functions", "average_complexity", *zero, F.coalesce("languages", F.lit("")).alias("languages"), (F.col("over") > most).alias("capped"))


def severity(complexity: Column, length: Column) -> Column:
    return F.when((complexity >= 15) | (length > 150), "High").when((complexity >= 10) | (length > 100), "Medium").otherwise("Low")

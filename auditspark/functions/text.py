"""Text functions over source lines, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends of ``str.splitlines``.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
#: White space of ``str.strip``.
BLANK = r"[\s\x1C-\x1F\x85   -     　]"
COMMENT = ("#", "//", "/*", "*", "--", "<!--")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def split_lines(text: Column) -> Column:
    """Lines without their ends; no last empty one."""
    return _ended(F.split(text, LINE_END))


def _ended(parts: Column) -> Column:
    return let(parts, lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def is_comment(line: Column, prefixes: tuple[str, ...] = COMMENT) -> Column:
    test = F.lit(False)
    for p in prefixes:
        test = test | line.startswith(p)
    return test


def normalize_line(line: Column) -> Column:
    """A line for comparison: no comments, white space collapsed, no closing semicolons; empty where nothing is left."""
    return let(strip(line), lambda x: F.when(is_comment(x), "").otherwise(_tidy(x)))


def _tidy(stripped: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(stripped, r"(?<![:'\"])#.*$", ""), r"//.*$", "")
    return strip(F.regexp_replace(strip(F.regexp_replace(bare, rf"{BLANK}+", " ")), r";+$", ""))


def indent_of(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, rf"^{BLANK}+", ""))


def occurrences(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


#: Stands before each match while matches are counted by line.
MARK = "\x01"


def match_lines(text: Column, pattern: str | Column) -> Column:
    """Line number, from 1, of the start of each match; the text is searched whole, matches may span lines. The pattern may be
    a column's.

    A mark goes before each match; each line then gives its number as often as it has marks that the text did not have.
    This takes time in proportion to the text and its matches."""
    return F.when(F.rlike(text, F.lit(pattern)), marked_lines(text, marked(text, pattern))).otherwise(F.array().cast("array<int>"))


def marked(text: Column, pattern: str | Column) -> Column:
    """The text with a mark before each match."""
    return F.regexp_replace(text, F.lit(pattern), F.lit(MARK + "$0"))


def marked_lines(text: Column, marked: Column) -> Column:
    """``match_lines`` of a text from its marked form."""
    counts = F.zip_with(F.split(marked, "\n", -1), F.split(text, "\n", -1), lambda a, b: occurrences(a, MARK) - occurrences(b, MARK))
    return F.flatten(F.transform(counts, lambda n, i: F.array_repeat(i + 1, n)))


def lined(text: Column) -> Column:
    """The lines of a text with what rules ask of them: array of (no, line, s, indent), ``s`` being the line without white
    space at its ends. Most lines begin and end with a visible character of ASCII, but for spaces and tabs; others take patterns."""
    visible = lambda x, at: F.substring(x, at, 1).between("!", "~")

    def of(x: Column, i: Column) -> Column:
        trimmed = let(F.btrim(x, F.lit(" \t")), lambda t: F.when(visible(t, 1) & visible(t, -1), t).otherwise(strip(x)))
        moved = let(F.ltrim(x, F.lit(" \t")), lambda t: F.when(visible(t, 1), F.length(x) - F.length(t)).otherwise(indent_of(x)))
        bare, indent = F.when(visible(x, 1) & visible(x, -1), x).otherwise(trimmed), F.when(visible(x, 1), 0).otherwise(moved)
        return F.struct((i + 1).alias("no"), x.alias("line"), bare.alias("s"), indent.alias("indent"))

    plain = F.when(text.rlike(rf"(?!\n)(?:{LINE_END})"), F.regexp_replace(text, LINE_END, "\n")).otherwise(text)  # a split by one character compiles no pattern
    return F.transform(_ended(F.split(plain, "\n")), of)


def needles(pattern: str) -> tuple[str, ...]:
    """Texts in small letters, one of which is in every match of a pattern, whatever its case; none where that is not known."""

    def of(parsed: object) -> tuple[str, ...]:
        best, run = (), ""

        def better(found: tuple[str, ...]) -> tuple[str, ...]:
            return found if found and (not best or min(map(len, found)) > min(map(len, best))) else best

        for op, value in [*parsed, (None, None)]:  # type: ignore[misc]
            if op is _parser.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            best, run = better((run,) if run else ()), ""
            if op is _parser.SUBPATTERN:
                best = better(of(value[3]))
            elif op is _parser.BRANCH:
                each = [of(x) for x in value[1]]
                best = better(tuple(dict.fromkeys(n for found in each for n in found)) if all(each) else ())
            elif op is _parser.MAX_REPEAT and value[0] > 0:
                best = better(of(value[2]))
        return best

    return of(_parser.parse(pattern))


def matches(text: Column, small: Column, pattern: str) -> Column:
    """``text.rlike(pattern)``; ``small`` is the text in small letters, in which most patterns have nothing to look for."""
    test = None
    for n in needles(pattern):
        test = small.contains(n) if test is None else test | small.contains(n)
    return text.rlike(pattern) if test is None else test & text.rlike(pattern)


def mask_secrets(text: Column) -> Column:
    """Access tokens and authorization headers masked; patterns and masks are fixed values."""
    for pattern, mask in (
        (r"github_pat_[a-zA-Z0-9_]{30,200}", "github_pat_***[MASKED]***"),
        (r"gsk_[a-zA-Z0-9_]{30,200}", "gsk_***[MASKED]***"),
        (r"(?i)Authorization:\s*Bearer\s+[a-zA-Z0-9_\-.~]+", "Authorization: Bearer ***[MASKED]***"),
        (r"(?i)Bearer\s+[a-zA-Z0-9_\-.~]+", "Bearer ***[MASKED]***"),
    ):
        text = F.regexp_replace(text, pattern, mask)
    return text


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def version_triple(text: Column) -> Column:
    """The first dotted number anywhere in the text, missing parts 0; null where there is none."""
    at = lambda g: F.coalesce(F.regexp_extract(text, r"(\d+)(?:\.(\d+))?(?:\.(\d+))?", g).try_cast("int"), F.lit(0))
    return F.when(text.rlike(r"\d"), F.struct(at(1).alias("major"), at(2).alias("minor"), at(3).alias("patch")))


def version_in_range(version: Column, expression: Column) -> Column:
    """One comparator and a purely numeric bound; anything else is false."""
    sign = F.regexp_extract(expression, r"^\s*(<=|>=|==|<|>)\s*[0-9.]+\s*$", 1)
    bound = version_triple(expression)
    test = F.when(sign == "<=", version <= bound).when(sign == ">=", version >= bound).when(sign == "==", version == bound).when(sign == "<", version < bound).when(sign == ">", version > bound)
    return F.coalesce(test, F.lit(False))

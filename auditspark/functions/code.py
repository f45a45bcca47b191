"""Is a text source code, and in which language: ordered tests, first match wins. Patterns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditspark.functions.text import let, split_lines, strip

KEYWORDS = (
    r"\bdef\b", r"\bclass\b", r"\bfunction\b", r"\bimport\b", r"\breturn\b", r"\bif\b", r"\bfor\b", r"\bwhile\b", r"print\s*\(", r"console\.log\s*\(", r"#include\b", r"\bpublic\s+class\b",
)
#: Language and the patterns of which one is enough; scripts are told apart below.
LANGUAGES = (
    ("Python", (r"(?m)^\s*(def|class|import|from)\b", r"\belif\s+.*:|\bif\s+__name__\s*==\s*[\"']__main__[\"']:", r"print\s*\([^)]*\)")),
    ("Script", (r"\b(const|let|var|function|async|await|export|import)\b",)),
    ("Java", (r"\b(public|private|protected)\s+class\b", r"\bSystem\.out\.print(ln)?\b", r"\bpublic\s+static\s+void\s+main\b")),
    ("Go", (r"(?m)^\s*package\s+\w+", r"\bfunc\s+\w+\(", r"import\s+\([^)]*\)")),
    ("Rust", (r"\bfn\s+\w+\(", r"\bpub\s+fn\b", r"\blet\s+mut\b", r"\bimpl\b", r"use\s+std::")),
    ("C/C++", (r"#include\s+<[^>]+>", r"\bint\s+main\s*\(", r"\bstd::cout\b", r"\bprintf\s*\(")),
    ("C#", (r"\busing\s+System\b", r"\bnamespace\s+\w+")),
    ("HTML/CSS", (r"(?i)<!DOCTYPE html>|<html|href=|src=|<div|<span|<p\b",)),
    ("SQL", (r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|CREATE TABLE|ALTER TABLE|DROP TABLE)\b",)),
)
TYPED = (r"\b(interface|type|namespace|as|public|private|protected|readonly)\b", r":\s*(string|number|boolean|any|void|unknown|never)\b")
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "it", "he", "was", "for", "on", "are", "as", "with", "his", "they", "i", "at", "be", "this", "have", "from")


def any_of(code: Column, patterns: tuple[str, ...]) -> Column:
    test = code.rlike(patterns[0])
    for p in patterns[1:]:
        test = test | code.rlike(p)
    return test


def detect_language(code: Column) -> Column:
    def decide(s: Column) -> Column:
        out = F.lit("Unknown")
        for name, patterns in reversed(LANGUAGES):
            test = any_of(s, patterns)
            if name == "Python":
                test = test | (s.rlike(r"#\s+") & s.contains("def "))
            if name == "C#":
                test = test | (s.rlike(r"\bpublic\s+class\s+\w+") & s.contains("Console.Write"))
            found = F.when(any_of(s, TYPED), "TypeScript").otherwise("JavaScript") if name == "Script" else F.lit(name)
            out = F.when(test, found).otherwise(out)
        return out

    return let(strip(code), decide)


def is_valid_code(code: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    def decide(s: Column) -> Column:
        letters = F.length(F.regexp_replace(s, r"\P{L}", ""))
        structure = sum((s.rlike(p).cast("int") for p in (r"\b\w+\s*=\s*.+", r"(?m)^\s*#", r"(?m)^\s*//")), s.rlike(r"[{}()\[\];=<>:]").cast("int"))
        words = sum((s.rlike("(?i)" + p).cast("int") for p in keywords[1:]), s.rlike("(?i)" + keywords[0]).cast("int"))
        enough = ((words >= 1) & (structure >= 1)) | ((structure >= 2) & (letters >= 4))
        return (F.length(s) >= 12) & ~s.rlike(r"^\p{N}+$") & (letters > 0) & enough

    return F.coalesce(let(strip(code), decide), F.lit(False))


def is_prose(code: Column) -> Column:
    """Few code symbols, many stop words, more than ten words."""

    def decide(s: Column) -> Column:
        symbols = F.length(F.regexp_replace(s, r"[^{}\[\]();=<>_+\-*/#\\$:&|^%]", "")) / F.greatest(F.length(s), F.lit(1))
        words = F.filter(F.split(F.lower(s), r"\W+"), lambda w: w != "")
        stops = F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))) / F.greatest(F.size(words), F.lit(1))
        return (symbols < 0.025) & (stops > 0.15) & (F.size(words) > 10)

    return let(strip(code), decide)


RESUME_WORDS = ("experience", "education", "employment", "skills", "projects", "work history", "objective", "references", "curriculum vitae", "resume")
CODE_MARKS = r"def |class |import |const |function|[{}]|fn "


def snippet_verdict(code: Column, fallback: str = "Python") -> tuple[Column, Column]:
    """Why a snippet is refused, or ``valid``; and its language, ``fallback`` where it is not known."""
    s = strip(F.coalesce(code, F.lit("")))
    low, language = F.lower(s), detect_language(F.coalesce(code, F.lit("")))
    resume = sum((low.rlike(rf"\b{w}\b").cast("int") for w in RESUME_WORDS[1:]), low.rlike(rf"\b{RESUME_WORDS[0]}\b").cast("int"))
    unknown = language == "Unknown"
    verdict = F.when(s == "", "empty").when(s.rlike(r"(?i)^(https?://\S+|www\.\S+)$"), "url").when((resume >= 3) & ~low.rlike(CODE_MARKS), "resume").when(~s.rlike(r"\p{L}"), "no letters")
    verdict = verdict.when(unknown & is_prose(code), "prose").when(unknown & ~is_valid_code(code), "not code").otherwise("valid")
    return verdict, F.when(unknown, fallback).otherwise(language)


def code_lines(code: Column) -> Column:
    return F.size(F.filter(split_lines(code), lambda x: strip(x) != ""))

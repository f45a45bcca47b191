"""Scanners in Python beside the rule table, for what is no pattern.

A scanner is a function of (path, content) to findings. ``Registry`` makes one table function of all its scanners: a
lateral join, or SQL after ``register_sql``, runs them on each text. A scanner that fails on a text gives one row with
the error there, and none of its findings of that text; all others, and its findings of other texts, stay. Texts are
independent rows, so a scan needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import UserDefinedTableFunction


class Finding(NamedTuple):
    """What a scanner says of a line. Left out, the reason is the issue and the risk is the severity."""

    line: int
    severity: str
    issue: str
    category: str = "Security"
    vulnerability_type: str = "Other"
    cwe: str = ""
    suggestion: str = ""
    why_it_matters: str | None = None
    risk_level: str | None = None
    before_code: str = ""
    after_code: str = ""


Scanner = Callable[[str, str], Iterable[tuple]]
#: Severities of findings, fixed values; a finding with another is a failure of its scanner.
SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")
#: Characters of an error that are reported.
ERROR_CHARS = 500
FOUND = StructType().add("scanner", StringType())
for _name in Finding._fields:
    FOUND = FOUND.add(_name, IntegerType() if _name == "line" else StringType())
FOUND = FOUND.add("error", StringType())


def checked(row: tuple) -> Finding:
    """A scanner's row as a finding, or an error where it is none."""
    found = Finding(*row)
    if found.severity not in SEVERITIES:
        raise ValueError(f"no severity: {found.severity!r}")
    own = found._replace(line=int(found.line), why_it_matters=found.why_it_matters or found.issue, risk_level=found.risk_level or found.severity)
    return Finding(own.line, *(str(v) for v in own[1:]))


class Registry:
    """Scanners by name, run in the order of their registration."""

    def __init__(self) -> None:
        self.scanners: dict[str, Scanner] = {}

    def register(self, name: str, scanner: Scanner | None = None) -> Callable:
        """Add a scanner, as a call or as a decorator; a name stands once."""
        if scanner is None:
            return lambda f: self.register(name, f)
        if name in self.scanners:
            raise ValueError(f"scanner {name!r} is registered already")
        self.scanners[name] = scanner
        return scanner

    def run(self, path: str | None, content: str | None) -> Iterator[tuple]:
        """Rows of FOUND for one text; a null text is empty."""
        for name, scanner in self.scanners.items():
            try:
                rows = [(name, *checked(row), None) for row in scanner(path or "", content or "")]
            except Exception as error:  # of this scanner on this text only
                rows = [(name, *[None] * len(Finding._fields), f"{type(error).__name__}: {error}"[:ERROR_CHARS])]
            yield from rows

    def table_function(self) -> UserDefinedTableFunction:
        scanners = dict(self.scanners)

        class Scan:
            def eval(self, path: str, content: str) -> Iterator[tuple]:
                own = Registry()
                own.scanners = scanners
                yield from own.run(path, content)

        return F.udtf(Scan, returnType=FOUND)

    def register_sql(self, spark: SparkSession, name: str = "scan_text") -> None:
        """``SELECT f.*, s.* FROM files f, LATERAL scan_text(f.path, f.content) s``"""
        spark.udtf.register(name, self.table_function())


def scan(files: DataFrame, registry: Registry) -> DataFrame:
    """The columns of ``files`` (path, content and keys), without content, with a row of FOUND for each finding or failure."""
    keys = [c for c in files.columns if c != "content"]
    found = registry.table_function()(F.col("path").outer(), F.col("content").outer())
    return files.lateralJoin(found).select(*keys, *FOUND.names)


def failures(scanned: DataFrame) -> DataFrame:
    """scanner, error, texts: how often each scanner failed, by kind of error."""
    kind = F.substring_index("error", ":", 1)
    return scanned.where(F.col("error").isNotNull()).groupBy("scanner", kind.alias("error")).agg(F.count(F.lit(1)).alias("texts"))

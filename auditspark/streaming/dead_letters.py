"""Dead letters of a stream: a batch that fails is split until the rows that fail stand alone.

``isolating`` makes a function for ``foreachBatch``. It gives a batch to the work as a whole; where that fails, to halves
of it, and so on, so that k bad rows of n cost about k times the logarithm of n runs. Rows that fail alone go to a table
of failures with their arguments, the error and its trace, and the stream goes on. ``replay`` runs the open failures
again, in the same way, and marks those that succeed.

The work is a function of (rows, name) that either does all of a part or nothing, and does a part once however often it
gets it under the same name, as ``KeyedTable.append`` does. A batch that comes again after a crash has the same parts.
"""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditspark.sources.keyed_table import KeyedTable, schema_of

Work = Callable[[DataFrame, str], object]
FAILURES = "task_id string, task string, arguments string, rows long, error string, trace string, failed_at double"
RESOLVED = "task_id string, resolved_at double"
#: Characters of an error and of a trace that are kept.
ERROR_CHARS, TRACE_CHARS = 1000, 20_000
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def failure_tables(spark: SparkSession, path: str) -> tuple[KeyedTable, KeyedTable]:
    """The failures below ``path``, and which of them are resolved."""
    return KeyedTable(spark, f"{path}/failures", FAILURES, ["task_id"], ["failed_at"]), KeyedTable(spark, f"{path}/resolved", RESOLVED, ["task_id"], ["resolved_at"])


def arguments(rows: DataFrame) -> Column:
    """Each row as JSON, nulls included."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), JSON)


def parts(rows: DataFrame, work: Work, name: str, depth: int = 0) -> Iterator[tuple[str, DataFrame, Exception | None]]:
    """Run the work on ``rows``, split where it fails: each part with its name and, if it fails and cannot be split, its error."""
    try:
        work(rows, name)
        yield name, rows, None
        return
    except Exception as error:  # any failure of the work is the rows' failure
        failed = error
    if rows.distinct().limit(2).count() < 2:
        yield name, rows, failed
        return
    half = F.pmod(F.xxhash64(F.lit(depth), *[F.col(f"`{c}`") for c in rows.columns]), F.lit(2))
    for k in (0, 1):
        own = rows.where(half == k)
        if not own.isEmpty():
            yield from parts(own, work, f"{name}.{k}", depth + 1)


def isolating(work: Work, path: str, task: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that keeps failing rows of ``work`` in the failures below ``path``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        failures, _ = failure_tables(batch.sparkSession, path)
        batch.persist()
        try:
            for name, rows, error in parts(batch, work, f"{task}-{batch_id}"):
                if error is not None:
                    trace = "".join(traceback.format_exception(error))[:TRACE_CHARS]
                    said = rows.groupBy(arguments(rows).alias("arguments")).agg(F.count(F.lit(1)).alias("rows"))
                    facts = said.select(F.sha2(F.concat(F.lit(f"{name}:"), "arguments"), 256).alias("task_id"), F.lit(task).alias("task"), "arguments", "rows")
                    told = [F.lit(f"{type(error).__name__}: {error}"[:ERROR_CHARS]).alias("error"), F.lit(trace).alias("trace"), F.lit(time.time()).alias("failed_at")]
                    failures.append(facts.select("*", *told), name)
        finally:
            batch.unpersist()

    return handle


def open_failures(spark: SparkSession, path: str, task: str) -> DataFrame:
    failures, resolved = failure_tables(spark, path)
    return failures.read().where(F.col("task") == task).join(resolved.read().select("task_id"), "task_id", "left_anti")


def replay(spark: SparkSession, path: str, task: str, schema: StructType | str, work: Work, name: str) -> DataFrame:
    """Run the open failures of ``task`` again as rows of ``schema``; returns what is still open.

    What succeeds is marked resolved. Each replay has a ``name`` of its own; one that was cut off may be run again under
    its name, and does nothing twice."""
    _, resolved = failure_tables(spark, path)
    columns = schema_of(schema).names
    again = open_failures(spark, path, task).select("task_id", F.from_json("arguments", schema_of(schema), JSON).alias("row"), F.explode(F.sequence(F.lit(1), "rows")).alias("copy"))

    def run(rows: DataFrame, part: str) -> None:
        work(rows.select(*[F.col("row").getField(c).alias(c) for c in columns]), part)

    again.persist()
    try:
        for part, rows, error in parts(again, run, f"{task}-replay-{name}"):
            if error is None:
                resolved.append(rows.select("task_id", F.lit(time.time()).alias("resolved_at")), part)
    finally:
        again.unpersist()
    return open_failures(spark, path, task)

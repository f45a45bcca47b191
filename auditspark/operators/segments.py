"""Running numbers over long groups in pieces: no group stands in one task, however many of the rows it has.

A piece is computed by itself, its total goes to a table of a row for each piece, running totals of these are the
pieces' offsets. A group of n rows in pieces of p is thus windows of p and one of n / p rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.sources.shared import stored

#: Rows of a piece.
PIECE = 100_000


def with_facts(rows: DataFrame, piece: list[str], facts: DataFrame) -> DataFrame:
    """``rows`` with the facts of their piece; a null key is a key."""
    named = facts.withColumnsRenamed({c: f"_of_{c}" for c in piece})
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in piece])


def positions(rows: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with their place, from 0, among those of their keys by ``order``, which should tell all rows apart.

    Rows are sorted into ranges once and stored, so that a range is the same in both passes over it."""
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id())
    ranged = stored(ranged)
    own = [*keys, "_piece"]
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*own).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select(*own, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy(*own).orderBy(*order)) - 1)
    return with_facts(placed, own, offsets).select(*rows.columns, (F.col("_place") + F.col("_offset")).alias(name))


def counters(rows: DataFrame, keys: list[str], pos: str, reset: Column, step: Column, piece: int = PIECE) -> DataFrame:
    """``rows`` with ``value``: a counter that each row with a ``reset`` sets to it, and that each other row moves by
    ``step`` for those after it; from 0 where none has set it. ``pos`` counts the rows of their keys from 0."""
    columns = rows.columns
    rows = rows.withColumn("_reset", reset).withColumn("_step", F.when(reset.isNull(), step).otherwise(0)).withColumn("_piece", F.floor(F.col(pos) / piece))
    own = [*keys, "_piece"]
    order = Window.partitionBy(*own).orderBy(pos)
    rows = rows.withColumn("_set", F.last("_reset", ignorenulls=True).over(order)).withColumn("_part", F.count("_reset").over(order))
    inside = Window.partitionBy(*own, "_part").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_moved", F.coalesce(F.sum("_step").over(inside), F.lit(0)))

    last = F.max(F.struct("_part", "_set")).alias("_last")
    parts = rows.groupBy(*own, "_part").agg(F.max("_set").alias("_set"), F.sum("_step").alias("_sum"))
    ends = parts.groupBy(*own).agg(last, F.max_by("_sum", "_part").alias("_sum"))
    along = Window.partitionBy(*keys).orderBy("_piece")
    ends = ends.withColumn("_run", F.count("_last._set").over(along)).withColumn("_from", F.last("_last._set", ignorenulls=True).over(along))
    ends = ends.withColumn("_end", F.coalesce("_from", F.lit(0)) + F.sum("_sum").over(Window.partitionBy(*keys, "_run").orderBy("_piece")))
    carried = ends.select(*keys, "_piece", F.lag("_end").over(along).alias("_carried"))
    value = F.coalesce(F.col("_set"), F.col("_carried"), F.lit(0)) + F.col("_moved")
    return with_facts(rows, own, carried).select(*columns, value.alias("value"))

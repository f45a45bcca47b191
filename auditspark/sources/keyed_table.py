"""A table of one row for each key, appended in batches, each of which counts once however often it comes.

Rows lie in Parquet below ``commit=<n>/batch=<name>/bucket=<k>``, so ``spark.read.parquet(path)`` reads the table and a
bucket is a partition. An append looks up the keys of its own buckets only, writes what is new to a staging folder and
commits by one rename to the next number. If another writer has taken that number, the append looks again at what is
there now. A batch that failed before the rename left nothing that readers see; one that comes again after it is known
by its name. Needs a file system with atomic renames, as HDFS or a local one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import quote, unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

BUCKETS = 16
PLACE = ("commit", "batch", "bucket")


def schema_of(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


class KeyedTable:
    """``order``: of rows of one key in a batch the least by these columns, then by all, is the one that counts."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], order: list[str] | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order or [], buckets
        self.schema = schema_of(schema)
        if clash := {c.lower() for c in self.schema.names} & set(PLACE):
            raise ValueError(f"columns {sorted(clash)} are the table's own")

    # the file system

    def _path(self, *parts: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self) -> object:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> dict[int, str]:
        """The name of each committed batch by its number."""
        found = self._files().globStatus(self._path("commit=*", "batch=*")) or []
        places = [str(f.getPath().toString()).rsplit("/", 2)[1:] for f in found]
        return {int(c.removeprefix("commit=")): unquote(b.removeprefix("batch=")) for c, b in places}

    def _rename(self, staging: str, commit: str) -> bool:
        """Whether ``commit`` did not exist and is now what ``staging`` was."""
        base = urlparse(self.path)
        if base.scheme in ("", "file"):
            try:
                os.rename(f"{base.path}/{staging}", f"{base.path}/{commit}")
            except OSError as error:
                if os.path.isdir(f"{base.path}/{commit}"):
                    return False
                raise error
            return True
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(staging), self._path(commit), none)
        except Exception as error:
            if "FileAlreadyExists" in str(error) or self._files().exists(self._path(commit)):
                return False
            raise
        return True

    # the table

    def read(self) -> DataFrame:
        """All committed rows, with the columns of their place."""
        place = [StructField("commit", LongType()), StructField("batch", StringType()), StructField("bucket", IntegerType())]
        schema = StructType([*self.schema.fields, *place])
        if not self.commits():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def _first(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys]
        order = [c for c in self.order if c in rest] + [c for c in rest if c not in self.order]
        own = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        if not rest:
            return own.distinct()
        least = own.groupBy(*self.keys).agg(F.min(F.struct(*order)).alias("_least"))
        return least.select(*[F.col(c) if c in self.keys else F.col(f"_least.{c}").alias(c) for c in self.schema.names])

    def append(self, rows: DataFrame, batch: object, before_commit: Callable[[], None] | None = None) -> bool:
        """Add the rows whose key the table does not have, as batch ``batch``; False where that batch is there already.

        A null in a key is a value like others. ``before_commit`` is called between writing and renaming."""
        name, bucket = str(batch), F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = self._first(rows).withColumn("bucket", bucket)
        while True:
            commits = self.commits()
            if name in commits.values():
                return False
            fresh = new
            if commits:
                own = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` rows
                known = self.read().where(F.col("bucket").isin(own)).select(*[F.col(k).alias(f"_known_{k}") for k in self.keys])
                same = [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in self.keys]
                fresh = new.join(known, same, "left_anti")
            staging = f"_staging/{uuid.uuid4().hex}"
            inner = f"{staging}/batch={quote(name, safe='')}"
            self._files().mkdirs(self._path(inner))
            fresh.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{inner}")
            if before_commit:
                before_commit()
            if self._rename(staging, f"commit={max(commits, default=0) + 1}"):
                return True
            self._files().delete(self._path(staging), True)

    def sweep(self) -> None:
        """Delete staging folders of writers that died; for times when no writer runs."""
        self._files().delete(self._path("_staging"), True)

"""A table of merged keys that batches update: versioned by batch, bucketed by key, safe to replay.

Each batch rewrites only the buckets that its keys fall into, as version n of
these; a bucket's newest version holds all its keys. A batch that runs again
reads versions before its own and overwrites its own, so it counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.sources.scratch import written


@dataclass(frozen=True)
class KeyedStore:
    """``keys`` identify rows, ``time`` orders them; ``merge`` says how each other column meets its older value.

    sum, min and max as named; first and last by time, ties by value; so
    batches in any order end alike. Reads add first_at and last_at, the least
    and greatest time of a key.
    """

    path: str
    schema: str
    keys: tuple[str, ...]
    time: str
    merge: dict[str, str]
    buckets: int = 64

    def _stored(self) -> T.StructType:
        given = T.StructType.fromDDL(self.schema)
        at = given[self.time].dataType
        rows = [given[k] for k in self.keys] + [T.StructField(c, T.LongType() if how == "sum" else given[c].dataType) for c, how in self.merge.items()]
        return T.StructType([*rows, T.StructField("first_at", at), T.StructField("last_at", at), T.StructField("marker", T.BooleanType()), T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def _all(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(self._stored()).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], self._stored())

    def _newest(self, spark: SparkSession, before: int | None) -> DataFrame:
        rows = self._all(spark)
        if before is not None:
            rows = rows.where(F.col("version") < before)
        # Partition columns only: one row a file of the listing, one a bucket after grouping.
        newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
        return rows.join(newest, ["bucket", "version"])

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The rows as they were before version ``before``, or as they are."""
        return self._newest(spark, before).where("NOT marker").drop("marker", "version", "bucket")

    def fresh(self, spark: SparkSession, now: Column, seconds: int) -> DataFrame:
        """Rows whose last time is at most so many seconds before ``now``; older ones stay stored and unseen."""
        age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))
        return self.read(spark).where(age <= seconds * 1_000_000)

    def _put(self, rows: DataFrame, touched: DataFrame, version: int) -> None:
        """Write rows, and a marker for each touched bucket, so that one without rows is known to be empty."""
        marks = touched.select("bucket", F.lit(True).alias("marker"))
        out = rows.withColumn("marker", F.lit(False)).unionByName(marks, allowMissingColumns=True)
        out = out.drop("version").select(*[f.name for f in self._stored() if f.name != "version"])
        # One folder a version, so writing it again replaces it whole.
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version}")

    def put(self, batch: DataFrame, version: int) -> None:
        """Merge a batch as version ``version``. Rows with a null key or time are left out; a key's rows of one batch are merged on the map side first."""
        spark = batch.sparkSession
        b = batch.where(F.col(self.time).isNotNull()).dropna(subset=list(self.keys))
        b = b.select(*self.keys, *self.merge, F.col(self.time).alias("first_at"), F.col(self.time).alias("last_at"), F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket"))
        # Read twice below, and what makes a batch may take long.
        b = written(self._merged(b), "batch")
        touched = b.select("bucket").distinct()
        old = self._newest(spark, version).where("NOT marker").join(touched, "bucket", "left_semi").select(*b.columns)
        self._put(self._merged(b.unionByName(old)), touched, version)

    def _merged(self, rows: DataFrame) -> DataFrame:
        how = {
            "sum": lambda c: F.sum(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c),
            "first": lambda c: F.min_by(c, F.struct("first_at", c)), "last": lambda c: F.max_by(c, F.struct("last_at", c)),
        }
        return rows.groupBy(*self.keys, "bucket").agg(*[how[kind](c).alias(c) for c, kind in self.merge.items()], F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))

    def delete(self, spark: SparkSession, where: Column, version: int) -> None:
        """Leave out the rows that ``where`` holds for, as version ``version``; only buckets that have such rows are rewritten."""
        rows = self._newest(spark, version).where("NOT marker")
        touched = rows.where(where).select("bucket").distinct()
        kept = rows.where(~F.coalesce(where, F.lit(False))).join(touched, "bucket", "left_semi").drop("marker", "version")
        self._put(kept, touched, version)

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""
        return self.put

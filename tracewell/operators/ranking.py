"""Positions and running sums within keys, without one task for a key's rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.scratch import written


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over a key's rows up to each one, in the order of ``order``, which should tell rows apart.

    Rows are dealt by ranges of key and order and written with the number of
    their range. A window then sums within (key, range), and what the key has
    in earlier ranges comes from one row for each key and range. So a key that
    a third of all rows share is spread over a third of the tasks. Null keys
    make one group.
    """
    d = written(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()).withColumn("_v", value), "ranges")
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*by, "_range").agg(F.sum("_v").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    sums = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_range").alias("_kr"), "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.col("_range") == F.col("_kr"))
    out = d.withColumn("_inside", F.sum("_v").over(inside)).join(sums, same)
    return out.select(*rows.columns, (F.col("_inside") + F.col("_before")).alias(name))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, their place among the rows of their key, from 1."""
    return running(rows, by, order, F.lit(1).cast("long"), name)

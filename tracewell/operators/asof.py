"""As-of lookups: each row with the last event strictly before it, per key, without a window over all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of time, about, when rows are spread evenly over it.
BLOCK_ROWS = 100_000


def last_before(rows: DataFrame, events: DataFrame, key: str, time: str, value: Column, name: str = "last", block: float | None = None) -> DataFrame:
    """``rows`` with ``name``: ``value`` of the last of ``events`` with the same ``key`` and a ``time`` strictly before the row's; null if none.

    ``time`` is a number in both tables; of events at one time the greatest
    value counts. Time is cut into blocks (``block`` wide; by default so
    that one holds about BLOCK_ROWS rows of all keys): within a block rows
    and events are merged by a window over (key, block), and what came before
    the block is the last event of an earlier one, found over one row a block
    that has events. So a key that a third of all rows share is as many
    groups as blocks. Rows with a null key or time find nothing and stay.
    """
    ev = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(time).cast("double").alias("_t")).agg(F.max(value).alias("_value"))
    if block is None:
        ends = rows.agg(F.min(time).alias("least"), F.max(time).alias("most"), F.count("*").alias("n")).first()
        span = float((ends["most"] or 0) - (ends["least"] or 0))
        block = span / max(1, ends["n"] // BLOCK_ROWS) or 1.0
    number = lambda c: F.floor(c / F.lit(float(block)))
    ev = ev.withColumn("_block", number(F.col("_t")))
    tail = ev.groupBy("_key", "_block").agg(F.max_by("_value", "_t").alias("_tail"))
    asked = rows.select(*rows.columns, F.col(key).alias("_key"), F.col(time).cast("double").alias("_t"), F.lit(None).cast(ev.schema["_value"].dataType).alias("_value"), F.lit(1).alias("_kind")).withColumn("_block", number(F.col("_t")))
    known = F.col("_key").isNotNull() & F.col("_t").isNotNull()
    # Rows of a time come before events of that time, so only earlier events are seen.
    both = asked.where(known).unionByName(ev.withColumn("_kind", F.lit(2)), allowMissingColumns=True)
    inside = Window.partitionBy("_key", "_block").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)).where("_kind = 1")
    # Blocks that rows ask for and blocks that have events, one row each: the last tail before each.
    blocks = both.select("_key", "_block").distinct().join(tail, ["_key", "_block"], "full")
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.last("_tail", ignorenulls=True).over(earlier)).select("_key", "_block", "_before")
    out = both.join(blocks, ["_key", "_block"], "left").select(*rows.columns, F.coalesce("_inside", "_before").alias(name))
    return out.unionByName(asked.where(~known).select(*rows.columns, F.col("_value").alias(name)))

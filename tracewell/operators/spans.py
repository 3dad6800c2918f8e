"""Marked stretches of texts: which of overlapping ones stay, and what lies between."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolved(spans: DataFrame, by: list[str]) -> DataFrame:
    """The spans that stay when they claim their place greedily: higher ``rank`` first, then the earlier, then the longer, then by ``label``.

    ``spans`` has the columns ``by`` (whose span it is), start, end, rank and
    label; empty ones go, and of equal ones one stays. Spans fall into
    islands, chains of overlaps that nothing crosses; a window finds them by
    start, and each is folded by itself over the set of what stays. So the
    fold's work grows with the square of an island and not of a text.
    """
    s = spans.where("end > start").select(*by, "start", "end", "rank", "label").distinct()
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1))
    s = s.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct((-F.col("rank")).alias("r"), F.col("start"), (-(F.col("end") - F.col("start"))).alias("l"), F.col("end"), F.col("label"))
    groups = s.groupBy(*by, "_island").agg(F.sort_array(F.collect_list(one)).alias("c"))
    free = lambda kept, x: ~F.exists(kept, lambda k: (x["start"] < k["end"]) & (k["start"] < x["end"]))
    kept = F.aggregate("c", F.slice("c", 1, 0), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return groups.select(*by, F.explode(kept).alias("x")).select(*by, "x.start", "x.end", (-F.col("x.r")).alias("rank"), "x.label")


def segments(texts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Each text cut at its resolved spans: key, place, start, end, label (null between spans), part. A text without spans is one part, an empty one too."""
    marks = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("m"))
    t = texts.select(key, F.coalesce("text", F.lit("")).alias("text")).join(marks, key, "left")
    none = F.lit(None).cast("string")
    m = F.coalesce("m", F.array().cast(marks.schema["m"].dataType))
    ends = F.concat(F.array(F.lit(0)), F.transform(m, lambda x: x["end"].cast("int")))
    starts = F.concat(F.transform(m, lambda x: x["start"].cast("int")), F.array(F.length("text")))
    gaps = F.filter(F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("start"), b.alias("end"), none.alias("label"))), lambda g: (g["end"] > g["start"]) | (F.length("text") == 0))
    own = F.transform(m, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["label"].cast("string").alias("label")))
    rows = t.select(key, "text", F.posexplode(F.array_sort(F.concat(gaps, own))).alias("place", "x"))
    return rows.select(key, F.col("place").cast("long").alias("place"), "x.start", "x.end", "x.label", F.substr("text", F.col("x.start") + 1, F.col("x.end") - F.col("x.start")).alias("part"))

"""Rewritten texts that know where each part came from: piecewise offset maps as arrays.

A map is an array of segments (n, n_len, o, o_len, replaced), in order and
without gaps on the rewritten side: ``n_len`` characters from ``n`` of the
rewritten text stand for ``o_len`` characters from ``o`` of the original. A
segment that isn't replaced has equal lengths and maps character by
character; a replaced one maps as a whole. All places count code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<struct<n:int,n_len:int,o:int,o_len:int,replaced:boolean>>"


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once a row.

    The optimizer puts a column's expression wherever the column is used,
    inside lambdas once for each element; it doesn't do so through a
    generator, here of one row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def segment(n: Column, n_len: Column, o: Column, o_len: Column, replaced: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), n_len.cast("int").alias("n_len"), o.cast("int").alias("o"), o_len.cast("int").alias("o_len"), replaced.alias("replaced"))


def from_runs(runs: Column) -> Column:
    """The map of runs (was, now, replaced) that follow each other: texts ``was`` became ``now``. Empty runs leave no segment."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("o"), F.array().cast(SEGMENTS).alias("s"))

    def step(a: Column, r: Column) -> Column:
        was, now = F.length(r["was"]), F.length(r["now"])
        one = F.when((was > 0) | (now > 0), F.array(segment(a["n"], now, a["o"], was, r["replaced"]))).otherwise(F.array().cast(SEGMENTS))
        return F.struct((a["n"] + now).alias("n"), (a["o"] + was).alias("o"), F.concat(a["s"], one).alias("s"))

    return F.aggregate(runs, zero, step, lambda a: a["s"])


def rewritten(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["now"]), "")


def spans(text: Column, pattern: str) -> Column:
    """(start, end, found) of all matches of a pattern that matches no empty text, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda gap, x: F.struct(gap.alias("gap"), x.alias("found")))
    kind = "array<struct<start:int,end:int,found:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["gap"])
        end = start + F.length(p["found"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["found"].alias("found")))).alias("out"))

    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(pairs, zero, step, lambda a: a["out"])).otherwise(F.array().cast(kind))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def to_original(segments: Column, start: Column, end: Column, o_length: Column) -> Column:
    """Original (start, end) of a stretch of the rewritten text; whole replaced segments count. Beyond the last segment it is the original's end."""
    at = lambda k: F.get(F.filter(segments, lambda s: (k >= s["n"]) & (k < s["n"] + s["n_len"])), F.lit(0))
    a, b = at(start), at(F.greatest(start, end - 1))
    first = F.when(a.isNull(), o_length).when(a["replaced"], a["o"]).otherwise(a["o"] + (start - a["n"]))
    last = F.when(b.isNull(), o_length).when(b["replaced"], b["o"] + b["o_len"]).otherwise(b["o"] + (end - 1 - b["n"]) + 1)
    first, last = (F.when(F.size(segments) == 0, x).otherwise(y) for x, y in ((start, first), (end, last)))
    return F.struct(first.cast("int").alias("start"), F.greatest(first, last).cast("int").alias("end"))


def inverse(segments: Column) -> Column:
    """The map from the original to the rewritten text."""
    return F.transform(segments, lambda s: segment(s["o"], s["o_len"], s["n"], s["n_len"], s["replaced"]))


def composed(outer: Column, inner: Column, o_length: Column) -> Column:
    """The map of two rewritings, ``inner`` first: from the last text to the first.

    Where the outer map copies, it is cut at the inner's segments and takes
    their places; inside a replaced inner segment a copied part stands for
    that whole segment. Where it replaces, the inner map finds the stretch.
    """

    def through(s: Column) -> Column:
        whole = to_original(inner, s["o"], s["o"] + s["o_len"], o_length)
        own = segment(s["n"], s["n_len"], whole["start"], F.when(s["o_len"] > 0, whole["end"] - whole["start"]).otherwise(0), F.lit(True))
        met = F.filter(inner, lambda t: (t["n"] < s["o"] + s["o_len"]) & (s["o"] < t["n"] + t["n_len"]))

        def clipped(t: Column) -> Column:
            a, b = F.greatest(t["n"], s["o"]), F.least(t["n"] + t["n_len"], s["o"] + s["o_len"])
            o = F.when(t["replaced"], t["o"]).otherwise(t["o"] + (a - t["n"]))
            return segment(s["n"] + (a - s["o"]), b - a, o, F.when(t["replaced"], t["o_len"]).otherwise(b - a), t["replaced"])

        return F.when(s["replaced"], F.array(own)).otherwise(F.transform(met, clipped))

    return F.flatten(F.transform(outer, through))

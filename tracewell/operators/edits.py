"""Joins of similar strings by a deletion neighbourhood: equal deletes are joined, distances checked after.

Two strings within d edits share a string that each becomes by deleting at
most d of its characters. So the join is one of equal keys, which Spark can
shuffle and split, and its work grows with the rows and not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shorter_by_one(text: Column) -> Column:
    """All strings that deleting one character makes; none of an empty one."""
    n = F.length(text)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.left(text, i - 1), F.substr(text, i + 1))))).otherwise(F.array().cast("array<string>"))


def deletions(text: Column, edits: int) -> Column:
    """The string and all that deleting up to ``edits`` characters makes, each once."""
    out = last = F.array(text)
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, shorter_by_one)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def _marked(strings: Column, edits: int) -> Column:
    """Keys of a number of edits; strings of different numbers don't meet."""
    return F.transform(strings, lambda x: F.concat(F.lit(f"{edits}:"), x))


def keys(text: Column, edits: Column, most: int) -> Column:
    """Keys of one side for a number of edits that varies by row, from 0 to ``most``."""
    out = F.array().cast("array<string>")
    for d in range(most, -1, -1):
        out = F.when(edits == d, _marked(deletions(text, d), d)).otherwise(out)
    return out


def all_keys(text: Column, lengths: dict[int, tuple[int, int]]) -> Column:
    """Keys of the side that meets rows of any number of edits d; ``lengths[d]`` are the least and greatest length with which the other side allows d."""
    none = F.array().cast("array<string>")
    parts = [F.when(F.length(text).between(low - d, high + d), _marked(deletions(text, d), d)).otherwise(none) for d, (low, high) in lengths.items()]
    return F.flatten(F.array(*parts))


def similar(left: DataFrame, right: DataFrame, column: str, edits: int) -> DataFrame:
    """Distinct pairs of the values of ``column`` at most ``edits`` apart: a, b, distance. Nulls pair with nothing."""
    side = lambda df, name: df.where(F.col(column).isNotNull()).select(F.col(column).alias(name)).distinct().withColumn("key", F.explode(deletions(F.col(name), edits)))
    pairs = side(left, "a").join(side(right, "b"), "key").select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= edits)

"""Evaluation of detectors against labels, and distribution statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ranking import numbered


def ratio(part: Column, whole: Column) -> Column:
    """part / whole rounded to four decimals, null of nothing."""
    return F.when(whole > 0, F.floor(part * 10_000.0 / whole + 0.5) / 10_000.0)


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, tn, fn and the rates from them, overall (all keys null) and per value of each key, in one pass.

    ``rows`` has booleans ``actual`` and ``predicted``.
    """
    sets = ", ".join(["()"] + [f"({c})" for c in by])
    counts = ", ".join(f"count_if({c}) AS {a}" for a, c in (("tp", "actual AND predicted"), ("fp", "NOT actual AND predicted"), ("tn", "NOT actual AND NOT predicted"), ("fn", "actual AND NOT predicted")))
    t = rows.sparkSession.sql(f"SELECT {', '.join(by)}, {counts} FROM {{rows}} GROUP BY GROUPING SETS ({sets})", rows=rows)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    t = t.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("false_positive_rate", ratio(fp, fp + tn))
    return t.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def consistency(runs: DataFrame) -> DataFrame:
    """Per case over repeated runs: runs, distinct verdicts, the modal verdict (ties by name) and its share."""
    n = runs.groupBy("case_id", "verdict").agg(F.count("*").alias("n"))
    best = Window.partitionBy("case_id").orderBy(F.desc("n"), "verdict")
    t = n.withColumn("turn", F.row_number().over(best)).withColumn("runs", F.sum("n").over(Window.partitionBy("case_id"))).withColumn("verdicts", F.count("*").over(Window.partitionBy("case_id")))
    return t.where("turn = 1").select("case_id", F.col("runs").cast("long").alias("runs"), "verdicts", F.col("verdict").alias("modal"), ratio(F.col("n"), F.col("runs")).alias("share"))


def distribution(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """min, max, mean, exact median and p95 (the value at floor(0.95 * (n - 1))) per group.

    Rows are counted per value before anything is ordered, so a window sorts
    the distinct values of a group, not its rows.
    """
    w = Window.partitionBy(*by)
    c = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    c = c.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    holds = lambda rank: (rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto"))
    at = lambda rank: F.max(F.when(holds(rank), F.col("v")))
    low, high = at(F.floor((F.col("n") - 1) / 2)), at(F.ceil((F.col("n") - 1) / 2))
    return c.groupBy(*by).agg(F.min("v").alias("least"), F.max("v").alias("most"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), ((low + high) / 2).alias("median"), at(F.floor(0.95 * (F.col("n") - 1))).alias("p95"))


def duplicate_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Numbers rows of equal ``key``: the first by ``order`` stays, later ones name it. Adds ``copy`` (1 for the first) and ``first_row``."""
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("first_row"))
    return numbered(rows, [key], [order], "copy").join(first, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def streaks(days: DataFrame, who: str) -> DataFrame:
    """Longest runs of consecutive days per ``who``: length and last day. ``days`` has who and day."""
    d = days.select(who, "day").distinct()
    d = d.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy(who).orderBy("day"))))
    runs = d.groupBy(who, "island").agg(F.count("*").alias("days"), F.max("day").alias("last_day"))
    best = Window.partitionBy(who).orderBy(F.desc("days"), F.desc("last_day"))
    return runs.withColumn("turn", F.row_number().over(best)).where("turn = 1").select(who, "days", "last_day")


def round_robin(rows: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """Interleaves kinds: all firsts, then all seconds. Adds ``place``."""
    return numbered(rows, [kind], order, "place")


def case_summaries(cases: DataFrame, by: list[str]) -> DataFrame:
    """How detectors did on cases, overall (all keys null) and per value of each key, in one pass.

    ``cases`` has expected, forbidden and codes (arrays of codes) and level.
    A case passes with every expected code and no forbidden one; legitimate
    cases expect none, and one is a false positive above the level ``low``.
    Null arrays count as empty.
    """
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    in_codes = lambda c: F.size(F.filter(some(c), lambda x: F.array_contains(some("codes"), x)))
    t = cases.select(*by, F.size(some("expected")).alias("e"), in_codes("expected").alias("f"), F.size(some("forbidden")).alias("c"), in_codes("forbidden").alias("h"), F.coalesce(F.col("level") != "low", F.lit(True)).alias("raised"))
    sets = ", ".join(["()"] + [f"({c})" for c in by])
    counts = "count(*) AS cases, count_if(e = f AND h = 0) AS passed, sum(e) AS expected, sum(f) AS found, sum(c) AS forbidden_checks, sum(h) AS forbidden_hits, count_if(e = 0) AS legit, count_if(e = 0 AND raised) AS legit_raised"
    t = t.sparkSession.sql(f"SELECT {', '.join(by)}, {counts} FROM {{t}} GROUP BY GROUPING SETS ({sets})", t=t)
    rates = {"pass_rate": ("passed", "cases"), "recall": ("found", "expected"), "legit_false_positive_rate": ("legit_raised", "legit")}
    return t.withColumns({name: ratio(F.col(a), F.col(b)) for name, (a, b) in rates.items()})


def variant_groups(cases: DataFrame, group: str) -> DataFrame:
    """Per group of cases that say the same: members, distinct sets of codes, whether there is one only. Sets are counted before groups are, so a large group is split."""
    sets = cases.select(group, F.array_join(F.array_sort(F.array_distinct(F.coalesce("codes", F.array().cast("array<string>")))), ",").alias("codes")).groupBy(group, "codes").agg(F.count("*").alias("n"))
    return sets.groupBy(group).agg(F.sum("n").alias("members"), F.count("*").alias("code_sets")).withColumn("consistent", F.col("code_sets") == 1)

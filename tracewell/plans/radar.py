"""Trend reports over flagged checks: calendar buckets at UTC+4 and an equal period before.

Counters are keyed by day and dimensions; every report starts from them, so
the observations are aggregated once, on the map side first.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _month(d: date, back: int) -> date:
    k = d.year * 12 + d.month - 1 - back
    return date(k // 12, k % 12 + 1, 1)


@dataclass(frozen=True)
class Range:
    """Buckets of a report, and the period of the same length before them; ends are exclusive."""

    buckets: list[tuple[date, date]]
    start: date
    end: date
    before: date

    @classmethod
    def of(cls, name: str, today: date) -> Range:
        """7d or 30d: days up to today; 12m: calendar months. ValueError for any other."""
        if name in ("7d", "30d"):
            n = int(name[:-1])
            days = [today - timedelta(days=n - 1 - i) for i in range(n)]
            return cls([(d, d + timedelta(days=1)) for d in days], days[0], today + timedelta(days=1), days[0] - timedelta(days=n))
        if name == "12m":
            starts = [_month(today, 11 - i) for i in range(12)]
            ends = [*starts[1:], today + timedelta(days=1)]
            return cls(list(zip(starts, ends, strict=True)), starts[0], ends[-1], _month(today, 23))
        raise ValueError(f"unknown range {name}")

    def current(self, day: str = "day") -> Column:
        return (F.col(day) >= F.lit(self.start)) & (F.col(day) < F.lit(self.end))

    def previous(self, day: str = "day") -> Column:
        return (F.col(day) >= F.lit(self.before)) & (F.col(day) < F.lit(self.start))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves upward; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5)).otherwise(F.lit(0)).cast("long")


def flagged(observations: DataFrame) -> DataFrame:
    """Checks whose verdict isn't safe; reports count these."""
    return observations.where("verdict <> 'safe'")


def daily_counters(observations: DataFrame) -> DataFrame:
    """Flagged checks per day, verdict, scam_type, claimed_identity and channel."""
    return flagged(observations).groupBy("day", "verdict", "scam_type", "claimed_identity", "channel").agg(F.count("*").alias("n"))


def domain_counters(observations: DataFrame) -> DataFrame:
    """Flagged checks per day and imitating domain."""
    return flagged(observations).where("domain IS NOT NULL").groupBy("day", "domain", "imitates").agg(F.count("*").alias("n"))


def totals(daily: DataFrame, r: Range) -> DataFrame:
    """Scams, flagged checks, scams of the period before, and the change in percent (null without any before)."""
    scam = F.col("verdict") == "scam"
    one = daily.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long").alias(a) for a, c in (("scams", scam & r.current()), ("flagged", r.current()), ("previous_scams", scam & r.previous()))])
    change = F.when(F.col("previous_scams") > 0, F.floor((F.col("scams") - F.col("previous_scams")) * 100.0 / F.col("previous_scams") + 0.5)).cast("long")
    return one.withColumn("change_pct", change)


def series(daily: DataFrame, r: Range) -> DataFrame:
    """Scams in each bucket, empty ones included."""
    spark = daily.sparkSession
    calendar = F.broadcast(spark.createDataFrame(r.buckets, "bucket date, until date"))
    n = daily.where(r.current() & (F.col("verdict") == "scam")).groupBy("day").agg(F.sum("n").alias("n"))
    return calendar.join(n, (F.col("day") >= F.col("bucket")) & (F.col("day") < F.col("until")), "left").groupBy("bucket").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("scams"))


def top_types(daily: DataFrame, r: Range, k: int = 5) -> DataFrame:
    """The k most frequent scam types with their share of the typed checks."""
    t = daily.where(r.current() & (F.col("scam_type") != "")).groupBy("scam_type").agg(F.sum("n").cast("long").alias("checks"))
    t = t.withColumn("pct", percent(F.col("checks"), F.sum("checks").over(Window.partitionBy())))
    return t.orderBy(F.desc("checks"), "scam_type").limit(k)


def top_identity(daily: DataFrame, r: Range) -> DataFrame:
    """The most imitated identity and its share of all flagged checks."""
    flagged = daily.where(r.current()).agg(F.sum("n").cast("long").alias("flagged"))
    t = daily.where(r.current() & (F.col("claimed_identity") != "")).groupBy("claimed_identity").agg(F.sum("n").cast("long").alias("checks"))
    return t.orderBy(F.desc("checks"), "claimed_identity").limit(1).join(F.broadcast(flagged)).select("claimed_identity", "checks", percent(F.col("checks"), F.col("flagged")).alias("share_pct"))


def rising(daily: DataFrame, r: Range) -> DataFrame:
    """The scam type that grew most against the period before, with its most frequent channel; no row if none grew."""
    typed = daily.where("scam_type <> ''")
    t = typed.groupBy("scam_type").agg(F.coalesce(F.sum(F.when(r.current(), F.col("n"))), F.lit(0)).cast("long").alias("current"), F.coalesce(F.sum(F.when(r.previous(), F.col("n"))), F.lit(0)).cast("long").alias("previous"))
    best = t.where("current > previous").orderBy(F.desc(F.col("current") - F.col("previous")), F.desc("current"), "scam_type").limit(1)
    by_channel = typed.where(r.current() & (F.col("channel") != "")).groupBy("scam_type", "channel").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("scam_type").orderBy(F.desc("n"), "channel")
    main = by_channel.withColumn("turn", F.row_number().over(first)).where("turn = 1").select("scam_type", F.col("channel").alias("main_channel"))
    return F.broadcast(best).join(main, "scam_type", "left")


def fake_links(domains: DataFrame, r: Range, k: int = 5) -> DataFrame:
    """The k most frequent imitating domains."""
    t = domains.where(r.current()).groupBy("domain", "imitates").agg(F.sum("n").cast("long").alias("times"))
    return t.orderBy(F.desc("times"), "domain", "imitates").limit(k).withColumn("imitates", F.nullif("imitates", F.lit("")))

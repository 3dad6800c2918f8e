"""Trend reports over generated observations, as of 2024-01-29."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans import radar
from tracewell.sources import messages as src

TODAY = date(2024, 1, 29)
WEEK, MONTH, YEAR = (radar.Range.of(x, TODAY) for x in ("7d", "30d", "12m"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radar.daily_counters(src.observations(spark, sf_dir))


def scam_type_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns (type and identity) per type and their messages."""
    c = radar.flagged(src.observations(spark, sf_dir)).groupBy("scam_type", "claimed_identity").agg(F.count("*").alias("messages"))
    return c.groupBy("scam_type").agg(F.count("*").alias("campaigns"), F.sum("messages").alias("messages"))


def trend_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four totals in one row."""
    o = radar.flagged(src.observations(spark, sf_dir))
    return o.agg(F.count("*").alias("checks"), F.coalesce(F.count_if(F.col("verdict") == "scam"), F.lit(0)).alias("scams"), F.countDistinct("scam_type", "claimed_identity").alias("campaigns"), F.countDistinct("domain").alias("domains"))


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports per sender; the five most reported, their keys masked to the last four characters."""
    r = src.reports(spark, sf_dir).where("sender_key IS NOT NULL").groupBy("sender_key").agg(F.count("*").alias("n"))
    return r.orderBy(F.desc("n"), "sender_key").limit(5).select(F.concat(F.lit("****"), F.expr("right(concat('0000', sender_key), 4)")).alias("sender"), "n")


def week_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts in the seven days up to a moment: after its start, its end included."""
    at = F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where((F.col("ts") > at - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") <= at))
    return e.agg(F.count("*").alias("total"), *[F.count_if(F.col("event_type") == x).alias(x) for x in ("error", "purchase", "signup")])


def _sql(range_: radar.Range) -> str:
    return f"{src.OBSERVATIONS_SQL}, r AS (SELECT DATE '{range_.start}' AS a, DATE '{range_.end}' AS b, DATE '{range_.before}' AS p), o AS (SELECT * FROM observations, r WHERE day >= p AND day < b)"


def _totals_sql(r: radar.Range) -> str:
    return f"""WITH {_sql(r)}, t AS (SELECT count(*) FILTER (WHERE verdict = 'scam' AND day >= a) AS scams, count(*) FILTER (WHERE day >= a) AS flagged, count(*) FILTER (WHERE verdict = 'scam' AND day < a) AS previous_scams FROM o)
 SELECT scams, flagged, previous_scams, CASE WHEN previous_scams > 0 THEN CAST(floor((scams - previous_scams) * 100.0 / previous_scams + 0.5) AS BIGINT) END AS change_pct FROM t"""


def _series_sql(r: radar.Range) -> str:
    rows = ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in r.buckets)
    return f"WITH {_sql(r)} SELECT bucket, count(day) AS scams FROM (VALUES {rows}) c(bucket, until) LEFT JOIN (SELECT day FROM o WHERE verdict = 'scam') x ON day >= bucket AND day < until GROUP BY bucket"


QUERIES = {
    "radar_week_totals": lambda s, d: radar.totals(_daily(s, d), WEEK),
    "radar_month_totals": lambda s, d: radar.totals(_daily(s, d), MONTH),
    "radar_week_series": lambda s, d: radar.series(_daily(s, d), WEEK),
    "radar_month_series": lambda s, d: radar.series(_daily(s, d), MONTH),
    "radar_year_series": lambda s, d: radar.series(_daily(s, d), YEAR),
    "radar_top_types": lambda s, d: radar.top_types(_daily(s, d), WEEK),
    "radar_top_identity": lambda s, d: radar.top_identity(_daily(s, d), WEEK),
    "radar_rising": lambda s, d: radar.rising(_daily(s, d), WEEK),
    "radar_fake_links": lambda s, d: radar.fake_links(radar.domain_counters(src.observations(s, d)), WEEK),
    "scam_type_totals": scam_type_totals,
    "trend_totals": trend_totals,
    "report_counts": report_counts,
    "week_stats": week_stats,
}
ORACLE = {
    "radar_week_totals": _totals_sql(WEEK),
    "radar_month_totals": _totals_sql(MONTH),
    "radar_week_series": _series_sql(WEEK),
    "radar_month_series": _series_sql(MONTH),
    "radar_year_series": _series_sql(YEAR),
    "radar_top_types": f"WITH {_sql(WEEK)}, t AS (SELECT scam_type, count(*) AS checks FROM o WHERE day >= a AND scam_type <> '' GROUP BY 1) SELECT scam_type, checks, CAST(floor(checks * 100.0 / sum(checks) OVER () + 0.5) AS BIGINT) AS pct FROM t ORDER BY checks DESC, scam_type LIMIT 5",
    "radar_top_identity": f"WITH {_sql(WEEK)} SELECT claimed_identity, count(*) AS checks, CAST(floor(count(*) * 100.0 / (SELECT count(*) FROM o WHERE day >= a) + 0.5) AS BIGINT) AS share_pct FROM o WHERE day >= a AND claimed_identity <> '' GROUP BY 1 ORDER BY checks DESC, claimed_identity LIMIT 1",
    "radar_rising": f"""WITH {_sql(WEEK)}, t AS (SELECT scam_type, count(*) FILTER (WHERE day >= a) AS current, count(*) FILTER (WHERE day < a) AS previous FROM o WHERE scam_type <> '' GROUP BY 1),
 best AS (SELECT * FROM t WHERE current > previous ORDER BY current - previous DESC, current DESC, scam_type LIMIT 1)
 SELECT best.*, (SELECT channel FROM o WHERE day >= a AND channel <> '' AND o.scam_type = best.scam_type GROUP BY channel ORDER BY count(*) DESC, channel LIMIT 1) AS main_channel FROM best""",
    "radar_fake_links": f"WITH {_sql(WEEK)} SELECT domain, nullif(imitates, '') AS imitates, count(*) AS times FROM o WHERE day >= a AND domain IS NOT NULL GROUP BY o.domain, o.imitates ORDER BY times DESC, domain, o.imitates LIMIT 5",
    "scam_type_totals": f"WITH {src.OBSERVATIONS_SQL}, c AS (SELECT scam_type, claimed_identity, count(*) AS messages FROM observations GROUP BY 1, 2) SELECT scam_type, count(*) AS campaigns, CAST(sum(messages) AS BIGINT) AS messages FROM c GROUP BY 1",
    "trend_totals": f"WITH {src.OBSERVATIONS_SQL} SELECT count(*) AS checks, count(*) FILTER (WHERE verdict = 'scam') AS scams, count(DISTINCT (scam_type, claimed_identity)) AS campaigns, count(DISTINCT domain) AS domains FROM observations",
    "report_counts": f"WITH {src.REPORTS_SQL} SELECT '****' || right('0000' || sender_key, 4) AS sender, count(*) AS n FROM reports WHERE sender_key IS NOT NULL GROUP BY sender_key ORDER BY n DESC, sender_key LIMIT 5",
    "week_stats": "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'signup') AS signup FROM events WHERE ts > TIMESTAMP '2024-01-22 12:00:00' AND ts <= TIMESTAMP '2024-01-29 12:00:00'",
}

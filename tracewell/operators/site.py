"""Pages and headers: findings, points by category, grade, checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the grading.
POINTS = {"critical": 40.0, "high": 20.0, "medium": 8.0, "low": 3.0, "info": 0.0}
CATEGORY_CAP = 35
REPEAT_SHARE = 0.25
GRADES = [("A", 90), ("B", 75), ("C", 60), ("D", 40)]
# End of the fixed values.


def page_findings(pages: DataFrame) -> DataFrame:
    """page_id, category, kind, severity: what a page's own markup shows, one row an occurrence.

    Inline scripts, links without transport security, external scripts
    without an integrity hash, forms that post elsewhere, password fields.
    """
    html = F.lower("html")
    rules = [
        ("content", "inline script", "low", r"<script>"),
        ("content", "inline handler", "low", r"<[a-z]+[^>]*\son[a-z]+="),
        ("transport", "insecure link", "medium", r"(?:href|src)=\"http://"),
        ("supply", "script without integrity", "medium", r"<script[^>]*\ssrc=\"https?://"),
        ("forms", "form to another site", "high", r"<form[^>]*action=\"https?://"),
        ("forms", "password field", "info", r"<input[^>]*type=\"password\""),
        ("content", "style block", "info", r"<style"),
    ]
    found = F.filter(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.regexp_count(html, F.lit(r)).alias("times")) for c, k, s, r in rules]), lambda x: x["times"] > 0)
    return pages.select("page_id", F.explode(found).alias("x")).select("page_id", F.explode(F.array_repeat("x", F.col("x.times"))).alias("x")).select("page_id", "x.category", "x.kind", "x.severity")


def points_lost(findings: DataFrame, key: str) -> DataFrame:
    """key, category, points: the first finding of a kind counts in full, repeats a quarter; a category loses 35 at most."""
    weight = F.lit(0.0)
    for severity, p in POINTS.items():
        weight = F.when(F.col("severity") == severity, p).otherwise(weight)
    kinds = findings.groupBy(key, "category", "kind").agg(F.count("*").alias("n"), F.sum(weight).alias("total"), F.max(weight).alias("top"))
    lost = F.col("top") + (F.col("total") - F.col("top")) * REPEAT_SHARE
    return kinds.groupBy(key, "category").agg(F.least(F.lit(CATEGORY_CAP), F.floor(F.sum(lost) + 0.5)).cast("long").alias("points"))


def grade(score: Column) -> Column:
    out = F.lit("F")
    for g, least in reversed(GRADES):
        out = F.when(score >= least, g).otherwise(out)
    return out


def report(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """page_id, score, grade; pages without findings keep 100."""
    lost = points_lost(findings, "page_id").groupBy("page_id").agg(F.sum("points").alias("lost"))
    t = pages.select("page_id").join(lost, "page_id", "left").withColumn("score", F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0))).cast("long"))
    return t.select("page_id", "score", grade(F.col("score")).alias("grade"))


def checklist(pages: DataFrame, findings: DataFrame, checks: list[tuple[str, str]]) -> DataFrame:
    """page_id, check, status for each (check, kind): fail, warn, info or pass by the worst matching finding."""
    spark = pages.sparkSession
    dim = F.broadcast(spark.createDataFrame(checks, "check string, kind string"))
    worst = findings.join(dim, "kind").groupBy("page_id", "check").agg(F.bool_or(F.col("severity").isin("critical", "high")).alias("bad"), F.bool_or(F.col("severity").isin("medium", "low")).alias("mild"))
    every = pages.select("page_id", F.explode(F.array(*[F.lit(c) for c in sorted({c for c, _ in checks})])).alias("check"))
    status = F.when(F.col("bad"), "fail").when(F.col("mild"), "warn").when(F.col("bad").isNotNull(), "info").otherwise("pass")
    return every.join(worst, ["page_id", "check"], "left").select("page_id", "check", status.alias("status"))


def blocked_address(ip: Column) -> Column:
    """Whether an IPv4 address lies in a range that a fetcher mustn't reach; anything that isn't an address is blocked too."""
    ok = F.rlike(ip, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"))
    part = F.transform(F.split(ip, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("long"))
    n = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    ranges = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]
    inside = F.lit(False)
    for base, bits in ranges:
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
        inside = inside | ((n >= low) & (n < low + (1 << (32 - bits))))
    return ~F.coalesce(ok & F.forall(part, lambda x: x <= 255), F.lit(False)) | F.coalesce(inside, F.lit(False))


def rank_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__turn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__turn = 1").drop("__turn")

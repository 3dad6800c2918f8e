"""Pages, conversations, payments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import conversation, site
from tracewell.sources import messages as src

CHECKS = [("scripts", "inline script"), ("scripts", "inline handler"), ("transport", "insecure link"), ("forms", "form to another site"), ("forms", "password field"), ("styles", "style block")]
CODES = ["SOC-05", "SOC-06", "SOC-01", "SOC-03", "PAY-01", "PAY-04", "SEC-01", "URL-01", "SOC-02"]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.page_findings(_pages(spark, sf_dir)).groupBy("category", "kind", "severity").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def page_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    return site.report(p, site.page_findings(p))


def page_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.points_lost(site.page_findings(_pages(spark, sf_dir)), "page_id")


def page_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    return site.checklist(p, site.page_findings(p), CHECKS)


def blocked_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up addresses of customers, and whether a fetcher must avoid them."""
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    ip = F.concat_ws(".", *[x.cast("string") for x in (k * 7 % 260, k * 13 % 256, k * 5 % 256, k % 256)])
    return c.select("c_custkey", ip.alias("ip"), site.blocked_address(ip).alias("blocked"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def transcript_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.transcript(_turns(spark, sf_dir))


def located_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn of the first, middle and last character of every part of a transcript, and of the separator after it (none)."""
    parts = conversation.transcript(_turns(spark, sf_dir))
    at = F.explode(F.array("start", F.expr("(start + end) div 2"), F.expr("end - 1"), "end"))
    return conversation.locate(parts.select("conv_id", at.alias("at")).distinct(), parts)


def stage_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return conversation.stages(t.select("conv_id", "turn", src.pick(CODES, F.col("conv_id") + F.col("turn") * 5).alias("code")))


def payee_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    return conversation.payee_verdict(o.select(k.alias("id"), (F.col("o_custkey") % 4 != 0).alias("known"), (k % 11 != 0).alias("name_match"), F.col("o_totalprice").alias("amount"), (k % 17 == 0).alias("on_call")))


_RULES = [("content", "inline script", "low", r"<script>"), ("content", "inline handler", "low", r"<[a-z]+[^>]*\son[a-z]+="), ("transport", "insecure link", "medium", r'(?:href|src)="http://'), ("supply", "script without integrity", "medium", r'<script[^>]*\ssrc="https?://'), ("forms", "form to another site", "high", r'<form[^>]*action="https?://'), ("forms", "password field", "info", r'<input[^>]*type="password"'), ("content", "style block", "info", r"<style")]
_F = "f AS (" + " UNION ALL ".join(f"SELECT page_id, '{c}' AS category, '{k}' AS kind, '{s}' AS severity, {site.POINTS[s]}::DOUBLE AS w, len(regexp_extract_all(lower(html), '{r}')) AS n FROM pages" for c, k, s, r in _RULES) + "), g AS (SELECT * FROM f WHERE n > 0)"
_L = f"{_F}, l AS (SELECT page_id, category, CAST(least({site.CATEGORY_CAP}, floor(sum(w + (n - 1) * w * {site.REPEAT_SHARE}) + 0.5)) AS BIGINT) AS points FROM g GROUP BY 1, 2)"
_T = f"n AS (SELECT conv_id, turn, length(text) + 2 AS n FROM conversations), k AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM n) WHERE used <= {conversation.BUDGET}), p AS (SELECT conv_id, turn, CAST(upto - n AS BIGINT) AS start, CAST(upto - 2 AS BIGINT) AS \"end\" FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM k))"
_IP = "(c_custkey * 7 % 260) || '.' || (c_custkey * 13 % 256) || '.' || (c_custkey * 5 % 256) || '.' || (c_custkey % 256)"
_STAGES = "CASE code " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in conversation.STAGE_OF.items()) + " END"
QUERIES = {f.__name__: f for f in (page_findings, page_grades, page_points, page_checklist, blocked_addresses, transcript_parts, located_spans, stage_timeline, payee_verdicts)}
ORACLE = {
    "page_findings": f"WITH {_F} SELECT category, kind, severity, CAST(sum(n) AS BIGINT) AS n, count(*) AS pages FROM g GROUP BY 1, 2, 3",
    "page_points": f"WITH {_L} SELECT * FROM l",
    "page_grades": f"WITH {_L}, s AS (SELECT page_id, CAST(greatest(0, 100 - coalesce(sum(points), 0)) AS BIGINT) AS score FROM pages LEFT JOIN l USING (page_id) GROUP BY 1) SELECT page_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM s",
    "page_checklist": f"WITH {_F}, c AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in CHECKS)}) t(chk, kind)), w AS (SELECT page_id, chk, bool_or(severity IN ('critical', 'high')) AS bad, bool_or(severity IN ('medium', 'low')) AS mild FROM g JOIN c USING (kind) GROUP BY 1, 2) SELECT page_id, e.chk AS check, CASE WHEN bad THEN 'fail' WHEN mild THEN 'warn' WHEN bad IS NOT NULL THEN 'info' ELSE 'pass' END AS status FROM (SELECT page_id, chk FROM pages, (SELECT DISTINCT chk FROM c)) e LEFT JOIN w USING (page_id, chk)",
    "blocked_addresses": f"WITH a AS (SELECT c_custkey, {_IP} AS ip, c_custkey * 7 % 260 AS x, c_custkey * 13 % 256 AS y, c_custkey * 5 % 256 AS z FROM customer) SELECT c_custkey, ip, x > 255 OR x IN (0, 10, 127) OR (x = 100 AND y BETWEEN 64 AND 127) OR (x = 169 AND y = 254) OR (x = 172 AND y BETWEEN 16 AND 31) OR (x = 192 AND (y = 168 OR (y = 0 AND z IN (0, 2)))) OR (x = 198 AND (y IN (18, 19) OR (y = 51 AND z = 100))) OR (x = 203 AND y = 0 AND z = 113) OR x >= 224 AS blocked FROM a",
    "transcript_parts": f"WITH {_T} SELECT * FROM p",
    "located_spans": f"WITH {_T}, a AS (SELECT DISTINCT conv_id, unnest([start, (start + \"end\") // 2, \"end\" - 1, \"end\"]) AS pos FROM p) SELECT a.conv_id, pos AS at, turn FROM a JOIN p ON a.conv_id = p.conv_id AND pos >= start AND pos < \"end\"",
    "stage_timeline": f"WITH f AS (SELECT DISTINCT conv_id, turn, {src.sql_pick(CODES, 'conv_id + turn * 5')} AS code FROM conversations), s AS (SELECT *, {_STAGES} AS stage FROM f) SELECT conv_id, stage, min(turn) AS first_turn, count(*) AS flags FROM s WHERE stage IS NOT NULL GROUP BY 1, 2",
    "payee_verdicts": "WITH p AS (SELECT o_orderkey AS id, o_custkey % 4 <> 0 AS known, o_orderkey % 11 <> 0 AS nm, o_totalprice >= 50000 AS large, o_orderkey % 17 = 0 AS oc FROM orders) SELECT id, CASE WHEN NOT nm OR oc THEN 'stop' WHEN NOT known OR large THEN 'caution' ELSE 'clear' END AS verdict, concat_ws(',', CASE WHEN NOT nm THEN 'name_mismatch' END, CASE WHEN oc THEN 'directed_on_call' END, CASE WHEN NOT known THEN 'new_payee' END, CASE WHEN large THEN 'large_amount' END) AS findings FROM p",
}

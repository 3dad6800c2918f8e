"""Report waves and near-duplicate templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import asof
from tracewell.operators import community as ops
from tracewell.operators.ranking import running
from tracewell.sources import messages as src
from tracewell.sources.scratch import written

NOW = "2024-01-28 18:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def wave_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tier(ops.wave_metrics(src.reports(spark, sf_dir), ["template"], _now()))


def wave_by_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tier(ops.wave_metrics(src.reports(spark, sf_dir).where("sender_key IS NOT NULL"), ["sender_key"], _now()))


def trailing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each report, how many of its template came in the 24 hours and 7 days before it, itself not counted."""
    r = src.reports(spark, sf_dir).select("id", "template", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    # Reports of a template up to each moment; counts before two moments give those between.
    upto = written(running(r.groupBy("template", "at").agg(F.count("*").alias("n")), ["template"], ["at"], F.col("n"), "upto"), "upto")
    for name, seconds in (("before", 0), ("day", 86400), ("week", 7 * 86400)):
        r = asof.last_before(r.withColumn("at", F.col("at") - seconds * 1_000_000), upto, "template", "at", F.col("upto"), name).withColumn("at", F.col("at") + seconds * 1_000_000)
    n = lambda c: (F.coalesce("before", F.lit(0)) - F.coalesce(c, F.lit(0))).cast("long")
    return r.select("id", n("day").alias("n_24h"), n("week").alias("n_7d"))


FILLERS = ["please", "today", "soon", "kindly", "again", "friend", "madam", "now then", "ok", "thanks", "quickly", "sir"]


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with one of a dozen endings, so that templates have near-duplicates."""
    return src.messages(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" "), src.pick(FILLERS, F.col("user_id"))))


def message_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ops.fingerprints(_worded(spark, sf_dir), "msg_id", "text")
    return f.select("msg_id", "template_hash", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("simhash"), "token_count")


def near_template_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ops.near_templates(ops.fingerprints(_worded(spark, sf_dir), "msg_id", "text"))
    return p.select("a_hash", "b_hash", F.col("distance").cast("long").alias("distance"))


def campaign_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events match the first report of each template for which reasons."""
    r = src.reports(spark, sf_dir)
    prints = ops.fingerprints(_worded(spark, sf_dir), "msg_id", "text").withColumnRenamed("msg_id", "id")
    rows = r.join(prints, "id").select("id", "template", "created_at", "template_hash", "simhash", "token_count", F.when(F.col("host").isNotNull(), F.array("host")).otherwise(F.array().cast("array<string>")).alias("hosts"), "sender_key")
    # Each reason reads the rows again; prints are costly.
    rows = written(rows, "prints")
    first = rows.groupBy("template").agg(F.min("id").alias("id"))
    hits = ops.match_reasons(rows.join(first, ["template", "id"]), rows)
    return hits.select("cand_id", F.explode("reasons").alias("reason")).groupBy("cand_id", "reason").agg(F.count("*").alias("events"))


def _wave_sql(key: str, where: str = "true") -> str:
    w = "CASE origin WHEN 'user_report' THEN 1.0::DOUBLE WHEN 'auto_high_confidence' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
    r2 = lambda x: f"floor(({x}) * 100 + 0.5) / 100.0::DOUBLE"
    return f"""WITH {src.REPORTS_SQL}, m AS (SELECT *, {w} AS w, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 1e6::DOUBLE AS age FROM reports WHERE {where}),
 f AS (SELECT *, age >= 0 AND age <= 604800 AS seen, age >= 0 AND age <= 86400 AS burst, age > 86400 AND age <= 86400 + 14 * 86400 AS base FROM m),
 g AS (SELECT {key}, count(*) FILTER (WHERE seen) AS matched_events, count(DISTINCT reporter) FILTER (WHERE seen) AS distinct_reporters, count(*) FILTER (WHERE seen AND origin = 'user_report') AS human_reports, count(DISTINCT reporter) FILTER (WHERE burst) AS distinct_reporters_24h,
  coalesce(sum(w) FILTER (WHERE burst), 0) AS bw, greatest(0.5::DOUBLE, coalesce(sum(w) FILTER (WHERE base), 0) / 14) AS pd, coalesce(sum(w * pow(0.5::DOUBLE, age / 604800)) FILTER (WHERE seen), 0) AS dec, min(created_at) FILTER (WHERE seen) AS first_seen, max(created_at) FILTER (WHERE seen) AS last_seen FROM f GROUP BY {key}),
 t AS (SELECT {key}, matched_events, distinct_reporters, human_reports, distinct_reporters_24h, {r2('bw')} AS weight_24h, {r2('pd')} AS baseline_per_day, {r2('bw / pd')} AS burst_ratio, {r2('dec')} AS decayed_weight, first_seen, last_seen FROM g)
 SELECT *, CASE WHEN distinct_reporters >= 3 AND human_reports >= 1 AND decayed_weight >= 2 THEN CASE WHEN distinct_reporters_24h >= 5 AND burst_ratio >= 3 THEN 'wave' ELSE 'cluster' END END AS tier FROM t"""


_STEPS = [
    (r"\[(?:phone|email|account)[^\]]*\](?:@[^\s]+)?", " ph "),
    (r"(?:https?://)?(?:www\.)?((?:[a-z0-9-]+\.)+[a-z]{2,10})(?:/[^\s]*)?", r" \1 "),
    (r"[0-9]+(?:[.,\s][0-9]+)*", " # "),
    (r"[^\p{L}\p{N}#.\s-]", " "),
    (r"(^|[^\p{L}])[.-]+", r"\1 "),
    (r"[.-]+([^\p{L}]|$)", r" \1"),
    (r"\s+", " "),
]


def template_sql(text: str) -> str:
    """What stays of a lower-case message when its particulars go, before trimming."""
    for pattern, to in _STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


_TEMPLATE = template_sql("lower(text)")
_PRINTS = f"""{src.MESSAGES_SQL}, worded AS (SELECT msg_id, text || ' ' || {src.sql_pick(FILLERS, 'user_id')} AS text FROM messages), tp AS (SELECT msg_id, trim({_TEMPLATE}) AS tpl FROM worded), d AS (SELECT DISTINCT tpl FROM tp),
 tok AS (SELECT tpl, ('0x' || substr(sha1(w), 1, 16))::UBIGINT AS h FROM (SELECT tpl, unnest(string_split(tpl, ' ')) AS w FROM d) WHERE w <> ''),
 bits AS (SELECT tpl, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM tok, (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY tpl, b),
 sim AS (SELECT tpl, CAST(sum(CASE WHEN v > 0 THEN (1::UBIGINT << b)::HUGEINT ELSE 0 END) AS UBIGINT) AS sim FROM bits GROUP BY tpl),
 cnt AS (SELECT tpl, count(*) AS token_count FROM tok GROUP BY tpl),
 prints AS (SELECT msg_id, left(sha256(tpl), 16) AS template_hash, coalesce(sim, 0::UBIGINT) AS sim, coalesce(token_count, 0) AS token_count FROM tp LEFT JOIN sim USING (tpl) LEFT JOIN cnt USING (tpl))"""

QUERIES = {
    "wave_metrics": wave_metrics,
    "wave_by_sender": wave_by_sender,
    "trailing_counts": trailing_counts,
    "message_fingerprints": message_fingerprints,
    "near_template_pairs": near_template_pairs,
    "campaign_reasons": campaign_reasons,
}
ORACLE = {
    "wave_metrics": _wave_sql("template"),
    "wave_by_sender": _wave_sql("sender_key", "sender_key IS NOT NULL"),
    "trailing_counts": f"WITH {src.REPORTS_SQL} SELECT id, count(*) OVER (PARTITION BY template ORDER BY epoch_us(created_at) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS n_24h, count(*) OVER (PARTITION BY template ORDER BY epoch_us(created_at) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS n_7d FROM reports",
    "message_fingerprints": f"WITH {_PRINTS} SELECT msg_id, template_hash, lpad(lower(to_hex(sim)), 16, '0') AS simhash, token_count FROM prints",
    "near_template_pairs": f"WITH {_PRINTS}, one AS (SELECT template_hash, any_value(sim) AS sim FROM prints WHERE token_count >= 8 GROUP BY 1) SELECT a.template_hash AS a_hash, b.template_hash AS b_hash, CAST(bit_count(xor(a.sim, b.sim)::BIT) AS BIGINT) AS distance FROM one a JOIN one b ON a.template_hash < b.template_hash AND bit_count(xor(a.sim, b.sim)::BIT) <= 6",
    "campaign_reasons": f"""WITH {_PRINTS}, {src.REPORTS_SQL}, x AS (SELECT r.id, r.template, r.host, r.sender_key, p.template_hash, p.sim, p.token_count FROM reports r JOIN prints p ON p.msg_id = r.id),
 c AS (SELECT * FROM x WHERE id IN (SELECT min(id) FROM x GROUP BY template)),
 hits AS (SELECT c.id AS cand_id, e.template_hash = c.template_hash AS t, c.template_hash <> e.template_hash AND c.token_count >= 8 AND e.token_count >= 8 AND bit_count(xor(c.sim, e.sim)::BIT) <= 6 AS n, coalesce(c.host = e.host, false) AS h, coalesce(c.sender_key = e.sender_key, false) AS s FROM c, x e)
 SELECT cand_id, 'template' AS reason, count(*) AS events FROM hits WHERE t GROUP BY 1 UNION ALL SELECT cand_id, 'near_duplicate', count(*) FROM hits WHERE n GROUP BY 1 UNION ALL SELECT cand_id, 'lookalike_host', count(*) FROM hits WHERE h GROUP BY 1 UNION ALL SELECT cand_id, 'sender', count(*) FROM hits WHERE s GROUP BY 1""",
}

"""Organisation intelligence over orders as emails: customers send, suppliers and parts are indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import organisation as ops
from tracewell.sources.scratch import dealt

LABELS = ["confirmed_fraud", "legitimate", "suspicious_unconfirmed", "false_positive", "confirmed_phishing", "insufficient_evidence"]
SINCE = "1998-06-01 00:00:00"
#: Rows of orders and their lines that one task groups.
ROWS_A_TASK = 100_000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt out by their order, so that groups of an order's lines need no further exchange and a task holds as many at any size."""
    return dealt(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"), ROWS_A_TASK, "l_orderkey")


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, c = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet"), ROWS_A_TASK, "o_orderkey"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select(k.alias("input_hash"), c.alias("sender"), (c % 50).alias("sender_domain"), (k % 97).alias("recipient"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") != "O").alias("flagged"))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("input_hash"), F.concat(F.when(F.col("l_linenumber") % 2 == 0, "link:").otherwise("template:"), F.col("l_suppkey").cast("string")).alias("indicator")).distinct()
    return li.join(emails(spark, sf_dir).hint("merge"), "input_hash")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir)
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("l_partkey") % len(LABELS) + 1).cast("int"))
    return li.select(F.col("l_orderkey").alias("input_hash"), (F.col("l_suppkey") % 7).alias("analyst"), label.alias("label"), F.col("l_shipdate").alias("created_at"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.consensus(ops.latest_outcomes(outcomes(spark, sf_dir)))


_E = "e AS (SELECT o_orderkey AS input_hash, o_custkey AS sender, o_custkey % 50 AS sender_domain, o_orderkey % 97 AS recipient, o_orderdate AS created_at, o_orderstatus <> 'O' AS flagged FROM orders)"
_I = f"{_E}, i AS (SELECT l.input_hash, indicator, sender, sender_domain, recipient, created_at, flagged FROM (SELECT DISTINCT l_orderkey AS input_hash, CASE WHEN l_linenumber % 2 = 0 THEN 'link:' ELSE 'template:' END || l_suppkey AS indicator FROM lineitem) l JOIN e USING (input_hash))"
_O = "oc AS (SELECT l_orderkey AS input_hash, l_suppkey % 7 AS analyst, [" + ", ".join(f"'{x}'" for x in LABELS) + f"][CAST(l_partkey % {len(LABELS)} AS INT) + 1] AS label, l_shipdate AS created_at FROM lineitem), lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY input_hash, analyst ORDER BY created_at DESC, label DESC) AS t FROM oc) WHERE t = 1), cl AS (SELECT input_hash, label, count(*) AS n, max(created_at) AS last FROM lo GROUP BY 1, 2), cons AS (SELECT input_hash, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY input_hash ORDER BY n DESC, last DESC, label) AS t, CAST(sum(n) OVER (PARTITION BY input_hash) AS BIGINT) AS votes FROM cl) WHERE t = 1)"
_BENIGN, _FRAUD = (", ".join(f"'{x}'" for x in xs) for xs in (ops.BENIGN, ops.FRAUD))

QUERIES = {
    "label_consensus": _labels,
    "latest_outcomes": lambda s, d: ops.latest_outcomes(outcomes(s, d)),
    "org_campaigns": lambda s, d: ops.campaigns(indicators(s, d), _labels(s, d), F.lit(SINCE).cast("timestamp_ntz")),
    "indicator_peers": lambda s, d: ops.indicator_peers(indicators(s, d)),
    "domain_reputation": lambda s, d: ops.domain_reputation(emails(s, d)),
    "confirmed_fraud": lambda s, d: ops.confirmed_fraud(emails(s, d), indicators(s, d), _labels(s, d)),
    "first_contact": lambda s, d: ops.first_contact(emails(s, d)),
    "orphan_outcomes_removed": lambda s, d: outcomes(s, d).join(emails(s, d).where("flagged").select("input_hash"), "input_hash", "left_semi").groupBy("label").agg(F.count("*").alias("n")),
    "retained_emails": lambda s, d: emails(s, d).where(F.col("created_at") >= F.lit("1998-02-01").cast("timestamp_ntz")).groupBy("sender_domain").agg(F.count("*").alias("n")),
}
ORACLE = {
    "label_consensus": f"WITH {_O} SELECT * FROM cons",
    "latest_outcomes": f"WITH {_O} SELECT input_hash, analyst, label, created_at FROM lo",
    "org_campaigns": f"""WITH {_I}, {_O}, g AS (SELECT indicator, count(DISTINCT input_hash) AS messages, count(DISTINCT sender) AS senders, count(DISTINCT recipient) AS recipients, min(created_at) AS first_seen, max(created_at) AS last_seen FROM i WHERE flagged AND created_at >= TIMESTAMP '{SINCE}' AND input_hash NOT IN (SELECT input_hash FROM cons WHERE label IN ({_BENIGN})) GROUP BY 1)
 SELECT *, 'OC-' || left(sha256(indicator), 12) AS campaign_id FROM g WHERE messages >= 3 AND (senders >= 2 OR recipients >= 2 OR split_part(indicator, ':', 1) IN ('account', 'payee', 'link'))""",
    "indicator_peers": f"WITH {_I}, p AS (SELECT DISTINCT input_hash, indicator FROM i), z AS (SELECT indicator, count(*) - 1 AS others FROM p GROUP BY 1) SELECT input_hash, CAST(sum(others) AS BIGINT) AS peer_links, count(*) FILTER (WHERE others > 0) AS shared_indicators FROM p JOIN z USING (indicator) GROUP BY 1",
    "domain_reputation": f"WITH {_E} SELECT sender_domain, count(*) AS emails, count(*) FILTER (WHERE flagged) AS flagged, count(DISTINCT recipient) AS recipients, min(created_at) AS first_seen, max(created_at) AS last_seen FROM e GROUP BY 1",
    "confirmed_fraud": f"""WITH {_I}, {_O}, fr AS (SELECT input_hash FROM cons WHERE label IN ({_FRAUD})),
 a AS (SELECT e.input_hash, sender, sender_domain, CASE WHEN fr.input_hash IS NULL THEN 0 ELSE 1 END AS f FROM e LEFT JOIN fr USING (input_hash)),
 b AS (SELECT *, sum(f) OVER (PARTITION BY sender) - f AS bs, sum(f) OVER (PARTITION BY sender_domain) - f AS bd FROM a),
 n AS (SELECT i.input_hash, sum(CASE WHEN fr.input_hash IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY indicator) - CASE WHEN fr.input_hash IS NULL THEN 0 ELSE 1 END AS x FROM i LEFT JOIN fr USING (input_hash)),
 m AS (SELECT input_hash, max(x) AS bi FROM n GROUP BY 1)
 SELECT input_hash, CASE WHEN bs > 0 THEN 'sender' WHEN coalesce(bi, 0) > 0 THEN 'indicator' WHEN bd > 0 THEN 'domain' END AS basis, CAST(CASE WHEN bs > 0 THEN bs WHEN coalesce(bi, 0) > 0 THEN bi ELSE bd END AS BIGINT) AS n FROM b LEFT JOIN m USING (input_hash) WHERE bs > 0 OR coalesce(bi, 0) > 0 OR bd > 0""",
    "first_contact": f"WITH {_E} SELECT input_hash, created_at - INTERVAL 7 DAY <= min(created_at) OVER (PARTITION BY sender) AS first_contact, row_number() OVER (PARTITION BY sender ORDER BY created_at, input_hash) - 1 AS earlier FROM e",
    "orphan_outcomes_removed": f"WITH {_E}, {_O} SELECT label, count(*) AS n FROM oc WHERE input_hash IN (SELECT input_hash FROM e WHERE flagged) GROUP BY 1",
    "retained_emails": f"WITH {_E} SELECT sender_domain, count(*) AS n FROM e WHERE created_at >= TIMESTAMP '1998-02-01' GROUP BY 1",
}

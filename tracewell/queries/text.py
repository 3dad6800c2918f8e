"""Text functions, redaction, language mix and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.operators import redaction, similarity
from tracewell.operators.links import slug
from tracewell.sources import messages as src


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def input_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.input_hash(F.col("text")).alias("input_hash"), F.length(tx.folded(F.col("text"))).cast("long").alias("folded_length"))


def sender_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, masks and slugs of made-up senders."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    sender = F.when(k % 3 == 0, F.concat(F.lit("+230 5"), F.lpad(k.cast("string"), 7, "0"))).when(k % 3 == 1, F.concat(F.lit("  Bank   OF "), "c_mktsegment")).otherwise(F.concat(F.lit("Shop "), k.cast("string")))
    return c.select("c_custkey", tx.sender_key(sender).alias("sender_key"), tx.masked(sender).alias("masked"), slug(F.concat_ws(" é ", "c_mktsegment", "c_name")).alias("slug"))


def account_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits of account numbers made from orders, every third one right."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    body = F.lpad(F.col("o_orderkey").cast("string"), 14, "0")
    rest = F.aggregate(F.filter(F.split(F.concat(body, F.lit("221100")), ""), lambda c: c != ""), F.lit(0), lambda r, c: (r * 10 + c.cast("int")) % 97)
    check = F.lpad(F.when(F.col("o_orderkey") % 3 == 0, 98 - rest).otherwise(F.lit(13)).cast("string"), 2, "0")
    return o.select("o_orderkey", tx.iban_ok(F.concat(F.lit("MB"), check, body)).alias("ok"))


def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("msg_id"), "text")
    return redaction.placeholders(d).groupBy("kind").agg(F.count("*").alias("identifiers"), F.countDistinct("msg_id").alias("documents"), F.max("number").alias("most"))


def redacted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = src.messages(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" mail u"), F.col("user_id").cast("string"), F.lit("@mail.example.com or +230 5"), F.lpad(F.col("msg_id").cast("string"), 7, "0"), F.lit(" ref "), F.lpad(F.col("msg_id").cast("string"), 12, "9")))
    return redaction.redact(m)


def redacted_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of every document with their placeholders, and whether putting them back gives the text."""
    d = redaction.redact_all(_docs(spark, sf_dir).select("doc_id", "text"))
    back = redaction.restored(F.col("redacted"), F.col("redactions")) == F.coalesce("text", F.lit(""))
    return d.select("doc_id", F.length("redacted").cast("long").alias("redacted_length"), back.alias("restores"), F.size("redactions").cast("long").alias("n"), F.array_join(F.transform("redactions", lambda r: r["placeholder"]), ",").alias("placeholders"))


def language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.language_mix(src.messages(spark, sf_dir))


def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tx.cut(F.col("text"), 5000)
    return _docs(spark, sf_dir).select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c.cast("binary")).alias("h"))


def retrieved_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three benchmark items most like each turn of each conversation."""
    q = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return similarity.retrieve(q, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("row_id"), "text"))


def region_chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like a nation's and its region's names are."""
    n, r = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    return similarity.chrf(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("hypothesis"), F.col("r_name").alias("reference")))


def nearest_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.nearest_centroids(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_FOLD = "trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'))"
_SENDER = "CASE WHEN c_custkey % 3 = 0 THEN '+230 5' || lpad(c_custkey::VARCHAR, 7, '0') WHEN c_custkey % 3 = 1 THEN '  Bank   OF ' || c_mktsegment ELSE 'Shop ' || c_custkey END"
_MARKED = "lower(text)"


def _mix_sql() -> str:
    def score(words: list[str]) -> str:
        one = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
        return " + ".join(f"len(list_filter(w, lambda x: list_contains({one(ws)}, x))) * {k}::DOUBLE" for ws, k in (([w for w in words if len(w) > 2], 1.0), ([w for w in words if len(w) <= 2], 0.5)) if ws)

    cols = ", ".join(f"{score(v)} AS {k}" for k, v in redaction.MARKERS.items())
    return f"""WITH {src.MESSAGES_SQL}, a AS (SELECT msg_id, regexp_extract_all(lower(text), '[a-zà-ÿ'']+') AS w FROM messages), s AS (SELECT msg_id, {cols} FROM a), t AS (SELECT *, greatest(en, fr, mfe) AS top FROM s)
 SELECT msg_id, CASE WHEN mfe = top AND top > 0 THEN 'mfe' WHEN fr = top AND top > 0 THEN 'fr' ELSE 'en' END AS primary_lang, top AS score, CAST(en >= 1.5 AS INT) + CAST(fr >= 1.5 AS INT) + CAST(mfe >= 1.5 AS INT) > 1 AS mixed FROM t"""


_REDACT = "text || ' mail u' || user_id || '@mail.example.com or +230 5' || lpad(msg_id::VARCHAR, 7, '0') || ' ref ' || lpad(msg_id::VARCHAR, 12, '9')"
for _re, _to in ((redaction.EMAIL, "[email]"), (redaction.PHONE, "[phone]"), (r"\b[0-9]{5,}([0-9]{4})\b", r"[account ending \1]")):
    _REDACT = f"regexp_replace({_REDACT}, '{_re}', '{_to}', 'g')"
_T = "(SELECT doc_id AS msg_id, text AS t0, regexp_replace(text, '{e}', ' ', 'g') AS t1, regexp_replace(regexp_replace(text, '{e}', ' ', 'g'), '{p}', ' ', 'g') AS t2 FROM documents)".format(e=redaction.EMAIL, p=redaction.PHONE)
_CUT = """CASE WHEN length(text) <= 5000 THEN text WHEN instr(head, chr(10)) > 0 AND 5000 - instr(reverse(head), chr(10)) >= 4000 THEN rtrim(left(head, 5000 - instr(reverse(head), chr(10))))
 WHEN instr(head, ' ') > 0 AND 5000 - instr(reverse(head), ' ') >= 4000 THEN rtrim(left(head, 5000 - instr(reverse(head), ' '))) ELSE head END"""
_NEG, _FUN = (", ".join(f"'{w}'" for w in ws) for ws in (similarity.NEGATIONS, similarity.FUNCTION_WORDS))
_WEIGHT = f"CASE WHEN t IN ({_NEG}) THEN 2.0::DOUBLE WHEN t IN ({_FUN}) THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END"
_RETRIEVE = f"""WITH q0 AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w FROM conversations), c0 AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w FROM benchmark),
 q AS (SELECT DISTINCT id, t FROM (SELECT id, unnest(w) AS t FROM q0 UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) FROM q0)),
 c AS (SELECT DISTINCT id, t FROM (SELECT id, unnest(w) AS t FROM c0 UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) FROM c0)),
 qs AS (SELECT id, sum(CASE WHEN NOT contains(t, '_') THEN {_WEIGHT} ELSE 0 END) AS a, count(*) FILTER (WHERE contains(t, '_')) AS p FROM q GROUP BY 1), cs AS (SELECT id, sum(CASE WHEN NOT contains(t, '_') THEN {_WEIGHT} ELSE 0 END) AS a, count(*) FILTER (WHERE contains(t, '_')) AS p FROM c GROUP BY 1),
 h AS (SELECT q.id AS query_id, c.id AS row_id, sum(CASE WHEN NOT contains(t, '_') THEN {_WEIGHT} ELSE 0 END) AS w, count(*) FILTER (WHERE contains(t, '_')) AS p, count(*) FILTER (WHERE NOT contains(t, '_') AND t NOT IN ({_NEG}) AND t NOT IN ({_FUN})) AS shared FROM q JOIN c USING (t) GROUP BY 1, 2),
 r AS (SELECT query_id, row_id, shared, round(0.7 * w / (qs.a + cs.a - w) + 0.3 * CASE WHEN qs.p > 0 AND cs.p > 0 THEN h.p / (qs.p + cs.p - h.p) ELSE 0 END, 9) AS score FROM h JOIN qs ON qs.id = query_id JOIN cs ON cs.id = row_id WHERE shared >= 2)
 SELECT query_id, row_id, score, shared FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS t FROM r) WHERE t <= 3"""
_CHRF = """WITH p AS (SELECT n_nationkey AS id, regexp_replace(n_name, '\\s', '', 'g') AS h, regexp_replace(r_name, '\\s', '', 'g') AS r FROM nation JOIN region ON n_regionkey = r_regionkey), k AS (SELECT unnest(range(1, 7)) AS n),
 hg AS (SELECT id, n, g, count(*) AS c FROM (SELECT id, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: substr(h, i, n))) AS g FROM p, k) GROUP BY 1, 2, 3), rg AS (SELECT id, n, g, count(*) AS c FROM (SELECT id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: substr(r, i, n))) AS g FROM p, k) GROUP BY 1, 2, 3),
 b AS (SELECT id, n, sum(least(coalesce(hg.c, 0), coalesce(rg.c, 0))) AS m, sum(hg.c) AS h, sum(rg.c) AS r FROM hg FULL JOIN rg USING (id, n, g) GROUP BY 1, 2), f AS (SELECT id, avg(CASE WHEN h > 0 THEN m / h END) AS p, avg(CASE WHEN r > 0 THEN m / r END) AS r FROM b GROUP BY 1)
 SELECT id, round(coalesce(CASE WHEN 4 * p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END, 0), 2) AS chrf FROM f"""
_CENTROIDS = """WITH d AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label AS nearest, i, avg(v) AS m FROM d GROUP BY 1, 2),
 c AS (SELECT vec_id, label, nearest, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 6) AS cosine FROM d JOIN m USING (i) GROUP BY 1, 2, 3)
 SELECT vec_id, label, nearest, cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, nearest) AS t FROM c) WHERE t = 1"""
QUERIES = {f.__name__: f for f in (redacted_identifiers, input_hashes, sender_keys, account_checks, redaction_counts, redacted_messages, language_mix, cut_texts, retrieved_examples, region_chrf, nearest_centroids)}
ORACLE = {
    "input_hashes": f"SELECT doc_id, sha256(text) AS input_hash, length({_FOLD}) AS folded_length FROM documents",
    "sender_keys": f"""WITH s AS (SELECT *, {_SENDER} AS s FROM customer), g AS (SELECT *, regexp_replace(s, '[^0-9]', '', 'g') AS dg FROM s)
 SELECT c_custkey, CASE WHEN dg = '' THEN nullif(trim(regexp_replace(lower(s), '\\s+', ' ', 'g')), '') WHEN length(dg) <= 8 AND NOT starts_with(dg, '230') THEN '230' || dg ELSE dg END AS sender_key, CASE WHEN length(dg) >= 6 THEN '•••• ' || right(dg, 4) ELSE s END AS masked,
 trim(regexp_replace(strip_accents(lower(c_mktsegment || ' é ' || c_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM g""",
    "account_checks": "WITH b AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 14, '0') AS body FROM orders), c AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 98 - (body || '221100')::HUGEINT % 97 ELSE 13 END AS chk FROM b) SELECT o_orderkey, (body || '2211' || lpad(chk::VARCHAR, 2, '0'))::HUGEINT % 97 = 1 AS ok FROM c",
    "redaction_counts": f"""WITH t AS {_T}, f AS (SELECT msg_id, 'email' AS kind, unnest(list_distinct(regexp_extract_all(t0, '{redaction.EMAIL}'))) AS x FROM t UNION ALL SELECT msg_id, 'phone', unnest(list_distinct(regexp_extract_all(t1, '{redaction.PHONE}'))) FROM t UNION ALL SELECT msg_id, 'account', unnest(list_distinct(regexp_extract_all(t2, '{redaction.ACCOUNT}'))) FROM t)
 SELECT kind, CAST(sum(n) AS BIGINT) AS identifiers, count(*) AS documents, max(n) AS most FROM (SELECT kind, msg_id, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1""",
    "redacted_messages": f"WITH {src.MESSAGES_SQL} SELECT msg_id, {_REDACT} AS redacted FROM messages",
    "language_mix": _mix_sql(),
    "cut_texts": f"WITH h AS (SELECT doc_id, text, left(text, 5000) AS head FROM documents), c AS (SELECT doc_id, {_CUT} AS c FROM h) SELECT doc_id, length(c) AS n, md5(c) AS h FROM c",
    "retrieved_examples": _RETRIEVE,
    "region_chrf": _CHRF,
    "nearest_centroids": _CENTROIDS,
}

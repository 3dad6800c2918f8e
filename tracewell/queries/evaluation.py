"""Detector evaluation over labelled documents, and dataset statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import evaluation as ops


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.join(d, "doc_id").select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 0).alias("actual"), (F.col("n_chars") < 600).alias("predicted"))


def detector_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.confusion(_rows(spark, sf_dir), ["lang", "source"])


def run_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ops.consistency(e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("verdict")))


def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distribution(spark.read.parquet(f"{sf_dir}/documents.parquet"), "n_chars", ["lang"])


def duplicate_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return ops.duplicate_rows(d, "h", "doc_id").select("doc_id", "copy", "first_row")


def activity_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ops.streaks(e.select("user_id", F.to_date(F.col("ts") + F.expr("INTERVAL 4 HOURS")).alias("day")), "user_id")


def interleaved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.round_robin(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "source", ["doc_id"])


def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and by source, in one pass."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql("SELECT lang, source, count(*) AS documents, sum(n_chars) AS chars FROM {d} GROUP BY GROUPING SETS ((lang), (source))", d=d)


def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-cased letter runs per language that occur five times or more."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = d.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{4,}"), F.lit(0))).alias("token"))
    return t.groupBy("lang", "token").agg(F.count("*").alias("n")).where("n >= 5")


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised benchmark lines that also stand in documents, with the number of documents."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.explode(F.split("text", "\n")).alias("line")).select("item_id", norm("line").alias("line")).where("length(line) >= 30").distinct()
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", norm("line").alias("line")).where("length(line) >= 30").distinct()
    return b.join(d, "line").groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("line").alias("lines"))


_R = "r AS (SELECT doc_id, lang, source, quality = 0 AS actual, n_chars < 600 AS predicted FROM labels JOIN documents USING (doc_id))"
_RATE = "CASE WHEN ({1}) > 0 THEN floor(({0}) * 10000.0 / ({1}) + 0.5) / 10000.0::DOUBLE END"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
QUERIES = {f.__name__: f for f in (detector_confusion, run_consistency, length_distribution, duplicate_numbering, activity_streaks, interleaved_documents, dataset_counts, token_frequency, benchmark_leaks)}
ORACLE = {
    "detector_confusion": f"""WITH {_R}, c AS (SELECT lang, source, count(*) FILTER (WHERE actual AND predicted) AS tp, count(*) FILTER (WHERE NOT actual AND predicted) AS fp, count(*) FILTER (WHERE NOT actual AND NOT predicted) AS tn, count(*) FILTER (WHERE actual AND NOT predicted) AS fn FROM r GROUP BY GROUPING SETS ((), (lang), (source)))
 SELECT *, {_RATE.format('tp', 'tp + fp')} AS precision, {_RATE.format('tp', 'tp + fn')} AS recall, {_RATE.format('fp', 'fp + tn')} AS false_positive_rate, {_RATE.format('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c""",
    "run_consistency": f"WITH n AS (SELECT user_id AS case_id, event_type AS verdict, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, verdict) AS t, CAST(sum(n) OVER (PARTITION BY case_id) AS BIGINT) AS runs, count(*) OVER (PARTITION BY case_id) AS verdicts FROM n) SELECT case_id, runs, verdicts, verdict AS modal, {_RATE.format('n', 'runs')} AS share FROM t WHERE t = 1",
    "length_distribution": "WITH r AS (SELECT lang, n_chars::DOUBLE AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL) SELECT lang, min(v) AS least, max(v) AS most, avg(v) AS mean, median(v) AS median, max(v) FILTER (WHERE k = floor(0.95 * (n - 1))) AS p95 FROM r GROUP BY lang",
    "duplicate_numbering": "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy, first(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS first_row FROM documents",
    "activity_streaks": "WITH d AS (SELECT DISTINCT user_id, CAST(ts + INTERVAL 4 HOUR AS DATE) AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM d), r AS (SELECT user_id, island, count(*) AS days, max(day) AS last_day FROM i GROUP BY 1, 2) SELECT user_id, days, last_day FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY days DESC, last_day DESC) AS t FROM r) WHERE t = 1",
    "interleaved_documents": "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents",
    "dataset_counts": "SELECT lang, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source))",
    "token_frequency": "SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents) GROUP BY 1, 2 HAVING count(*) >= 5",
    "benchmark_leaks": f"WITH b AS (SELECT DISTINCT item_id, {_NORM.format('line')} AS line FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark)), d AS (SELECT DISTINCT doc_id, {_NORM.format('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) SELECT item_id, count(DISTINCT doc_id) AS documents, count(DISTINCT line) AS lines FROM b JOIN d USING (line) WHERE len(line) >= 30 GROUP BY 1",
}

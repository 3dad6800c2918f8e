"""Retrieval by weighted token overlap, n-gram scores and vector similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the retrieval score.
UNIGRAM_SHARE = 0.7
BIGRAM_SHARE = 0.3
NEGATIONS = ["not", "no", "never", "pa", "pas", "ne", "jamais", "zame"]
FUNCTION_WORDS = ["the", "of", "to", "and", "in", "is", "it", "for", "on", "le", "la", "de", "les", "et", "un", "en", "ou", "pou", "dan"]
NEGATION_WEIGHT = 2.0
FUNCTION_WEIGHT = 0.25
# End of the fixed values.


def _weight(token: str = "t"):
    return F.when(F.col(token).isin(NEGATIONS), NEGATION_WEIGHT).when(F.col(token).isin(FUNCTION_WORDS), FUNCTION_WEIGHT).otherwise(1.0)


def _grams(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and t: distinct tokens and bigrams (joined by _) of each row."""
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.get("w", i), F.lit("_"), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    return rows.select(key, w.alias("w")).select(key, F.explode(F.array_distinct(F.concat("w", pairs))).alias("t"))


def retrieve(queries: DataFrame, corpus: DataFrame, k: int = 3, min_shared: int = 2) -> DataFrame:
    """The k corpus rows most like each query: query_id, row_id, score, shared.

    0.7 weighted Jaccard of tokens plus 0.3 Jaccard of bigrams, for pairs that
    share ``min_shared`` content words. Tokens are joined by equality and
    summed, so only pairs with something in common are made; function words
    join nothing but count in the sums.
    """
    q, c = _grams(queries, "query_id", "text"), _grams(corpus, "row_id", "text")
    kinds = lambda d, key: d.groupBy(key).agg(F.sum(F.when(~F.contains("t", F.lit("_")), _weight())).alias("w_all"), F.count_if(F.contains("t", F.lit("_"))).alias("n_pairs"))
    qs, cs = kinds(q, "query_id").toDF("query_id", "q_all", "q_pairs"), kinds(c, "row_id").toDF("row_id", "c_all", "c_pairs")
    content = lambda d: d.where(~F.col("t").isin(FUNCTION_WORDS))
    pair = F.contains("t", F.lit("_"))
    hit = content(q).join(content(c), "t").groupBy("query_id", "row_id").agg(F.coalesce(F.sum(F.when(~pair, _weight())), F.lit(0.0)).alias("w"), F.count_if(pair).alias("p"), F.count_if(~pair & ~F.col("t").isin(NEGATIONS)).alias("shared")).where(F.col("shared") >= min_shared)
    # Function words of the pairs that are left.
    fn = q.where(F.col("t").isin(FUNCTION_WORDS)).join(hit.select("query_id", "row_id"), "query_id").join(c.where(F.col("t").isin(FUNCTION_WORDS)), ["row_id", "t"]).groupBy("query_id", "row_id").agg((F.count("*") * FUNCTION_WEIGHT).alias("fw"))
    t = hit.join(fn, ["query_id", "row_id"], "left").join(qs, "query_id").join(cs, "row_id")
    inter = F.col("w") + F.coalesce("fw", F.lit(0.0))
    both = F.col("q_pairs") + F.col("c_pairs") - F.col("p")
    score = UNIGRAM_SHARE * inter / (F.col("q_all") + F.col("c_all") - inter) + BIGRAM_SHARE * F.when((F.col("q_pairs") > 0) & (F.col("c_pairs") > 0), F.col("p") / both).otherwise(0.0)
    t = t.select("query_id", "row_id", F.round(score, 9).alias("score"), "shared")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return t.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= k).select("query_id", "row_id", "score", "shared")


def chrf(pairs: DataFrame, order: int = 6, beta: float = 2.0) -> DataFrame:
    """id and character n-gram F-score (n = 1..6, blanks removed) of ``hypothesis`` against ``reference``, two decimals, 0..100.

    n-grams are exploded and counted per pair; matches are the smaller counts.
    """
    def side(col: str) -> DataFrame:
        t = F.regexp_replace(col, r"\s", "")
        grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(order)), lambda n: F.when(F.length("t") >= n, F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda i: F.struct(n.alias("n"), F.substring(F.col("t"), i, n).alias("g")))).otherwise(F.array().cast("array<struct<n:int,g:string>>"))))
        return pairs.select("id", t.alias("t")).select("id", F.explode(grams).alias("x")).groupBy("id", "x.n", "x.g").agg(F.count("*").alias(f"c_{col[:3]}"))

    both = side("hypothesis").join(side("reference"), ["id", "n", "g"], "full")
    by_n = both.groupBy("id", "n").agg(F.sum(F.least(F.coalesce("c_hyp", F.lit(0)), F.coalesce("c_ref", F.lit(0)))).alias("m"), F.sum("c_hyp").alias("h"), F.sum("c_ref").alias("r"))
    p, r = F.avg(F.when(F.col("h") > 0, F.col("m") / F.col("h"))), F.avg(F.when(F.col("r") > 0, F.col("m") / F.col("r")))
    t = by_n.groupBy("id").agg(p.alias("p"), r.alias("r"))
    b2 = beta * beta
    f = F.when(b2 * F.col("p") + F.col("r") > 0, 100 * (1 + b2) * F.col("p") * F.col("r") / (b2 * F.col("p") + F.col("r"))).otherwise(0.0)
    return t.select("id", F.round(F.coalesce(f, F.lit(0.0)), 2).alias("chrf"))


def nearest_centroids(vectors: DataFrame) -> DataFrame:
    """Per vector the label whose mean vector has the largest cosine: vec_id, label, nearest, cosine.

    Means are one row a label; their number is checked.
    """
    dims = vectors.select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    if means.count() > 10_000:
        raise ValueError("too many labels to compare with each vector")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda a: F.sqrt(dot(a, a))
    # One value, all means, that each vector folds over: no pairs, no regrouping.
    every = means.agg(F.collect_list(F.struct(F.col("label").alias("nearest"), "mean", size(F.col("mean")).alias("size")))).scalar()
    v = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    v = v.select("vec_id", "label", "e", size(F.col("e")).alias("length"), every.alias("every"))
    rows = F.transform("every", lambda m: F.struct((-F.round(dot(F.col("e"), m["mean"]) / (F.col("length") * m["size"]), 6)).alias("c"), m["nearest"].alias("nearest")))
    return v.select("vec_id", "label", F.array_min(rows).alias("x")).select("vec_id", "label", "x.nearest", (-F.col("x.c")).alias("cosine"))


__all__ = ["retrieve", "chrf", "nearest_centroids"]

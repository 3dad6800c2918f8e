"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import n_words, table, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3.0


def uniform(key: Column, seed: str = "") -> Column:
    """A number strictly between 0 and 1 that depends on the key alone: 52 bits of its MD5."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES) -> DataFrame:
    """Adds ``weight`` and ``target`` to a table of ``source``, ``source_size``.

    The total size is shared by weight; a target stops at ``max_copies`` times
    its source's size and the excess goes to the others by weight. The fixed
    point is min(cap, level * weight): in ascending order of cap / weight, the
    capped sources are a prefix, so running sums find the level. The windows
    run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = sources.withColumn("turn", (F.row_number().over(by_name) - 1) % len(weights))
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1))
    t = t.withColumn("cap", F.col("source_size") * F.lit(max_copies)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", (F.sum("source_size").over(everything) - F.col("cap_before")) / (F.sum("weight").over(everything) - F.col("weight_before")))
    # The level that the first uncapped source sees holds for all after it.
    t = t.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)["level"])
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))))
    return t.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def size_class(size: Column) -> Column:
    """Number of a size's binary digits less one; 0 for sizes 0 and 1."""
    return F.length(F.bin(F.greatest(size, F.lit(1)))) - 1


def inclusion(classes: DataFrame) -> DataFrame:
    """Adds ``part``, the inclusion probability of the sampled copy, to a table of source, class, class_size, source_size, target.

    Of a source's fraction f beyond whole copies the words f * source_size are
    shared among its size classes by class_size times an odds weight that
    doubles every second class, so longer documents are likelier; a class
    stops at probability 1 and the excess goes to the others. As in targets(),
    the full classes are a prefix, here from the longest documents down, so
    running sums find the level. The windows run over the classes of one
    source, 64 at most.
    """
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    all_ = Window.partitionBy("source")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    c = classes.withColumn("share", share).withColumn("whole", F.floor("share")).withColumn("wanted", (F.col("share") - F.col("whole")) * F.col("source_size"))
    c = c.withColumn("odds", F.pow(F.lit(2.0), F.floor(F.col("class") / 2)))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    heavy = F.col("odds") * F.col("class_size")
    c = c.withColumn("level", F.try_divide(F.col("wanted") - F.coalesce(F.sum("class_size").over(before), F.lit(0)), F.sum(heavy).over(all_) - F.coalesce(F.sum(heavy).over(before), F.lit(0.0))))
    # The level that the longest class short of probability 1 sees holds for all after it.
    c = c.withColumn("final", F.max(F.when(F.col("odds") * F.col("level") < 1, F.struct("class", "level"))).over(all_)["level"])
    part = F.when(F.col("wanted") <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("final") * F.col("odds"), F.lit(1.0)))))
    return c.select("source", "class", "source_size", "target", "whole", "wanted", part.alias("part"), "n_docs")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES, seed: str = "", keep: list[str] | None = None) -> DataFrame:
    """How many copies of each row of ``docs`` the mix takes.

    Returns id, source, ``size`` (words), ``source_size``, ``target`` and
    ``copies`` (long), and the columns ``keep`` as kept_<name>. Each row gets the whole copies of target / source_size
    for certain. The rest is a sample of fixed size in words with unequal
    probabilities, which inclusion() gives by size: a source's rows are ranked
    by their random odds u/(1-u) over their inclusion odds p/(1-p), and taken
    in that order while that brings the words nearer to the target; so a
    source misses its target by half a document at most.

    A histogram of the ranks finds the one bin in which each source's sample
    ends; only that bin is ordered, so no source's rows meet in one task.
    u comes from the id, so reruns agree; equal ids fall back on the text's
    hash, and for null ids u comes from that hash. A null source is a source
    of its own, a null text has size 0, equal rows are ranked alike and very
    long texts are counted whole. An empty table gives no rows.
    """
    tie = F.xxhash64(text_col)
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), tie.cast("string")))
    size = n_words(F.col(text_col))
    return _chosen(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), size_class(size).alias("class"), uniform(key, seed).alias("u"), tie.alias("tie"), *[F.col(c).alias(f"kept_{c}") for c in keep or []]), weights, max_copies).withColumnRenamed("id", id_col)


def _chosen(sized: DataFrame, weights: tuple[float, ...], max_copies: float) -> DataFrame:
    rows = written(sized, "mix-sizes")
    classes = written(rows.groupBy("source", "class").agg(F.sum("size").alias("class_size"), F.count("*").alias("n_docs")), "mix-sources")
    plan = targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size"), F.sum("n_docs").alias("n_docs")), weights, max_copies)
    plan = inclusion(plan.select(F.col("source").alias("of"), "source_size", "target").join(classes, F.col("of").eqNullSafe(F.col("source"))).drop("of"))
    # Bins by the square root of the largest class: as many bins as rows in one.
    plan = written(plan.withColumn("bins", F.greatest(F.lit(16), F.ceil(F.sqrt(F.max("n_docs").over(Window.partitionBy()))))), "mix-plan")
    odds = F.when(F.col("part") >= 1, F.lit(0.0)).otherwise((F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part"))))
    plan = plan.withColumnRenamed("source", "of").withColumnRenamed("class", "of_class").drop("n_docs")
    ranked = rows.join(plan, rows["source"].eqNullSafe(plan["of"]) & (rows["class"] == plan["of_class"])).drop("of", "of_class")
    ranked = ranked.withColumn("rank", F.when(F.col("part") > 0, odds))
    # rank / (1 + rank) lies between 0 and 1 and keeps the order.
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("bins")))
    sampled = ranked.where("rank is not null")
    running = Window.partitionBy("source").orderBy("bin")
    bins = sampled.groupBy("source", "bin", "wanted").agg(F.sum("size").alias("bin_size")).withColumn("upto", F.sum("bin_size").over(running))
    ends = written(bins.where("upto >= wanted").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before"))).alias("end")).select(F.col("source").alias("end_source"), F.col("end.bin").alias("end_bin"), F.col("end.before").alias("before")), "mix-ends")
    found = ranked.join(ends, ranked["source"].eqNullSafe(ends["end_source"]), "left").drop("end_source")
    kept = [c for c in rows.columns if c.startswith("kept_")]
    keep = ["id", "source", "size", "source_size", "target", "whole", *kept]
    clear = found.where("rank is null or end_bin is null or bin <> end_bin").select(*keep, F.when(F.col("rank").isNull(), 0).when(F.col("end_bin").isNull() | (F.col("bin") < F.col("end_bin")), 1).otherwise(0).alias("extra"))
    order = Window.partitionBy("source").orderBy("rank", F.col("id").asc_nulls_last(), "tie", "size")
    edge = found.where("rank is not null and bin = end_bin").withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.select(*keep, F.when(F.col("upto") - F.col("size") / 2 <= F.col("wanted"), 1).otherwise(0).alias("extra"))
    return clear.unionAll(edge).select("id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("long").alias("copies"), *kept)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as mix() says, the columns unchanged."""
    chosen = mix(docs, keep=docs.columns, **options).where("copies > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mix(table(spark, sf_dir, "documents"))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

"""Names inside texts as whole words, by a positional inverted index and no product of texts and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as t


def name_words(text: Column) -> Column:
    """Lower-case words of letters and digits without Latin marks, in order."""
    return F.filter(F.split(t.stripped(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def _index(texts: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of words that names have (text_id, pos, word), names as rows (name_id, i, word, size), and each name's rarest word."""
    words = names.select("name_id", name_words(F.col("name")).alias("w")).where(F.size("w") > 0)
    rows = words.select("name_id", F.size("w").alias("size"), F.posexplode("w").alias("i", "word"))
    known = rows.select("word").distinct()
    postings = texts.select("text_id", F.posexplode(name_words(F.col("text"))).alias("pos", "word")).join(known, "word", "left_semi")
    often = postings.groupBy("word").agg(F.count("*").alias("often"))
    # A word that no text has leaves its name out by the inner join of all its words.
    rare = rows.join(often, "word").groupBy("name_id", "size").agg(F.count("*").alias("found"), F.min_by(F.struct("i", "word"), F.struct("often", "i")).alias("r")).where("found = size")
    return postings, rows, rare.select("name_id", "size", "r.*")


def names_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Where names stand in texts, their words side by side: text_id, name_id, at (the number of the first word).

    ``texts`` has text_id and text, ``names`` name_id and name. Candidates
    start from the rarest word of each name and its postings; the other words
    are then looked up at their places, each by an equal key (text, place,
    word). So a frequent word is only ever looked up, and a name without a
    rare word costs the postings of its rarest one. Names without a word are
    nowhere; names may overlap and repeat.
    """
    postings, rows, rare = _index(texts, names)
    spots = postings.join(rare, "word").select("text_id", "name_id", "size", (F.col("pos") - F.col("i")).alias("at")).where("at >= 0")
    asked = spots.join(rows.select("name_id", "i", "word"), "name_id").select("text_id", "name_id", "size", "at", (F.col("at") + F.col("i")).alias("pos"), "word")
    met = asked.join(postings, ["text_id", "pos", "word"]).groupBy("text_id", "name_id", "size", "at").agg(F.count("*").alias("n"))
    return met.where("n = size").select("text_id", "name_id", "at")


def all_words_in(texts: DataFrame, names: DataFrame, least: int = 2) -> DataFrame:
    """Texts that have every word of a name, anywhere: text_id, name_id. Names of fewer than ``least`` different words match nothing."""
    postings, rows, rare = _index(texts, names)
    have = postings.select("text_id", "word").distinct()
    wanted = rows.select("name_id", "word").distinct()
    sizes = wanted.groupBy("name_id").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    spots = have.join(rare.select("name_id", "word").join(sizes, "name_id"), "word").select("text_id", "name_id", "size")
    asked = spots.join(wanted, "name_id")
    return asked.join(have, ["text_id", "word"]).groupBy("text_id", "name_id", "size").agg(F.count("*").alias("n")).where("n = size").select("text_id", "name_id")

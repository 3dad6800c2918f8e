"""A training corpus from raw documents: five stages, each a table that the next one reads.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame with the columns of documents, the last one token ids
besides. Stages read nothing but their predecessor's rows. In all of them null
texts count as empty (language ID lets them go), repeated rows are rows like
any other until near_dedup keeps one of each group, ties go by the least id,
texts are read whole, an empty table stays empty, and further columns, whatever
their names, are handed on unchanged; a column token_ids is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import langid, lattice, mixing, pii, similar, simhash
from tracewell.llm.common import table, written

#: A language is accepted at this calibrated probability.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter and doubtful ones go."""
    # Other names while the verdict's own columns stand beside them.
    keep = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(docs.columns) if c != "text"]
    found = langid.identify(docs, keep).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return found.select(*[F.col("text") if c == "text" else F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the one with the least id."""
    return simhash.least_of_each(docs, similar.near_copies(docs))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: some documents go, some repeat."""
    return mixing.mixed(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids as token_ids, little-endian 32-bit numbers."""
    import public_tokenizers

    return lattice.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("mix_sources", mix_sources),
    ("sentencepiece_ids", sentencepiece_ids),
]

#: SQL can't express a trained classifier, so there is none; tests compare near_dedup's rows with brute force, of the other stages only single facts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Readers with contracts: registries, corpora, tables with fixed headers, threat feeds, binary documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects as rows with their position ``ord``."""
    t = spark.read.schema(schema).json(path, multiLine=True)
    return t.withColumn("ord", F.monotonically_increasing_id())


def jsonl_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited JSON; blank and broken lines are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def csv_contract(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    r"""A CSV whose header must be exactly ``columns``; quotes may hold line ends, which are read as \n. ValueError otherwise."""
    got = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    names = [c.lstrip("﻿") for c in got.columns]
    if names != columns:
        raise ValueError(f"header is {names}, not {columns}")
    return got.toDF(*columns)


def threat_feed(spark: SparkSession, path: str) -> DataFrame:
    """host, path, note, source of a line-based feed: comments after # are notes, bare hosts and URLs both go, duplicates are dropped."""
    t = spark.read.text(path).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"))
    body = F.trim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    t = t.select("source", body.alias("body"), F.nullif(F.trim(F.regexp_extract("value", r"(?:^|\s)#\s*(.*)$", 1)), F.lit("")).alias("note")).where("body <> ''")
    full = F.when(F.rlike("body", F.lit("^https?://")), F.col("body")).otherwise(F.concat(F.lit("https://"), "body"))
    t = t.withColumn("full", full).withColumn("host", F.lower(F.try_parse_url("full", F.lit("HOST")))).where("host IS NOT NULL")
    bare = F.regexp_replace(F.coalesce(F.try_parse_url("full", F.lit("PATH")), F.lit("")), "/+$", "")
    return t.select(F.regexp_replace("host", r"^www\.", "").alias("host"), bare.alias("path"), "note", "source").dropDuplicates(["host", "path"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Binary documents with the kind that their first bytes show: pdf, png, jpeg, webp, zip or unknown; names don't matter."""
    t = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 12))
    kind = F.when(F.startswith(head, F.lit("255044462D")), "pdf").when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png").when(F.startswith(head, F.lit("FFD8FF")), "jpeg")
    kind = kind.when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "webp").when(F.startswith(head, F.lit("504B0304")), "zip").otherwise("unknown")
    return t.select("path", "length", kind.alias("kind"), F.sha2("content", 256).alias("sha256"), "content")


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """Rows as JSON lines or CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)

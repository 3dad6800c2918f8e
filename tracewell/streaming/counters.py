"""Streaming forms: daily counters, one observation per email, evaluation before recording."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETENTION = "90 days"


def daily_counters(events: DataFrame, keys: list[str], delay: str = "2 days") -> DataFrame:
    """Counts per day (UTC+4) and keys; late events count on their own day until the watermark passes it."""
    day = F.window("ts", "1 day", startTime="20 hours")
    return events.withWatermark("ts", delay).groupBy(day.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.to_date(F.col("w.start") + F.expr("INTERVAL 4 HOURS")).alias("day"), *keys, "n")


def observed_once(emails: DataFrame, keys: list[str], within: str = RETENTION) -> DataFrame:
    """Each key once within the retention; the state behind it is dropped by the watermark."""
    return emails.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def evaluate_then_record(store: str, evaluate: Callable[[DataFrame, DataFrame], DataFrame], sink: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch is evaluated against what was stored before it, then stored.

    So no event is evidence for itself. Both folders get one subfolder a
    batch; a batch that runs again overwrites its own, and reads only those of
    earlier batches.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = spark.createDataFrame([], batch.schema)
        if number:
            try:
                earlier = spark.read.schema(batch.schema).parquet(f"{store}/batch=*").where(F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("long") < number)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        evaluate(batch, earlier).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return run

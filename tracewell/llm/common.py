"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words; everything else belongs to a word.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by Spark's own reader, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    That is spark.checkpoint.dir. Where it is unset, as in tests on one
    machine, a temporary folder takes its place; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tracewell-')}")
            held = spark.sparkContext.getCheckpointDir()
        root = held
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing will read again, so that long jobs hold no more disk than they need."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers that are broadcast at most: some tens of megabytes.
BROADCAST_ROWS = 1 << 20


def small_side(df: DataFrame) -> DataFrame:
    """A written table of narrow rows as one side of a join: broadcast if its counted rows are few, else left to be shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Most bytes of rows that go to a Python worker at once, unless the session has its own setting.
BATCH_BYTES = "4m"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool, and the C heap, where numpy's arrays are, if the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose worker gives the memory of its batches back to the system when a task ends.

    Workers are kept for later tasks, so what they hold counts all the time.
    Batches are bounded by bytes besides rows, as texts may be long; Spark
    reads that setting when the plan runs, so it stays set.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY, None) is None:
        conf.set(_BATCH_KEY, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def trimmed(text: Column) -> Column:
    """The text without white space at its ends; null becomes empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))


def words(text: Column) -> Column:
    """Array of the words of a text: runs of anything but ASCII white space."""
    inner = trimmed(text)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    inner = trimmed(text)
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE_RUN))).cast("long")


def folded(n: str, zero: str, step: str, item: str, kind: str) -> str:
    """SQL for the list of ``item`` over i = 1..n, with a state ``s.k`` from ``zero`` by ``step``.

    The list grows in blocks of 256, so a long one isn't copied at each step.
    """
    empty, nest = f"CAST(array() AS array<{kind}>)", f"CAST(array() AS array<array<{kind}>>)"
    one = f"concat(s.cur, array({item}))"
    body = f"aggregate(sequence(1, {n}), named_struct('k', {zero}, 'cur', {empty}, 'done', {nest}), (s, i) -> named_struct('k', {step}, 'cur', IF(size(s.cur) >= 255, {empty}, {one}), 'done', IF(size(s.cur) >= 255, concat(s.done, array({one})), s.done)), s -> flatten(concat(s.done, array(s.cur))))"
    return f"IF({n} > 0, {body}, {empty})"

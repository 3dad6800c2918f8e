"""Exact deduplication: a minimal perfect hash over the distinct digests seen so far.

Digests fall into buckets by their first bits. A bucket holds segments, one
for each batch that brought new texts: a minimal perfect hash, and in its
slots the full digest, where the winner is and how many rows there were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import discard, mapped, small_side, table, written

#: Digests that a bucket is meant for, when an index is begun.
BUCKET = 1 << 16
#: Segments of a bucket that lookups go through; one more and they become one.
MAX_SEGMENTS = 8
#: Bits of a level for each digest that it gets.
GAMMA = 2.0
_LEVELS = 64
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _spots(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level puts digests, given as rows of four 64-bit words."""
    h = np.full(len(words), level + 1, np.uint64) * _ODD[0]
    for k in range(4):
        h = (h ^ words[:, k]) * _ODD[1]
        h ^= h >> np.uint64(29)
        h *= _ODD[2]
        h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Digests to 0..n-1, each level a bit set of the places that one digest alone takes."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.slot = np.cumsum(bits) - 1

    @classmethod
    def of(cls, words: np.ndarray) -> PerfectHash:
        """A hash of distinct digests; ValueError if some repeat."""
        sizes, levels, left = [], [np.zeros(0, bool)], words
        while len(left):
            if len(sizes) == _LEVELS:
                raise ValueError("digests must be distinct")
            sizes.append(int(GAMMA * len(left)) + 64)
            at = _spots(left, len(sizes) - 1, sizes[-1])
            levels.append(np.bincount(at, minlength=sizes[-1]) == 1)
            left = left[~levels[-1][at]]
        return cls(sizes, np.concatenate(levels))

    def find(self, words: np.ndarray) -> np.ndarray:
        """A slot for each digest, -1 if no level has one; a digest that isn't in the hash may get a slot all the same."""
        out, left, begin = np.full(len(words), -1), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = begin + _spots(words[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.slot[at[hit]]
            left, begin = left[~hit], begin + size
        return out


class Segment:
    """A perfect hash with its slots: ``keys`` (n, 4) 64-bit words, ``rows`` (n, 4): whether the winner has an id, that id, its row number, rows of this text."""

    def __init__(self, mph: PerfectHash, keys: np.ndarray, rows: np.ndarray) -> None:
        self.mph, self.keys, self.rows = mph, keys, rows

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray) -> Segment:
        mph = PerfectHash.of(keys)
        order = np.argsort(mph.find(keys))
        return cls(mph, keys[order], rows[order])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of digests, compared byte by byte; -1 for the others."""
        at = self.mph.find(keys)
        same = at >= 0
        same[same] = (self.keys[at[same]] == keys[same]).all(axis=1)
        return np.where(same, at, -1)

    def raise_to(self, at: np.ndarray, rows: np.ndarray) -> None:
        """Count ``rows`` at distinct slots, and let those that come later by id win."""
        old = self.rows[at]
        later = (rows[:, 0] > old[:, 0]) | ((rows[:, 0] == old[:, 0]) & ((rows[:, 1] > old[:, 1]) | ((rows[:, 1] == old[:, 1]) & (rows[:, 2] > old[:, 2]))))
        n = old[:, 3] + rows[:, 3]
        old[later] = rows[later]
        old[:, 3] = n
        self.rows[at] = old

    def to_bytes(self) -> bytes:
        head = np.array([len(self.keys), len(self.mph.sizes), *self.mph.sizes], "<i8")
        return b"".join([head.tobytes(), self.keys.astype("<u8").tobytes(), self.rows.astype("<i8").tobytes(), np.packbits(self.mph.bits).tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> Segment:
        n, levels = np.frombuffer(data, "<i8", 2)
        sizes = np.frombuffer(data, "<i8", levels, 16).tolist()
        at = 16 + 8 * levels
        keys = np.frombuffer(data, "<u8", 4 * n, at).reshape(-1, 4)
        rows = np.frombuffer(data, "<i8", 4 * n, at + 32 * n).reshape(-1, 4).copy()
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, at + 64 * n), count=sum(sizes)).astype(bool)
        return cls(PerfectHash(sizes, bits), keys, rows)


class Index(NamedTuple):
    """``rows`` (bucket, n_rows, blob), written; a bucket may have several segments."""

    rows: DataFrame
    buckets: int


#: What both passes read: a bucket's segments (kind 0), then digests (kind 1).
_STREAM = ["bucket", "salt", "kind", "digest", "known", "id", "row_no", "n", "blob"]


def _digests(column: pa.Array) -> np.ndarray:
    """Rows of four words of a column of 32-byte values without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """(bucket, salt) and rows, one stretch of equal bucket, salt and kind at a time."""
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield (int(keys[0, a]), int(keys[1, a])), batch.slice(a, b - a)


def _numbers(rows: pa.RecordBatch) -> np.ndarray:
    return np.stack([rows.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5, 6, 7)], axis=1)


_SEGMENTS = pa.schema([("bucket", pa.int32()), ("n_rows", pa.int64()), ("blob", pa.binary())])


def _absorb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct digests into the segments of their bucket; what no segment knows becomes a new one."""
    held: list[Segment] = []
    fresh: list[tuple[np.ndarray, np.ndarray]] = []
    bucket = None

    def finished() -> Iterator[pa.RecordBatch]:
        if fresh:
            held.append(Segment.of(np.concatenate([k for k, _ in fresh]), np.concatenate([r for _, r in fresh])))
        out = held
        if len(held) > MAX_SEGMENTS:
            out = [Segment.of(np.concatenate([s.keys for s in held]), np.concatenate([s.rows for s in held]))]
        for s in out:
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([int(s.rows[:, 3].sum())]), pa.array([s.to_bytes()], pa.binary())], schema=_SEGMENTS)

    for (b, _), rows in _stretches(batches):
        if b != bucket:
            yield from finished()
            held, fresh, bucket = [], [], b
        if rows.column(2)[0].as_py() == 0:
            held += [Segment.from_bytes(x) for x in rows.column(8).to_pylist()]
            continue
        keys, numbers = _digests(rows.column(3)), _numbers(rows)
        for s in held:
            at = s.find(keys)
            s.raise_to(at[at >= 0], numbers[at >= 0])
            keys, numbers = keys[at < 0], numbers[at < 0]
        if len(keys):
            fresh.append((keys, numbers))
    yield from finished()


RESOLVED = "doc_id long, keep_id long, group_size long, kept boolean, digest binary"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with what the slot of its digest says."""
    held: list[Segment] = []
    unit = None
    for key, rows in _stretches(batches):
        if key != unit:
            held, unit = [], key
        if rows.column(2)[0].as_py() == 0:
            held += [Segment.from_bytes(x) for x in rows.column(8).to_pylist()]
            continue
        keys, numbers = _digests(rows.column(3)), _numbers(rows)
        found = np.zeros_like(numbers)
        for s in held:
            at = s.find(keys)
            found[at >= 0] = s.rows[at[at >= 0]]
        if (found[:, 3] == 0).any():
            raise ValueError("the index doesn't hold all rows")
        ids = lambda x: pa.array(x[:, 1], mask=x[:, 0] == 0)
        yield pa.RecordBatch.from_arrays([ids(numbers), ids(found), pa.array(found[:, 3]), pa.array(numbers[:, 2] == found[:, 2]), rows.column(3)], names=["doc_id", "keep_id", "group_size", "kept", "digest"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_no and SHA-256 digest of every row's whole text (null: empty), written; row_no tells repeated rows apart."""
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest")), "exact-rows")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("bucket")


def _dealt(spark: SparkSession, segments: DataFrame | None, rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Segments and rows by bucket and salt, the segments of each first."""
    both = rows.withColumn("kind", F.lit(1)).withColumn("blob", F.lit(None).cast("binary"))
    if segments is not None:
        none = {"digest": "binary", "known": "boolean", "id": "long", "row_no": "long", "n": "long"}
        both = both.select(*_STREAM).unionAll(segments.withColumns({"kind": F.lit(0)} | {c: F.lit(None).cast(t) for c, t in none.items()}).select(*_STREAM))
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return both.select(*_STREAM).repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt", "kind").transform(mapped, function, schema)


def absorb(index: Index | None, rows: DataFrame) -> Index:
    """The index with a batch of fingerprints; None begins one.

    Equal digests are counted on the map side, so a text that a third of the
    rows repeat is one row a task. Members of the index update their slot;
    the others group by themselves and make a new segment.
    """
    spark = rows.sparkSession
    buckets = index.buckets if index else max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET))
    last = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row_no")
    groups = rows.groupBy("digest").agg(F.max(last).alias("last"), F.count("*").alias("n")).select(_bucket(buckets), F.lit(0).alias("salt"), "digest", "last.*", "n")
    old = index.rows.select("bucket", F.lit(0).alias("salt"), "blob") if index else None
    out = Index(written(_dealt(spark, old, groups, _absorb, "bucket int, n_rows long, blob binary"), "exact-index"), buckets)
    if index:
        discard(index.rows)
    return out


def resolve(index: Index, rows: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of fingerprints that the index has absorbed.

    Rows go to their bucket's segments. A bucket with many rows, as of a text
    that is repeated often, is dealt to several tasks, each with a copy of
    its segments.
    """
    spark = rows.sparkSession
    total = index.rows.agg(F.sum("n_rows")).first()[0] or 0
    unit = max(256, total // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    loads = index.rows.groupBy("bucket").agg(F.sum("n_rows").alias("load")).where(F.col("load") > unit)
    hot = written(loads.select("bucket", F.ceil(F.col("load") / unit).cast("int").alias("salts")), "exact-hot")
    salts = F.coalesce("salts", F.lit(1))
    segments = index.rows.join(small_side(hot), "bucket", "left").select("bucket", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "blob")
    asked = rows.withColumn("bucket", _bucket(index.buckets)).join(small_side(hot), "bucket", "left")
    asked = asked.select("bucket", F.pmod(F.xxhash64("row_no"), salts).cast("int").alias("salt"), "digest", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row_no", F.lit(1).cast("long").alias("n"))
    return _dealt(spark, segments, asked, _resolve, RESOLVED)


def deduplicate(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Rows up to the middle of the ids are history, the rest is a batch that
    looks its digests up. Of equal texts the row with the largest doc_id
    stays; a null id is less than all others. Of rows that repeat with id and
    text exactly one stays. A null text equals an empty one. Very long texts
    are hashed whole; an empty table gives no row; other columns are not
    read, so their names don't matter.
    """
    rows = fingerprints(docs)
    ends = rows.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    history = F.col("doc_id") <= ((ends["least"] or 0) + (ends["most"] or 0)) // 2
    index = absorb(absorb(None, rows.where(history)), rows.where(~history | history.isNull()))
    return resolve(index, rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))

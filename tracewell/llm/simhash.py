"""SimHash near-duplicates through covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracewell.llm.common import mapped, small_side, table, written
from tracewell.llm.components import connected_components

BITS = 64
SEED = 42
#: Bit j of entry b is bit j of the byte b.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit SimHash of one text; 0 if it has no word.

    Words are split at ASCII white space after A-Z became a-z; both are what
    bytes.lower() and bytes.split() do. A bit is set if more than half of the
    shingles' hashes have it.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= shingle:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, SEED) for g in grams], dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The signed 64-bit number whose bits are those that more than half of the hashes (little-endian) have; 0 of none."""
    planes = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(planes[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def simhash(text: pd.Series) -> pd.Series:
    """Fingerprint of each text, in three-word shingles."""
    return pd.Series([fingerprint_of(x) for x in text], dtype="int64")


def covering_masks(radius: int, bits: int = BITS, step: int = 1, offset: int = 0) -> list[int]:
    """2**(radius+1)-1 bit masks of which one at least avoids any ``radius`` bits.

    Bit i gets a non-zero vector m(i) of radius+1 bits; mask v keeps the bits
    with an odd product <m(i), v>. Any ``radius`` vectors leave a non-zero v
    orthogonal to all of them, so two fingerprints that differ in ``radius``
    bits or fewer agree under that mask. ``step`` (odd) and ``offset`` deal
    the vectors differently, for a second family.
    """
    n = 2 ** (radius + 1) - 1
    vector = [1 + (i * step + offset) % bits % n for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _masked(fp: Column, masks: list[int]) -> Column:
    return F.array(*[fp.bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])


def _star(fp: np.ndarray, radius: int, out: list[tuple[int, int]]) -> None:
    """Pairs (fingerprint, least of its component) of one bucket, by breadth-first search."""
    left = fp
    while len(left):
        reached, todo, left = [left[0]], [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count((left ^ todo.pop()).view(np.uint64)) <= radius
            if near.any():
                found = left[near].tolist()
                reached += found
                todo += found
                left = left[~near]
        if len(reached) > 1:
            root = min(reached)
            out += [(int(x), int(root)) for x in reached if x != root]


def _link_buckets(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by bucket (fingerprint last): a star for each component within a bucket."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        ends = np.append(starts[1:], len(rows))
        fp, size = rows[:, -1], ends - starts
        two = starts[size == 2]
        near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius]
        more: list[tuple[int, int]] = []
        for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
            _star(np.unique(fp[s:e]), radius, more)
        rest = np.array(more, dtype=np.int64).reshape(-1, 2)
        a, b = np.concatenate([fp[near], rest[:, 0]]), np.concatenate([fp[near + 1], rest[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows = rows if held is None else np.concatenate([held, rows])
            starts = np.concatenate([[0], np.flatnonzero((rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)) + 1])
            held = rows[starts[-1] :]
            if starts[-1]:
                yield pairs(rows[: starts[-1]], starts[:-1])
        if held is not None:
            yield pairs(held, np.array([0]))

    return run


def near_links(fps: DataFrame, radius: int = 3, max_bucket: int = 128) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) that
    span the same components as all pairs within ``radius``.

    Buckets hold the fingerprints that agree under one mask. A bucket of up
    to ``max_bucket`` is searched in place. A larger one is dealt again by a
    second covering family; as both families together fix about 50 of the 64
    bits, no such sub-bucket can hold more than some 2**16 fingerprints,
    whatever the input's size, and nothing is dropped.
    """
    first, second = covering_masks(radius), covering_masks(radius, step=37, offset=11)
    dealt = fps.select("fp", F.posexplode(_masked(F.col("fp"), first)).alias("mask", "key"))
    counts = written(dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    shared = written(dealt.join(counts, ["mask", "key"]).select("mask", "key", "fp", "n"), "simhash-shared")
    schema = "a long, b long"
    small = shared.where(F.col("n") <= max_bucket).select(F.col("mask").cast("long"), "key", "fp")
    small = small.repartition("mask", "key").sortWithinPartitions("mask", "key")
    large = shared.where(F.col("n") > max_bucket).select(F.col("mask").cast("long"), "key", F.posexplode(_masked(F.col("fp"), second)).alias("mask2", "key2"), "fp")
    large = large.withColumn("mask2", F.col("mask2").cast("long")).repartition("mask", "key", "mask2", "key2").sortWithinPartitions("mask", "key", "mask2", "key2")
    link = _link_buckets(radius)
    return small.transform(mapped, link, schema).unionAll(large.transform(mapped, link, schema)).distinct()


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit number by which a row is found again; rows with equal id and text share it."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, ``k`` (its row_key), ``fp`` (signed long), ``component_id``, ``part``, ``first``.

    component_id is the least non-null id among the texts that links of at
    most ``radius`` differing bits reach, the text itself included. Null and
    blank texts have fingerprint 0 and link like any other; repeated ids and
    equal texts are ordinary rows; a null id stays null and takes part in
    linking; ``part``, the component's least fingerprint, names components
    even then; ``first`` is the row_key of the component's first row; an empty
    table gives no rows; other columns are not read. Very long texts are
    hashed whole, shingle by shingle.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("k"), simhash(F.col(text_col)).alias("fp")), "simhash-fp")
    nodes = written(rows.select("fp").distinct(), "simhash-nodes")
    parts = connected_components(near_links(nodes, radius)).withColumnRenamed("node", "fp")
    return placed(rows, nodes, "fp", parts, id_col)


def placed(rows: DataFrame, nodes: DataFrame, node: str, parts: DataFrame, id_col: str) -> DataFrame:
    """``rows`` (id, k, node) with their component's ``part``, least id and first row: ids ascend, null last, then row keys."""
    labelled = written(nodes.join(parts, node, "left").select(node, F.coalesce("component", node).alias("part")), "component-labels")
    told = written(rows.select("id", "k", node).join(labelled, node), "component-rows")
    first = told.groupBy("part").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull().alias("no"), "id", "k")).alias("f"))
    first = written(first.select("part", "component_id", F.col("f.k").alias("first")), "component-first")
    return told.join(first, "part").select(F.col("id").alias(id_col), "k", F.col(node).alias("fp"), "component_id", "part", "first")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, as near_duplicates() finds them."""
    return least_of_each(docs, near_duplicates(docs, id_col, text_col, radius), id_col, text_col)


def least_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of ``found`` one row of ``docs``, unchanged: that with the least id.

    Among rows that share that id, and in a component of null ids only, the
    least hash of id and text decides; of rows equal in both, any one stays.
    What goes is joined to ``docs``, as it is the smaller part as a rule.
    """
    gone = found.where("k <> first").select("k").distinct().withColumn("many", F.lit(False))
    many = found.where("k = first").groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.lit(True).alias("many"))
    marks = written(gone.unionAll(many), "duplicate-rows")
    held = docs.columns
    rows = docs.select(F.struct(*held).alias("row"), row_key(id_col, text_col).alias("k")).join(small_side(marks), "k", "left")
    kept = rows.where("many IS NULL").select("row.*")
    if marks.where("many").isEmpty():
        return kept
    return kept.unionAll(rows.where("many").groupBy("k").agg(F.first("row").alias("row")).select("row.*"))


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")

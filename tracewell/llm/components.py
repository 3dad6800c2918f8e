"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tracewell.llm.common import discard, mapped, written

#: Edges that a task contracts at once.
BLOCK = 1 << 19


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each node of some edges with the least node that these edges reach."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    on = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(nodes[label[on]])], names=["a", "b"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield _stars(*(np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1)))
            held, n = [], 0
    if n:
        yield _stars(*(np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1)))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns ``node`` and ``component`` (the least node that is reachable).

    ``edges`` has two long columns ``a`` and ``b``; loops and repeats are
    allowed, nodes without an edge don't appear in the result. Tasks first
    replace blocks of their edges by stars, which shortens paths. Each round
    then runs two joins whose small sides are written first, so that AQE can
    split the rows of a node with very many neighbours. The number of rounds
    grows with the logarithm of the longest path; only a count and a checksum,
    observed while a round is written, reach the driver.
    """

    def settled(e: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
        seen = Observation()
        out = written(e.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")), "cc-edges")
        return out, (seen.get["n"] or 0, seen.get["x"] or 0)

    stars = edges.where("a <> b").select("a", "b").transform(mapped, _contract, "a long, b long")
    e, before = settled(stars.select(F.col("a").alias("hi"), F.col("b").alias("lo")).distinct())
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-large")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "cc-star")
        low = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "cc-small")
        moved = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        last, (e, after) = e, settled(moved.unionAll(low.select("hi", F.col("m").alias("lo"))).distinct())
        discard(last, least, large, low)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)

"""Hard negatives: exact maximum inner product search over buckets of rows sorted by norm."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import mapped, table, written

#: Rows of a norm bucket, anchors that go through buckets together.
BUCKET, BLOCK = 256, 512
#: Bytes of vectors that a task holds, and the least number of such stripes.
STRIPE_BYTES, MIN_STRIPES = 64 << 20, 16
#: Squared norms stay below this, so no score passes 64 bits.
MAX_NORM2 = float(1 << 62)
POSITIVES, NEGATIVES = 5, 3
_NONE = np.iinfo(np.int64).min

_PACKED = pa.schema([("place", pa.int64()), ("norm", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("data", pa.binary()), ("pos_ids", pa.binary()), ("pos_scores", pa.binary())])
PACKED = "place long, norm double, n int, ids binary, labels binary, data binary, pos_ids binary, pos_scores binary"
_FOUND = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _small(v: np.ndarray) -> bytes:
    """A matrix in the least whole-number type that holds it: the type's bytes, then the values."""
    kind = next(k for k in ("<i2", "<i4", "<i8") if not v.size or (np.iinfo(k).min <= v.min() and v.max() <= np.iinfo(k).max))
    return bytes([int(kind[2])]) + v.astype(kind).tobytes()


def _vectors(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", -1, 1).reshape(n, -1)


def _packer(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (vec_id, label, v, norm2, part, positives) in packs of ``size``, in the order in which they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                b = batch.slice(a, size)
                column = lambda k: b.column(k).to_numpy(zero_copy_only=False).astype("<i8")  # noqa: B023, E731
                pos = [_matrix(b.column(k)) if b.num_columns > 5 else np.zeros((b.num_rows, 0), np.int64) for k in (5, 6)[: b.num_columns - 5] or (5, 5)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip((int(b.column(4)[0].as_py()) + turn, float(np.sqrt(b.column(3).to_numpy().max())), b.num_rows, column(0).tobytes(), column(1).tobytes(), _small(_matrix(b.column(2))), pos[0].tobytes(), pos[1].tobytes()), _PACKED, strict=True)],
                    schema=_PACKED,
                )
                turn += 1

    return run


class Pack(NamedTuple):
    """Rows that are searched together; ``norm`` is their largest."""

    norm: float
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray


def _scores(a: np.ndarray, b: np.ndarray, norms: float) -> np.ndarray:
    """Exact inner products of whole-number rows: in floating point while no partial sum can pass 2**53."""
    k = min(a.shape[1], b.shape[1])
    a, b = a[:, :k], b[:, :k]
    if norms < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def search(packs: list[Pack], anchors: Pack, norms: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` rows of each window: window, id, score.

    Window i asks for anchor ``owner[i]``: rows of its label (``same``, itself
    left out) or of another, with scores from ``low`` to ``high``. ``packs``
    come by falling norm. |a| |b| bounds a score, so a pack is tried only for
    windows whose lower limit and k-th score so far it can reach; when it can
    reach none, no later one can.
    """
    best, who = np.full((len(owner), k), _NONE), np.zeros((len(owner), k), np.int64)
    for p in packs:
        need = np.maximum(low, best[:, -1])
        # A little more than the product, as norms are rounded.
        open_ = np.flatnonzero(norms[owner] * p.norm * (1 + 1e-12) + 1 >= need)
        if not len(open_):
            break
        rows, place = np.unique(owner[open_], return_inverse=True)
        s = _scores(anchors.v[rows], p.v, float(norms[rows].max()) * p.norm)
        fit = (anchors.labels[rows][:, None] == p.labels) == same
        if same:
            fit &= anchors.ids[rows][:, None] != p.ids
        s[~fit] = _NONE
        s = s[place]
        s[(s < need[open_][:, None]) | (s > high[open_][:, None])] = _NONE
        any_ = (s != _NONE).any(axis=1)
        open_, s = open_[any_], s[any_]
        if not len(open_):
            continue
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), _NONE)
        r, c = np.nonzero((s >= least[:, None]) & (s != _NONE))
        window, score, found = np.concatenate([np.repeat(open_, k), open_[r]]), np.concatenate([best[open_].ravel(), s[r, c]]), np.concatenate([who[open_].ravel(), p.ids[c]])
        real = score != _NONE
        window, score, found = window[real], score[real], found[real]
        order = np.lexsort((found, -score, window))
        window, score, found = window[order], score[order], found[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        top = rank < k
        best[window[top], rank[top]], who[window[top], rank[top]] = score[top], found[top]
    window, at = np.nonzero(best != _NONE)
    return window, who[window, at], best[window, at]


def limits(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score from 50 to 95 % of a positive's, without products that could overflow."""
    return -((-positive) // 2), positive + ((-positive) // 20)


def _searcher(k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: list[Pack] = []
        stripe = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["stripe"] != stripe:
                    packs, stripe = [], row["stripe"]
                ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                pack = Pack(row["norm"], ids, labels, _vectors(row["data"], row["n"]))
                if row["kind"] == 0:
                    packs.append(pack)
                    continue
                if same:
                    owner = positive = np.arange(row["n"])
                    low, high = np.full(row["n"], _NONE), np.full(row["n"], np.iinfo(np.int64).max)
                    asked = score = np.zeros(row["n"], np.int64)
                else:
                    asked, score = (np.frombuffer(row[c], "<i8").reshape(row["n"], -1) for c in ("pos_ids", "pos_scores"))
                    owner, at = np.nonzero(score != _NONE)
                    asked, score = asked[owner, at], score[owner, at]
                    low, high = limits(score)
                norms = np.sqrt((pack.v.astype(np.float64) ** 2).sum(axis=1))
                window, found, scores = search(packs, pack, norms, owner, low, high, k, same)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[owner[window]], asked[window], score[window], found, scores)], schema=_FOUND)

    return run


def vectors(rows: DataFrame, relabelled: Column | None = None) -> DataFrame:
    """vec_id, label, v (whole numbers), norm2 of the rows that take part.

    Rows with a null id, label or vector, or any null or non-finite component
    don't; nor do rows whose squared norm reaches 2**62, whose scores could
    pass 64 bits. Of rows that share a vec_id the least by label, then
    vector, counts.
    """
    label = F.col("label").cast("long") if relabelled is None else relabelled
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    x = x.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    # Null is no value of forall when nothing is false, so it must be refused too.
    x = x.where(~F.exists("v", lambda e: e.isNull()))
    whole = F.transform("v", lambda e: F.floor(256 * e))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, e: s + F.floor(256 * e).cast("double") * F.floor(256 * e).cast("double"))
    x = x.select("vec_id", "label", whole.alias("v"), norm2.alias("norm2")).where(F.col("norm2") < MAX_NORM2)
    return x.groupBy("vec_id").agg(F.min(F.struct("label", "v", "norm2")).alias("r")).select("vec_id", "r.*")


def _packed(rows: DataFrame, size: int, *more: str) -> DataFrame:
    return rows.select("vec_id", "label", "v", "norm2", F.spark_partition_id().alias("part"), *more).transform(mapped, _packer(size), PACKED)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _against(packs: DataFrame, stripes: int, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """Every block of anchors goes to every stripe of packs, which a task holds by falling norm."""
    a = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn("kind", F.lit(1))
    p = packs.withColumn("stripe", F.pmod("place", F.lit(stripes)).cast("int")).withColumn("kind", F.lit(0))
    both = p.unionByName(a).repartitionById(stripes, F.col("stripe")).sortWithinPartitions("stripe", "kind", F.desc("norm"), "place")
    return both.transform(mapped, _searcher(k, same), FOUND)


def hard_negatives(rows: DataFrame, anchor: Column, relabelled: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says of vec_id whether a row asks. Its positives are its first
    5 other rows of equal label by inner product, ties by the smaller id; for
    each, the first 3 rows of other labels whose score is from 50 to 95 % of
    the positive's. Rows are sorted by norm, cut into packs and dealt to
    stripes round robin, so each stripe has all norms; a label or vector that
    a third of the rows share is spread like any other. Vectors of unequal
    length are compared over the shorter one. An empty table gives no row;
    columns other than vec_id, embedding, label are not read.
    """
    v = written(vectors(rows, relabelled), "negatives-rows")
    by_norm = v.repartitionByRange("norm2", "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    packs = written(_packed(by_norm, BUCKET), "negatives-packs")
    stripes = max(MIN_STRIPES, -(-(packs.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // STRIPE_BYTES))
    asking = v.where(anchor)
    found = _against(packs, stripes, _packed(asking, BLOCK), POSITIVES, True)
    positives = written(_first(found, ["anchor_id"], POSITIVES).select("anchor_id", "id", "score", "rank"), "negatives-positives")
    # At most five a row; the lists are filled up so that all are equally long.
    lists = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    fill = F.array_repeat(F.lit(_NONE).cast("long"), POSITIVES)
    lists = lists.select(F.col("anchor_id").alias("vec_id"), F.slice(F.concat(F.col("p.id"), fill), 1, POSITIVES).alias("pos_ids"), F.slice(F.concat(F.col("p.score"), fill), 1, POSITIVES).alias("pos_scores"))
    found = _against(packs, stripes, _packed(asking.join(lists, "vec_id"), BLOCK, "pos_ids", "pos_scores"), NEGATIVES, False)
    best = _first(found, ["anchor_id", "positive_id"], NEGATIVES)
    return best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)

"""Near copies by the Jaccard similarity of word shingles: SimHash groups them, exact sets confirm them, MinHash bands propose what SimHash leaves apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import discard, mapped, small_side, written
from tracewell.llm.components import connected_components
from tracewell.llm.simhash import majority, near_links, placed, row_key

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity s shares no band with probability (1 - s**ROWS) ** BANDS: 1.3e-7 at 0.8, 3e-16 at 0.9.
BANDS, ROWS = 40, 5
SEED = 42
#: Buckets of up to so many texts give all their pairs at once.
MAX_BUCKET = 32
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, in order; words as in SimHash, a text of fewer words is one shingle, none gives none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype="<u8")
    grams = [b" ".join(w)] if len(w) <= SHINGLE else map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype="<u8"))


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit number for the set; texts with equal sets are one node."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - 2**63


def keys_of(shingles: np.ndarray) -> list[int]:
    """One number for each band: a hash of ROWS minima over the set."""
    if not len(shingles):
        return []
    # In blocks, so that a long text needs no table of its own size times the factors.
    blocks = [(_FACTORS[:, None] * shingles[i : i + 256]).min(axis=1) for i in range(0, len(shingles), 256)]
    least = np.min(blocks, axis=0).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(b.tobytes(), i) - 2**63 for i, b in enumerate(least)]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k, text) to (id, k, node, fp, keys); fp is the SimHash of the set."""
    for batch in batches:
        sets = [shingles_of(x.as_py()) for x in batch.column(2)]
        columns = [*batch.columns[:2], pa.array([node_of(s) for s in sets], pa.int64()), pa.array([majority(s) for s in sets], pa.int64()), pa.array([keys_of(s) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "k", "node", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, shingles)."""
    for batch in batches:
        sets = pa.array([shingles_of(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["node", "shingles"])


def _confirmed(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (a, b, shingles of a, shingles of b) the pairs whose sets are as similar."""

    def similar(x: bytes, y: bytes) -> bool:
        if min(len(x), len(y)) / max(len(x), len(y)) < similarity:
            return False
        both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
        return bool(both / ((len(x) + len(y)) // 8 - both) >= similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    one = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
    return written(one.select("a", "b", "of_a", "of_b").transform(mapped, _confirmed(similarity), "a long, b long"), "similar-links")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of sets (node, fp): each set of a SimHash group and the group's greatest, so one pair a set at most.

    Groups are operator 5's, by covering LSH: links of at most three
    differing bits, and what they reach.
    """
    fps = written(nodes.select("fp").distinct(), "simhash-nodes")
    parts = connected_components(near_links(fps)).withColumnRenamed("node", "fp")
    groups = written(nodes.join(parts, "fp", "left").select("node", F.coalesce("component", "fp").alias("part")), "similar-groups")
    hubs = groups.groupBy("part").agg(F.max("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("part", "hub")
    pairs = written(groups.join(hubs, "part").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")), "similar-twins")
    discard(fps, groups)
    return pairs


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs that ``parts`` (node, component) don't join yet."""
    side = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("of_a IS NULL OR of_b IS NULL OR of_a <> of_b").select("a", "b")


def _open(side: DataFrame) -> DataFrame:
    """The rows of the buckets (key) whose sets are in several parts."""
    mixed = side.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    return side.join(mixed, "key")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) to one row a shingle."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(1)]
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate(sets))], names=["node", "token"])


#: Classes of shingles in a profile; sets beyond LARGE shingles are compared without.
CLASSES, LARGE = 256, 30_000


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) to (node, size, number of shingles of each class)."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(1)]
        profile = [np.minimum(np.bincount((x & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 32767).astype(np.int16) for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(profile, pa.list_(pa.int16()))], names=["node", "size", "profile"])


def _able(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the rows of open buckets those whose set can be similar to another one there; adds ``size``, ``common`` and ``profile``.

    ``common`` counts the shingles of a set that any other set of these
    buckets has as well. Two sets x and y share at most common(x) of them, so
    x needs a partner of no more than common(x) * (1 + 1 / similarity) -
    size(x) shingles. Where the bucket has none as small, x has no link left
    to find, and no pairs are made for it. ``profile`` counts its shingles by
    class; the sum of the lesser counts bounds what two sets share.
    """
    nodes = open_.select("node").distinct()
    held = written(sets.join(nodes, "node", "left_semi"), "similar-held")
    tokens = held.transform(mapped, _tokens, "node long, token long")
    own = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    facts = held.transform(mapped, _profiles, "node long, size long, profile array<short>").join(own, "node", "left").select("node", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("common"), "profile")
    rows = written(open_.join(written(facts, "similar-facts"), "node"), "similar-sized")
    least = rows.groupBy("key").agg(F.min("size").alias("least"))
    return rows.join(least, "key").where(F.expr(f"common * {1 + 1 / similarity!r}D - size >= least")).select("key", "node", "part", "size", "common", "profile")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per row of ``docs``: id, ``k``, ``fp`` (number of its shingle set), ``component_id``, ``part``, ``first``, as simhash.near_duplicates has them.

    Texts are linked if the Jaccard similarity of their sets of five-word
    shingles is at least ``similarity``; texts without a word are alike. Sets
    are first compared within their SimHash group. Three bits reach close
    copies only, so MinHash bands propose the rest, of which pairs that are
    joined already are left out. A bucket holds the sets that agree in one
    band. All pairs of a small bucket are compared. In larger ones each set is first compared with one hub;
    then only sets that no confirmed link joins yet, and that can have a link
    at all by an exact bound, are compared with each other. So nothing is
    dropped and a large group of copies costs its size. Null and blank texts
    are alike, repeated rows are rows, ties between hubs go to the greater
    number, a very long text needs its set in memory, an empty table gives no
    rows, and other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = written(texts.transform(mapped, _signed, f"id {kind}, k long, node long, fp long, keys array<bigint>"), "similar-rows")
    nodes = written(rows.groupBy("node").agg(F.min("k").alias("k"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "similar-nodes")
    twins = simhash_pairs(nodes.select("node", "fp"))
    dealt = nodes.select("node", F.explode("keys").alias("key"))
    least = written(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "similar-buckets")
    shared = written(dealt.join(least, "key"), "similar-shared")
    discard(least)

    lists = shared.where(F.col("n") <= max_bucket).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("l")).select("l").distinct()
    small = lists.select(F.explode(F.expr("flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x AS a, y AS b))))")).alias("p")).select("p.a", "p.b")
    # The hub of a large bucket is the set that most others meet in such buckets, as the text that copies were made from does.
    crowded = shared.where(F.col("n") > max_bucket).select("key", "node", "n")
    met = written(crowded.groupBy("node").agg(F.sum("n").alias("met")), "similar-met")
    crowded = written(crowded.join(met, "node").select("key", "node", "met"), "similar-crowded")
    hubs = written(crowded.groupBy("key").agg(F.max(F.struct("met", "node")).alias("hub")), "similar-hubs")
    # A set meets the foremost of its buckets' hubs only, so there is one such pair a set.
    best = crowded.join(hubs, "key").where("node <> hub.node").groupBy("node").agg(F.max("hub").alias("hub"))
    spokes = best.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b"))
    pairs = written(small.unionAll(spokes).distinct(), "similar-pairs")

    # One row's text for each set that is to be compared.
    wanted = pairs.unionAll(twins).select(F.explode(F.array("a", "b")).alias("node")).unionAll(crowded.select("node")).distinct()
    wanted = written(nodes.select("node", "k").join(wanted, "node", "left_semi"), "similar-wanted")
    sets = texts.select("k", "text").join(small_side(wanted), "k").select("node", "text").transform(mapped, _sets, "node long, shingles binary")
    sets = written(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "similar-sets")
    close = _confirm(twins, sets, similarity)
    joined = written(connected_components(close), "similar-parts")
    rest = _confirm(_apart(pairs, joined), sets, similarity)
    links = close.unionAll(rest)
    parts = written(connected_components(links), "similar-parts")

    side = written(crowded.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")), "similar-sides")
    done = [shared, met, crowded, hubs, pairs, twins, wanted, sets, joined, close, rest, side]
    open_ = written(_open(side), "similar-open")
    if not open_.isEmpty():
        able = written(_able(open_, sets, similarity), "similar-able")
        left = written(_open(able), "similar-left")
        other = left.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "part", "size", "common", "profile")])
        # Exact bounds on what two sets share, the cheap ones first.
        need = f"(size + size_b) * {similarity / (1 + similarity)!r}D - 1e-9D"
        bound = F.expr(f"node < node_b AND part <> part_b AND least(common, common_b, size, size_b) >= {need} AND (greatest(size, size_b) > {LARGE} OR aggregate(zip_with(profile, profile_b, (x, y) -> least(x, y)), 0, (s, x) -> s + x) >= {need})")
        more = left.join(other, "key").where(bound).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
        more = written(more.join(pairs, ["a", "b"], "left_anti"), "similar-pairs")
        done += [able, left, more]
        if not more.isEmpty():
            again = _confirm(more, sets, similarity)
            done += [again, parts]
            parts = written(connected_components(links.unionAll(again)), "similar-parts")
    done.append(open_)
    discard(*done)
    return placed(rows, nodes.select("node"), "node", parts, id_col)

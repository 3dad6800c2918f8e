"""Substring deduplication through prefix-partitioned suffix trees over words."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import mapped, scratch, table

WINDOW = 13
#: Lengths of the prefixes that may name a group; the last is the depth at which trees are cut.
LADDER = (1, 2, 4, 8, WINDOW)
#: Words of suffixes that a task holds at once, and bytes of text behind one group of subtrees.
BATCH_WORDS = 1 << 20
PART_BYTES = 32 << 20
#: Finest share of all suffixes at which a prefix still counts as too frequent; bounds the table of those.
LEAST_SHARE = 1e-5

_RANDOM = np.random.Generator(np.random.PCG64(1313))
_COEF = (_RANDOM.integers(0, 1 << 63, size=(2, WINDOW), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _stir(x: np.ndarray) -> np.ndarray:
    """Mix all bits of 64-bit numbers."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def word_codes(text: str | None) -> np.ndarray:
    """A 64-bit code for each word of a whole text."""
    w = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))


@dataclass
class Suffixes:
    """The suffixes of at least a window's length of some documents, in document and word order."""

    ids: np.ndarray  # of documents, ascending
    tags: np.ndarray
    begin: np.ndarray  # each document's first suffix, and their number at the end
    prefix: list[np.ndarray]  # path fingerprints at the depths of LADDER
    check: np.ndarray  # eight more bits of the fingerprint at full depth

    @classmethod
    def of(cls, rows: list[tuple[int, int, np.ndarray]]) -> Suffixes:
        rows = sorted((r for r in rows if len(r[2]) >= WINDOW), key=lambda r: (r[0], r[1]))
        counts = np.array([len(r[2]) - WINDOW + 1 for r in rows], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(counts)])
        sums, prefix = np.zeros(begin[-1], dtype=np.uint64), []
        other = np.zeros(begin[-1], dtype=np.uint64)
        if rows:
            codes = np.concatenate([r[2] for r in rows])
            at = np.arange(begin[-1]) + np.repeat(np.arange(len(rows)) * (WINDOW - 1), counts)
            for j in range(WINDOW):
                c = codes[at + j]
                sums = sums + c * _COEF[0, j]
                other = other + (c ^ c >> np.uint64(29)) * _COEF[1, j]
                if j + 1 in LADDER:
                    prefix.append(_stir(sums + np.uint64(j)))
        else:
            prefix = [sums] * len(LADDER)
        return cls(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64), begin, prefix, (_stir(other) >> np.uint64(56)).astype(np.uint8))

    def __len__(self) -> int:
        return int(self.begin[-1])


def _batches(source: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
    """Input rows (id, tag, text) as Suffixes of about BATCH_WORDS; a document isn't split."""
    held: list[tuple[int, int, np.ndarray]] = []
    n = 0
    for batch in source:
        for key, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            held.append((key, tag, word_codes(text.as_py())))
            n += len(held[-1][2])
            if n >= BATCH_WORDS:
                yield Suffixes.of(held)
                held, n = [], 0
    yield Suffixes.of(held)


def _frequent(share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the prefixes that make up at least half of ``share`` of a batch; longer ones only below those. Depth 0 counts all suffixes."""
    kind = pa.schema([("depth", pa.int32()), ("fp", pa.int64()), ("n", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _batches(source):
            out = [(0, 0, len(s))]
            open_ = np.arange(len(s))
            for depth, fp in zip(LADDER[:-1], s.prefix, strict=False):
                values, inverse, n = np.unique(fp[open_], return_inverse=True, return_counts=True)
                many = n >= max(2, share / 2 * len(s))
                out += [(depth, int(v), int(c)) for v, c in zip(values[many].view(np.int64), n[many], strict=True)]
                open_ = open_[many[inverse]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return run


def _parts(s: Suffixes, too_many: list[np.ndarray], n_parts: int) -> np.ndarray:
    """The part of each suffix: by its shortest prefix that isn't too frequent."""
    group, open_ = s.prefix[-1].copy(), np.arange(len(s))
    for fp, many in zip(s.prefix, too_many, strict=False):
        if not len(open_):
            break
        here = fp[open_]
        at = np.minimum(np.searchsorted(many, here), max(len(many) - 1, 0))
        frequent = many[at] == here if len(many) else np.zeros(len(open_), dtype=bool)
        group[open_[~frequent]] = here[~frequent]
        open_ = open_[frequent]
    return (_stir(group + np.uint64(1)) % np.uint64(n_parts)).astype(np.int64)


def _gaps(at: np.ndarray) -> bytes:
    """Ascending numbers as one-byte gaps; 255 stands for the next of the long ones."""
    gap = np.diff(at, prepend=0)
    long_ = gap[gap >= 255].astype("<u4").tobytes()
    return np.array([len(at), len(long_)], "<i8").tobytes() + np.minimum(gap, 255).astype(np.uint8).tobytes() + long_


def _ungap(raw: bytes, o: int = 0) -> tuple[np.ndarray, int]:
    """The numbers at ``o``, and where they end."""
    n, m = np.frombuffer(raw, "<i8", 2, o).tolist()
    gap = np.frombuffer(raw, np.uint8, n, o + 16).astype(np.int64)
    gap[gap == 255] = np.frombuffer(raw, "<u4", m // 4, o + 16 + n)
    return np.cumsum(gap), o + 16 + n + m


def _columns(*rows: np.ndarray) -> bytes:
    return zlib.compress(np.stack(rows).astype("<i8").tobytes(), 1)


#: Rows between the stages. kind 0: suffixes for a part (positions, fingerprints, and their own documents); 1: a batch's documents and the repeats that it found itself; 2: repeats that a part found.
SHIPPED = "part int, batch long, kind int, blob binary, docs binary"
_SHIPPED = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary()), ("docs", pa.binary())])
MARKS = "id long, tag long, pos binary"
_MARKS = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("pos", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(zip(*rows[k : k + size], strict=True), schema, strict=True)], schema=schema)


def _equal_runs(fp: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where a new fingerprint begins, in sorted order."""
    return np.concatenate([[True], (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])])


def _ship(too_many: list[np.ndarray], n_parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deal suffixes to the parts. Of equal windows of a batch only those of its least document go; the others are repeats already.

    A batch is named by its contents, so that a task that runs again names it alike.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _batches(source):
            if not len(s):
                continue
            fp = s.prefix[-1]
            doc = np.searchsorted(s.begin, np.arange(len(s)), side="right") - 1
            order = np.argsort(fp, kind="stable")
            first = np.concatenate([[True], fp[order][1:] != fp[order][:-1]])
            sub = order[np.flatnonzero(~(first & np.append(first[1:], True)))]
            done = sub
            if len(sub):
                sub = sub[np.lexsort((sub, s.check[sub], fp[sub]))]
                lead = _equal_runs(fp[sub], s.check[sub])
                done = np.sort(sub[s.ids[doc[sub]] > s.ids[doc[sub[lead]]][np.cumsum(lead) - 1]])
            live = np.ones(len(s), dtype=bool)
            live[done] = False
            at = np.flatnonzero(live)
            part = _parts(s, too_many, n_parts)[at]
            by_part = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[by_part], np.arange(n_parts + 1))
            sizes = np.diff(s.begin)
            home = _columns(np.diff(s.ids, prepend=0), s.tags, sizes)
            batch = int(np.int64(np.uint64(xxhash.xxh64_intdigest(home))))
            rows = [(batch % n_parts, batch, 1, _gaps(done), home)]
            for p in np.flatnonzero(np.diff(edges)).tolist():
                own = at[by_part[edges[p] : edges[p + 1]]]
                # Only the documents that these suffixes are of, so what is sent doesn't grow with the number of parts.
                of, n = np.unique(doc[own], return_counts=True)
                rows.append((p, batch, 0, _gaps(own) + fp[own].tobytes() + s.check[own].tobytes(), _columns(np.diff(s.ids[of], prepend=0), n)))
                if len(rows) == 64:
                    yield from _rows(rows, _SHIPPED, 64)
                    rows = []
            yield from _rows(rows, _SHIPPED, 64)

    return run


def _subtrees(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part: sort its suffixes by path fingerprint; each run of two or more is an internal node at window depth, below which all but the least document's suffixes are repeats."""
    names, ats, fps, checks, ids = [], [], [], [], []
    for incoming in source:
        for batch, kind, blob, docs in zip(incoming.column(1).to_pylist(), incoming.column(2).to_pylist(), incoming.column(3), incoming.column(4), strict=True):
            if kind:
                yield from _rows([(0, batch, kind, blob.as_py(), docs.as_py())], _SHIPPED, 1)
                continue
            raw = blob.as_py()
            at, o = _ungap(raw)
            gap, n = np.frombuffer(zlib.decompress(docs.as_py()), "<i8").reshape(2, -1)
            names.append(batch)
            ats.append(at.astype(np.uint32))
            fps.append(np.frombuffer(raw, "<u8", len(at), o))
            checks.append(np.frombuffer(raw, np.uint8, len(at), o + 8 * len(at)))
            ids.append(np.repeat(np.cumsum(gap), n))
    if not fps:
        return
    of = np.repeat(np.arange(len(fps), dtype=np.int32), [len(x) for x in fps])
    fp = np.concatenate(fps)
    fps.clear()
    order = np.argsort(fp)
    f = fp[order]
    same = f[1:] == f[:-1]
    sub = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    del order, f, same
    if not len(sub):
        return
    check, owner, at = (np.concatenate(x) for x in (checks, ids, ats))
    sub = sub[np.lexsort((check[sub], fp[sub]))]
    lead = _equal_runs(fp[sub], check[sub])
    least = np.minimum.reduceat(owner[sub], np.flatnonzero(lead))
    repeat = np.sort(sub[owner[sub] > least[np.cumsum(lead) - 1]])  # by batch, then place
    edges = np.searchsorted(of[repeat], np.arange(len(names) + 1))
    rows = [(0, batch, 2, _gaps(at[repeat[edges[k] : edges[k + 1]]].astype(np.int64)), None) for k, batch in enumerate(names) if edges[k + 1] > edges[k]]
    yield from _rows(rows, _SHIPPED, 64)


def _resolve(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch together, its documents first: one row for each document that has repeats."""

    def documents(home: bytes, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at = np.unique(np.concatenate(found))
        if not len(at):
            return
        gap, tags, sizes = np.frombuffer(zlib.decompress(home), "<i8").reshape(3, -1)
        ids, begin = np.cumsum(gap), np.concatenate([[0], np.cumsum(sizes)])
        doc = np.searchsorted(begin, at, side="right") - 1
        cut = np.flatnonzero(np.diff(doc)) + 1
        rows = [(int(ids[d]), int(tags[d]), p.astype("<u4").tobytes()) for d, p in zip(doc[np.concatenate([[0], cut])], np.split(at - begin[doc], cut), strict=True)]
        yield from _rows(rows, _MARKS, 5000)

    held, home, found = None, b"", []
    for incoming in source:
        for batch, _kind, blob, docs in zip(incoming.column(1).to_pylist(), incoming.column(2).to_pylist(), incoming.column(3), incoming.column(4), strict=True):
            if batch != held:
                if found:
                    yield from documents(home, found)
                held, found = batch, []
            if docs.is_valid:
                home = docs.as_py()
            found.append(_ungap(blob.as_py())[0])
    if found:
        yield from documents(home, found)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``id``, ``tag``, ``pos``: where windows of 13 words start that also start in a document with a smaller id.

    ``tag`` tells rows of equal id by their text; ``pos`` holds little-endian
    32-bit word positions; a document has one row a batch, so one unless rows
    repeat. Rows with a null
    id have no order and neither repeat nor are repeated.

    A suffix belongs to the group of its shortest prefix (1, 2, 4, 8 or 13
    words) that isn't too frequent by counts over all documents; groups are
    dealt to parts, each for a bounded amount of text. A task holds one part,
    sorts its suffixes by the fingerprint (72 bits, the part besides) of
    their path to the depth of a window and so finds the nodes at that depth
    that have two suffixes or more. A batch sends only the least document's
    suffixes of equal windows, so a window that very many documents share
    reaches its part at most once a batch and document. Parts answer each
    batch in one packed row.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    share = max(1 / (4 * n_parts), LEAST_SHARE)
    counts = rows.transform(mapped, _frequent(share), "depth int, fp long, n long").groupBy("depth", "fp").agg(F.sum("n").alias("n"))
    folder = scratch(spark, "prefixes")
    counts.write.parquet(folder)
    counts = spark.read.schema("depth int, fp long, n long").parquet(folder)
    total = counts.where("depth = 0").agg(F.sum("n")).first()[0] or 0
    # At most 1 / share prefixes a depth pass this, so the table is bounded.
    found = counts.where((F.col("depth") > 0) & (F.col("n") > share * total)).select("depth", "fp").collect()
    too_many = [np.sort(np.array([r["fp"] for r in found if r["depth"] == d], dtype=np.int64).view(np.uint64)) for d in LADDER[:-1]]
    shipped = rows.transform(mapped, _ship(too_many, n_parts), SHIPPED)
    found = shipped.repartitionById(n_parts, "part").transform(mapped, _subtrees, SHIPPED)
    return found.repartition("batch").sortWithinPartitions("batch", "kind").transform(mapped, _resolve, MARKS)


def cut(text: str | None, positions: list[bytes] | None) -> tuple[int, int, str]:
    """Number of words, number removed, and the kept words joined by blanks."""
    w = (text or "").encode("utf-8", "surrogatepass").split()
    if not positions:
        return len(w), 0, b" ".join(w).decode("utf-8", "surrogatepass")
    at = np.frombuffer(b"".join(positions), "<u4").astype(np.int64)
    edge = np.bincount(at, minlength=len(w) + WINDOW + 1) - np.bincount(at + WINDOW, minlength=len(w) + WINDOW + 1)
    gone = np.cumsum(edge)[: len(w)] > 0
    return len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g).decode("utf-8", "surrogatepass")


def _cutter(digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256" if digest else "kept", pa.string())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                got = [cut(t.as_py(), p.as_py()) for t, p in zip(part.column(1), part.column(2), strict=True)]
                last = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() if digest else x for _, _, x in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array(last, pa.string())], schema=kind)

    return run


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_words``, ``n_removed`` and the ``kept`` text (or its SHA-256).

    Each word that a repeated window covers goes; windows are judged on the
    input. Null and blank texts have no words; rows of equal id don't repeat
    each other; rows with a null id stay whole; a text of any length is one
    unit of a task's batch, so a very long one needs some 40 bytes a word; an
    empty table gives no rows; other columns are not read.
    """
    marks = repeated_windows(docs, id_col, text_col).groupBy("id", "tag").agg(F.collect_list("pos").alias("pos"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag"), F.col(text_col).alias("text"))
    joined = rows.join(marks, ["id", "tag"], "left").select("id", "text", "pos")
    return joined.transform(mapped, _cutter(digest), f"id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("id", "doc_id")

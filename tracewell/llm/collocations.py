"""Collocations: count tries of three words per shard, merged by prefix range.

Each word of a piece begins one path of three words, filled up with empty ones
at the piece's end. So the counts of such paths hold those of all shorter
phrases, as sums over the paths below a node.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import mapped, small_side, table, written

#: A shard's trie is written when it has seen so many words, or so many different ones.
FLUSH_WORDS, FLUSH_VOCABULARY = 2_000_000, 500_000
#: Paths of all shards that a range is meant for, and bytes of text that the ranges are sampled from.
RANGE_PATHS, SAMPLE_BYTES = 1_500_000, 4_000_000
MIN_COUNT, TOP = 10, 2000
SCORE = 1_000_000

#: Separators of pieces become line ends, capitals small letters.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)

Paths = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Boundary = tuple[bytes, bytes, bytes]

_SHARD = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("n_paths", pa.int64()), ("blob", pa.binary())])
SHARD = "lang string, part int, n_paths long, blob binary"
_NODES = pa.schema([("lang", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("w3", pa.string()), ("n", pa.int64()), ("left1", pa.int64()), ("left2", pa.int64()), ("cut", pa.bool_())])
NODES = "lang string, w1 string, w2 string, w3 string, n long, left1 long, left2 long, cut boolean"


def tally(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> Paths:
    """Paths in order, each once, with the sum of its counts. Sorted runs that follow each other are merged."""
    if not len(a):
        return a, b, c, n
    bits = int(max(a.max(), b.max(), c.max())).bit_length()
    if 3 * bits <= 63:
        key = (a << 2 * bits) | (b << bits) | c
    else:
        key = (np.unique((a << 32) | b, return_inverse=True)[1] << 32) | c
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    first = order[starts]
    return a[first], b[first], c[first], np.add.reduceat(n[order], starts)


class Counter:
    """Words of pieces as numbers; ``paths`` gives the trie of what was added."""

    def __init__(self) -> None:
        self.code: dict[bytes, int] = {b"": 0}
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, text: str) -> None:
        code = self.code
        got: list[int] = []
        for piece in text.encode("utf-8", "surrogatepass").translate(_PLAIN).split(b"\n"):
            words = piece.split()
            if words:
                got += [code.setdefault(w, len(code)) for w in words]
                got += (0, 0)
        self.parts.append(np.array(got, np.int32))
        self.n += len(got)

    def paths(self) -> tuple[list[bytes], Paths]:
        """All words in byte order, and paths by their places there."""
        words = sorted(self.code)
        place = np.empty(len(words), np.int64)
        place[[self.code[w] for w in words]] = np.arange(len(words))
        seq = place[np.concatenate([*self.parts, np.zeros(2, np.int32)])]
        at = np.flatnonzero(seq)
        a, b, c = seq[at], seq[at + 1], seq[np.minimum(at + 2, len(seq) - 1)]
        return words, tally(a, b, np.where(b == 0, 0, c), np.ones(len(a), np.int64))


def to_bytes(words: list[bytes], paths: Paths) -> bytes:
    """A sorted trie: its own words, then columns of first words (by steps), second, third, counts; compressed."""
    a, b, c, n = paths
    # The empty word is always there, as number 0.
    used, local = np.unique(np.concatenate([[0], a, b, c]), return_inverse=True)
    text = b"\n".join([words[i] for i in used])
    a, b, c = local[1:].reshape(3, -1).astype("<i4")
    body = b"".join([np.array([len(text), len(a)], "<i8").tobytes(), text, np.diff(a, prepend=0).astype("<i4").tobytes(), b.tobytes(), c.tobytes(), n.astype("<i8").tobytes()])
    return np.array([len(body)], "<i8").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def from_bytes(blob: bytes) -> tuple[list[bytes], Paths]:
    body = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob, "<i8", 1)[0]), codec="zstd", asbytes=True)
    size, n = np.frombuffer(body, "<i8", 2).tolist()
    at = 16 + size
    a, b, c = (np.frombuffer(body, "<i4", n, at + 4 * n * k).astype(np.int64) for k in range(3))
    return body[16:at].split(b"\n"), (np.cumsum(a), b, c, np.frombuffer(body, "<i8", n, at + 12 * n))


def merge(tries: list[tuple[list[bytes], Paths]]) -> tuple[list[bytes], Paths]:
    """Sorted tries as one, over the words of all."""
    words = sorted({w for v, _ in tries for w in v})
    place = {w: i for i, w in enumerate(words)}
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for v, paths in tries:
        to = np.array([place[w] for w in v], np.int64)
        for held, x, k in zip(columns, paths, range(4), strict=True):
            held.append(to[x] if k < 3 else x)
    return words, tally(*(np.concatenate(x) for x in columns))


def cuts(words: list[bytes], paths: Paths, bounds: list[Boundary]) -> list[int]:
    """Where in sorted paths each boundary falls: the number of paths before it."""
    out = []
    for bound in bounds:
        low, high = 0, len(paths[0])
        for column, word in zip(paths[:3], bound, strict=True):
            at = bisect_left(words, word)
            begin = low + int(np.searchsorted(column[low:high], at))
            if at == len(words) or words[at] != word:
                low = begin
                break
            low, high = begin, low + int(np.searchsorted(column[low:high], at, "right"))
        out.append(low)
    return out


def _sharder(bounds: dict[str, list[Boundary]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(lang: str, counter: Counter) -> Iterator[pa.RecordBatch]:
        words, paths = counter.paths()
        at = [0, *cuts(words, paths, bounds.get(lang, [])), len(paths[0])]
        for part, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if b > a:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part], pa.int32()), pa.array([b - a]), pa.array([to_bytes(words, tuple(x[a:b] for x in paths))])], schema=_SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counter = held.setdefault(lang, Counter())
                counter.add(text.as_py())
                # All languages together bound what a task holds.
                if sum(c.n for c in held.values()) >= FLUSH_WORDS or sum(len(c.code) for c in held.values()) >= FLUSH_VOCABULARY:
                    for name in list(held):
                        yield from flush(name, held.pop(name))
        for name in list(held):
            yield from flush(name, held.pop(name))

    return run


def walk(words: list[bytes], paths: Paths, least: int) -> dict[str, list]:
    """Nodes of a merged range: words, count, the counts of the ancestors, and whether the node may go on in another range.

    One pass over the sorted paths gives each node's count as a sum over its
    stretch, so a phrase finds its left parts above itself. The first and
    last stretch of each depth may go on beyond the range: these are ``cut``,
    and their count isn't told to the phrases below. Rare nodes that aren't
    cut are left out.
    """
    a, b, c, n = paths
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    n2, n1 = np.add.reduceat(n, head), np.add.reduceat(n, first)
    ends = lambda k: np.isin(np.arange(k), (0, k - 1))
    cut2, cut1 = ends(len(head)), ends(len(first))
    of1 = np.searchsorted(first, head, "right") - 1
    none = -np.ones(0, np.int64)
    told1, told2 = np.where(cut1, -1, n1), np.where(cut2, -1, n2)
    i1 = np.flatnonzero(cut1 | (n1 >= least))
    i2 = np.flatnonzero((b[head] != 0) & (cut2 | (n2 >= least)))
    i3 = np.flatnonzero((c != 0) & (n >= least))
    up2, up1 = np.searchsorted(head, i3, "right") - 1, np.searchsorted(first, i3, "right") - 1
    take = lambda codes: [words[i] for i in codes]
    w1 = take(np.concatenate([a[first[i1]], a[head[i2]], a[i3]]))
    w2 = [None] * len(i1) + take(np.concatenate([b[head[i2]], b[i3]]))
    w3 = [None] * (len(i1) + len(i2)) + take(c[i3])
    left1 = np.concatenate([none, np.full(len(i1), -1), told1[of1[i2]], told1[up1]])
    left2 = np.concatenate([none, np.full(len(i1) + len(i2), -1), told2[up2]])
    return {"w1": w1, "w2": w2, "w3": w3, "n": np.concatenate([n1[i1], n2[i2], n[i3]]), "left1": left1, "left2": left2, "cut": np.concatenate([cut1[i1], cut2[i2], np.zeros(len(i3), bool)])}


def _walker(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def merged(lang: str, tries: list) -> pa.RecordBatch:
        words, paths = merge(tries)
        got = walk(words, paths, least)
        total = int(paths[3].sum())
        text = lambda x: pa.array([None, *x], pa.binary()).cast(pa.string())
        seen = lambda x: pa.array(np.concatenate([[-1], x]), mask=np.concatenate([[True], x < 0]))
        k = len(got["n"]) + 1
        return pa.RecordBatch.from_arrays([pa.array([lang] * k), text(got["w1"]), text(got["w2"]), text(got["w3"]), pa.array(np.concatenate([[total], got["n"]])), seen(got["left1"]), seen(got["left2"]), pa.array(np.concatenate([[True], got["cut"]]))], schema=_NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, tries = None, []
        for batch in batches:
            for lang, part, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (lang, part) != unit:
                    if tries:
                        yield merged(unit[0], tries)
                    unit, tries = (lang, part), []
                tries.append(from_bytes(blob))
                if sum(len(p[0]) for _, p in tries[1:]) > RANGE_PATHS:
                    tries = [merge(tries)]
        if tries:
            yield merged(unit[0], tries)

    return run


def boundaries(texts: DataFrame) -> dict[str, list[Boundary]]:
    """Paths that cut each language's trie into ranges of about RANGE_PATHS paths over all shards.

    From a sample of SAMPLE_BYTES of whole texts; it decides where ranges
    end, not what is counted. One boundary for some 10 MB of text reaches
    the driver.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tries: dict[str, list] = {}
    for lang, blob in texts.sample(min(1.0, SAMPLE_BYTES / max(1, total)), 7).coalesce(8).transform(mapped, _sharder({}), SHARD).select("lang", "blob").collect():
        tries.setdefault(lang, []).append(from_bytes(bytes(blob)))
    out = {}
    seen = {lang: merge(x) for lang, x in tries.items()}
    paths = sum(len(p[0]) for _, p in seen.values())
    # A shard has about as many paths as six bytes of its text; more ranges than tasks even out their sizes.
    wanted = max(4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 6 // RANGE_PATHS)
    for lang, (words, p) in seen.items():
        k = max(1, round(wanted * len(p[0]) / max(1, paths)))
        at = sorted({len(p[0]) * i // k for i in range(1, k)} - {0})
        out[lang] = [tuple(words[x[i]] for x in p[:3]) for i in at]
    return out


def count_nodes(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Nodes that occur ``min_count`` times, written: lang, w1, w2, w3, n, left1, left2, cut; and lang, total of all words.

    w3, then w2 are null for shorter phrases; left1 and left2 count the
    first word and the first two, where the walk could tell.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    shards = written(texts.transform(mapped, _sharder(boundaries(texts)), SHARD), "collocations-shards")
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walked = shards.repartition(parts, "lang", "part").sortWithinPartitions("lang", "part").transform(mapped, _walker(min_count), NODES)
    # Only cut nodes come more than once, so this adds up a few rows a range.
    nodes = written(walked.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"), F.max("left1").alias("left1"), F.max("left2").alias("left2"), F.bool_or("cut").alias("cut")).where((F.col("n") >= min_count) | F.col("w1").isNull()), "collocations-nodes")
    return nodes.where("w1 IS NOT NULL"), nodes.where("w1 IS NULL").select("lang", F.col("n").alias("total"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Each language's first phrases of two or three words: lang, rank, phrase, a, l, r, n, score.

    Phrases stay within pieces, which end at [.,;:!?] and line ends; words
    are what blanks and tabs separate, A-Z as a-z. A phrase counts at its
    lowest-scoring cut, the shorter left part on ties; one that stands inside
    a longer candidate with at least half its count is dropped. Null texts
    are empty, a null language is ``und``. Repeated rows count each time;
    texts are read whole, however long; an empty table gives no row; columns
    other than text and lang are not read. Ties of score and count go by the
    phrase's bytes.
    """
    nodes, totals = count_nodes(docs, min_count)
    node = lambda name: nodes.where("w3 IS NULL").select(F.col("lang").alias("k_lang"), F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.col("n").alias(name))
    # Left parts that a range's end hid: few, as only the ends of ranges are cut.
    cut = small_side(written(nodes.where("cut AND w3 IS NULL").select(F.col("lang").alias("k_lang"), F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.col("n").alias("whole")), "collocations-cut"))
    c = nodes.where("w2 IS NOT NULL")
    for left, second in (("left1", F.lit(None)), ("left2", F.col("w2"))):
        c = c.join(cut, (F.col("lang") == F.col("k_lang")) & (F.col("w1") == F.col("k1")) & second.eqNullSafe(F.col("k2")), "left").withColumn(left, F.coalesce(left, "whole")).drop("k_lang", "k1", "k2", "whole")
    two, three = F.col("w3").isNull(), F.col("w3").isNotNull()
    # Suffix links: the phrase without its first word, and the last word.
    single = node("right2").where("k2 IS NULL").drop("k2")
    c = c.join(single, (F.col("lang") == F.col("k_lang")) & (F.coalesce("w3", "w2") == F.col("k1")), "left").drop("k_lang", "k1")
    pair = node("right1").where("k2 IS NOT NULL")
    c = c.join(pair, (F.col("lang") == F.col("k_lang")) & three & (F.col("w2") == F.col("k1")) & (F.col("w3") == F.col("k2")), "left").drop("k_lang", "k1", "k2")
    # Of two words there is one cut, whose right part is the last word.
    c = c.withColumn("right1", F.when(two, F.col("right2")).otherwise(F.col("right1")))
    exact = lambda x: F.col(x).cast("decimal(18,0)")
    c = c.withColumn("square", (exact("n") * exact("n")).cast("decimal(31,0)") * F.lit(SCORE).cast("decimal(7,0)"))
    for k in "12":
        c = c.withColumn(f"parts{k}", (exact(f"left{k}") * exact(f"right{k}")).cast("decimal(38,0)")).withColumn(f"score{k}", F.expr(f"square div parts{k}"))
    second = three & (F.col("score2") < F.col("score1"))
    c = c.select("lang", "w1", "w2", "w3", F.col("n").alias("a"), *[F.when(second, F.col(f"{x}2")).otherwise(F.col(f"{x}1")).alias(y) for x, y in (("left", "l"), ("right", "r"), ("score", "score"))])
    around = c.where("w3 IS NOT NULL").select("lang", F.explode(F.array(F.struct(F.col("w1").alias("k1"), F.col("w2").alias("k2")), F.struct(F.col("w2").alias("k1"), F.col("w3").alias("k2")))).alias("p"), "a")
    around = around.groupBy(F.col("lang").alias("k_lang"), "p.k1", "p.k2").agg(F.max("a").alias("longer"))
    c = c.join(around, (F.col("lang") == F.col("k_lang")) & F.col("w3").isNull() & (F.col("w1") == F.col("k1")) & (F.col("w2") == F.col("k2")), "left")
    c = c.where("longer IS NULL OR 2 * longer < a").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    c = c.select("lang", "phrase", "a", "l", "r", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return c.join(small_side(written(totals.withColumnRenamed("lang", "k_lang"), "collocations-totals")), F.col("lang") == F.col("k_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))

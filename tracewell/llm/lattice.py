"""SentencePiece encoding and decoding through a relational lattice.

The model's piece table is a relation. Words meet it in an equi-join of their
substrings, the matches are the lattice's edges, and a fold over each word's
edges finds the best path.
"""

from __future__ import annotations

import hashlib

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import folded, give_back, mapped, scratch, table, written

BLANK = "▁"
#: A piece table beyond this isn't broadcast.
MAX_PIECES = 1_000_000


@dataclass
class Pieces:
    """The piece table of a SentencePiece model, and where texts can be cut without cutting a piece."""

    rows: list[tuple[str, int, float]]
    byte_base: int
    unknown: float
    longest: int
    text_of: list[bytes] = field(repr=False)
    pairs: frozenset[str] = field(repr=False)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Ordinary pieces with their scores; bytes 0..255 have consecutive ids from ``byte_base``. A character without a piece of its own costs 10 more than the worst piece."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        rows = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        base = sp.piece_to_id("<0x00>")
        if not sp.is_byte(base):
            raise ValueError("the model has no byte pieces")
        text_of = [b""] * n
        for p, i, _ in rows:
            text_of[i] = p.replace(BLANK, " ").encode()
        for b in range(256):
            text_of[base + b] = bytes([b])
        pairs = frozenset(p[k : k + 2] for p, _, _ in rows for k in range(len(p) - 1))
        return cls(rows, base, min(s for _, _, s in rows if s > -1e8) - 10, max(len(p) for p, _, _ in rows), text_of, pairs)


class Cutter:
    """Splits texts into units that no piece crosses, so best paths of units make the best path of the text.

    A cut lies between two characters that stand side by side in no piece.
    Many texts are cut at once, a window of characters at a time: pairs of
    neighbours are looked up in a table for low code points and in a sorted
    list for others.
    """

    LOW = 0x250
    _BLANK = ord(BLANK)

    def __init__(self, pairs: frozenset[str]) -> None:
        # The blank's own code point is high; it borrows a control character that is never within a piece.
        code = lambda c: 1 if c == BLANK else ord(c)
        self.low = np.zeros((self.LOW, self.LOW), dtype=bool)
        high = []
        for p in pairs:
            x, y = map(code, p)
            if max(x, y) < self.LOW:
                self.low[x, y] = True
            else:
                high.append(x << 32 | y)
        if "\x01" in {c for p in pairs for c in p}:
            raise ValueError("a piece holds the character that stands for the blank here")
        self.high = np.sort(np.array(high, dtype=np.int64))

    def units(self, texts: list[str | None]) -> tuple[pa.LargeStringArray, np.ndarray]:
        """All units in order, and the first unit of each text (and the end). A text gets a blank in front, unless it is empty."""
        spelled = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        joined = "".join(spelled)
        edge = np.concatenate([[0], np.cumsum([len(t) for t in spelled], dtype=np.int64)])
        del spelled
        if not joined:
            return pa.array([], pa.large_string()), np.zeros(len(edge), dtype=np.int64)
        starts, offsets, size = [], [], 0
        for k in range(0, len(joined), _WINDOW):
            # The character before a window says whether its first one joins.
            c = np.frombuffer(joined[max(k - 1, 0) : k + _WINDOW].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            joins, lead = self._joins(c), int(k > 0)
            inside = edge[(edge >= k) & (edge < k + len(c) - lead)] - k
            joins[inside + lead] = False
            c, first = c[lead:], np.flatnonzero(~joins[lead:])
            width = (c > 0x7F).view(np.uint8) + (c > 0x7FF).view(np.uint8) + (c > 0xFFFF).view(np.uint8) + np.uint8(1)
            end = np.cumsum(width, dtype=np.int64)
            starts.append(first + k)
            offsets.append(end[first] - width[first] + size)
            size += int(end[-1])
        first = np.concatenate(starts)
        offsets = np.concatenate([*offsets, [size]])
        units = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(joined.encode("utf-8", "surrogatepass")))
        return units, np.searchsorted(first, edge)

    def _joins(self, c: np.ndarray) -> np.ndarray:
        """Whether each character stands beside the one before it in some piece; false for the first."""
        k = np.where(c == 1, np.uint32(self.LOW), c)  # the control character itself never joins
        k[c == self._BLANK] = 1
        near = k < self.LOW
        near = near[1:] & near[:-1]
        x = np.minimum(k, self.LOW - 1)
        joins = np.zeros(len(c), dtype=bool)
        joins[1:] = self.low.ravel()[x[:-1] * np.uint32(self.LOW) + x[1:]] & near
        far = np.flatnonzero(~near)
        if len(far) and len(self.high):
            key = k[far].astype(np.int64) << 32 | k[far + 1]
            at = np.minimum(np.searchsorted(self.high, key), len(self.high) - 1)
            joins[far + 1] = self.high[at] == key
        return joins


#: Characters cut at once, which bounds the arrays that a very long text needs.
_WINDOW = 1 << 18
#: Texts cut together.
_ROWS = 250


def _distinct(pairs: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.schema([("block", pa.string()), ("unit", pa.large_string())])

    def rows(block: str, parts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        units = pc.unique(pa.concat_arrays(parts))
        for k in range(0, len(units), 50_000):
            some = units.slice(k, 50_000)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(some)), some.cast(pa.string())], names=kind.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(pairs)
        held, parts, fresh = None, [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                blocks, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                edges = [0, *(i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1]), len(blocks)]
                for s, e in zip(edges, edges[1:], strict=False):
                    if blocks[s] != held:
                        if parts:
                            yield from rows(held, parts)
                        held, parts, fresh = blocks[s], [], 0
                    parts.append(pc.unique(cut.units(texts[s:e])[0]))
                    fresh += len(parts[-1])
                    if fresh > 300_000:
                        parts, fresh = [pc.unique(pa.concat_arrays(parts))], 0
                        give_back()
        if parts:
            yield from rows(held, parts)

    return run


def best_paths(units: DataFrame, pieces: Pieces) -> DataFrame:
    """``ids`` (array<int>) besides the columns of ``units``, whose ``unit`` is distinct and not empty.

    The path with the greatest sum of scores; of equal ones that whose last
    piece is longest. All substrings up to the longest piece are joined to the
    piece table; characters without a piece get their UTF-8 bytes. Grouping
    by unit needs no shuffle where ``units`` is dealt by unit already. Units
    beyond LONG characters go another way, see _long_units().
    """
    known = _piece_table(units.sparkSession, pieces)
    units = units.withColumn("len", F.char_length("unit"))
    return _short_units(units, known, pieces).unionAll(_long_units(units, known, pieces)).drop("len")


def _short_units(units: DataFrame, known: DataFrame, pieces: Pieces) -> DataFrame:
    """``ids`` of the units up to LONG characters (``len``): one row of edges a unit."""
    own = units.columns
    starts = units.where(f"len BETWEEN 1 AND {LONG}").select(*own, F.expr("explode(sequence(1, len))").alias("s"))
    spans = starts.select(*own, "s", F.expr(f"explode(sequence(s, least(s + {pieces.longest - 1}, len)))").alias("e"))
    subs = spans.select(*own, "e", F.expr("e - s + 1").alias("n"), F.expr("substring(unit, s, e - s + 1)").alias("piece"))
    edges = subs.withColumn("h", F.xxhash64("piece")).join(known, "h", "left").where("n = 1 OR piece = known")
    edge = F.expr(f"IF(piece <=> known, struct(e, n, id, score), struct(e, n, -ascii(piece) - 1 AS id, {pieces.unknown!r}D AS score))")
    grouped = edges.groupBy(*own).agg(F.collect_list(edge).alias("edges"))
    paths = grouped.select(*own, F.expr(f"IF(len <= {_SHORT}, {_short_path()}, {_long_path(pieces.longest)})").alias("ids"))
    return paths.select(*own, F.expr(_spelled(pieces.byte_base)).alias("ids"))


def _piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """Joined by a hash of the substring, as numbers probe faster, and then by the substring itself."""
    if len(pieces.rows) > MAX_PIECES:
        raise ValueError("the piece table is too large to broadcast")
    p, i, x = zip(*pieces.rows, strict=True)
    known = spark.createDataFrame(pa.table({"known": pa.array(p), "id": pa.array(i, pa.int32()), "score": pa.array(x, pa.float64())}))
    return F.broadcast(known.withColumn("h", F.xxhash64("known")))


#: Units up to this long carry themselves through the join.
LONG = 256
#: Characters of a long unit that go together; the outer pieces bound how far into a string the inner ones must be sought.
_OUTER, _INNER = 1 << 16, 256


def _long_units(units: DataFrame, known: DataFrame, pieces: Pieces) -> DataFrame:
    """``ids`` of long units, in time about proportional to their length.

    Rows carry a hash of the unit and a stretch of it, not the unit. After
    the join a unit falls apart wherever no piece of it lies across; each of
    these segments is folded by itself, and their ids are put together in
    order. What a row of edges holds is so bounded by the longest run of
    pieces that overlap, which is the whole unit only where one character or
    pattern repeats all along.
    """
    own, over = units.columns, pieces.longest - 1
    # All columns take part in the hash, so every branch needs the same ones and may share the exchange below.
    named = units.where(f"len > {LONG}").select(*own, F.sha2(F.concat_ws(" ", *own).cast("binary"), 256).alias("key"))
    cut = lambda text, n, size: f"explode(transform(sequence(0, ({n} - 1) div {size}), c -> named_struct('at', int(c * {size}), 'text', substring({text}, int(c * {size} + 1), {size + over}))))"
    outer = named.select("key", "len", F.expr(cut("unit", "len", _OUTER)).alias("o")).select("key", F.col("o.at").alias("base"), "o.text", F.expr(f"least({_OUTER}, len - o.at)").alias("own"))
    # ``own`` of the characters are starts; what follows belongs to the next stretch.
    inner = outer.select("key", "base", "own", F.expr(cut("text", "own", _INNER)).alias("i")).select("key", F.expr("base + i.at").alias("base"), "i.text", F.expr(f"least({_INNER}, own - i.at)").alias("own"))
    starts = inner.select("key", "base", "text", F.expr("explode(sequence(1, own))").alias("s"))
    spans = starts.select("key", "base", "text", "s", F.expr(f"explode(sequence(s, least(s + {over}, char_length(text))))").alias("e"))
    subs = spans.select("key", F.expr("e + base").alias("e"), F.expr("e - s + 1").alias("n"), F.expr("substring(text, s, e - s + 1)").alias("piece"))
    edges = subs.withColumn("h", F.xxhash64("piece")).join(known, "h", "left").where("n = 1 OR piece = known")
    edges = edges.select("key", "e", "n", F.expr("IF(piece <=> known, id, -ascii(piece) - 1)").alias("id"), F.expr(f"IF(piece <=> known, score, {pieces.unknown!r}D)").alias("score"))
    # A segment begins where no edge from further left ends later.
    order = Window.partitionBy("key").orderBy(F.expr("e - n"), "n")
    reach = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.withColumn("head", F.when(F.expr("e - n") >= reach, F.expr("e - n")))
    edges = edges.withColumn("head", F.max("head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = edges.groupBy("key", "head").agg(F.collect_list(F.expr("struct(e - head AS e, n, id, score)")).alias("edges")).withColumn("len", F.expr("array_max(transform(edges, x -> x.e))"))
    paths = grouped.select("key", "head", F.expr(f"IF(len <= {_SHORT}, {_short_path()}, {_long_path(pieces.longest)})").alias("ids"))
    whole = paths.groupBy("key").agg(F.expr("flatten(transform(sort_array(collect_list(struct(head, ids))), x -> x.ids))").alias("ids"))
    return named.join(whole, "key").select(*own, F.expr(_spelled(pieces.byte_base)).alias("ids"))


#: Units up to this long take the simple fold, whose work grows with the square of their length.
_SHORT = 64


def _short_path() -> str:
    """SQL: each end's best score, last piece and ids, from those of the ends before it."""
    start = "array(named_struct('b', 0D, 'n', 0, 'ids', CAST(array() AS array<int>)))"
    way = "named_struct('b', s[i - x.n].b + x.score, 'n', x.n, 'ids', concat(s[i - x.n].ids, array(x.id)))"
    return f"aggregate(sequence(1, len), {start}, (s, i) -> concat(s, array(array_max(transform(filter(edges, x -> x.e = i), x -> {way})))), s -> s[len].ids)"


def _long_path(m: int) -> str:
    """SQL: the same over sorted edges, with the last ``m`` scores and back pointers in blocks, so work is in proportion to the length."""
    back, zero = "array<struct<n:int,id:int>>", "named_struct('n', 0, 'id', 0)"
    # e: end of the edges at hand; b, p: their best score and edge; win: scores of the ends before e; cur, done: edges chosen for earlier ends.
    start = f"named_struct('e', 0, 'b', 0D, 'p', {zero}, 'win', CAST(array() AS array<double>), 'cur', CAST(array() AS {back}), 'done', CAST(array() AS array<{back}>))"
    pick = "named_struct('n', x.n, 'id', x.id)"
    win = f"slice(concat(array(s.b), s.win), 1, {m})"
    full = "size(s.cur) >= 255"
    moved = f"named_struct('e', x.e, 'b', IF(x.n = 1, s.b, s.win[x.n - 2]) + x.score, 'p', {pick}, 'win', {win}, 'cur', IF({full}, CAST(array() AS {back}), concat(s.cur, array(s.p))), 'done', IF({full}, concat(s.done, array(concat(s.cur, array(s.p)))), s.done))"
    better = f"named_struct('e', s.e, 'b', s.win[x.n - 1] + x.score, 'p', {pick}, 'win', s.win, 'cur', s.cur, 'done', s.done)"
    chosen = f"aggregate(sort_array(edges), {start}, (s, x) -> IF(x.e > s.e, {moved}, IF(s.win[x.n - 1] + x.score >= s.b, {better}, s)), s -> concat(flatten(s.done), s.cur, array(s.p)))"
    at = "back[len - i + 1]"
    walk = folded("len", "len", f"IF(len - i + 1 = s.k, s.k - {at}.n, s.k)", f"IF(len - i + 1 = s.k, array({at}.id), CAST(array() AS array<int>))", "array<int>")
    # One element, so that the edges are folded once.
    return f"transform(array({chosen}), back -> flatten(reverse({walk})))[0]"


def _spelled(base: int) -> str:
    """SQL: ids with characters that have no piece, kept as -code - 1, written as the ids of their UTF-8 bytes."""
    c = "(-i - 1)"
    more = lambda k: f"{base} + 128 + ((shiftright({c}, {6 * k})) & 63)"
    raw = f"CASE WHEN {c} < 128 THEN array({base} + {c}) WHEN {c} < 2048 THEN array({base} + 192 + shiftright({c}, 6), {more(0)}) WHEN {c} < 65536 THEN array({base} + 224 + shiftright({c}, 12), {more(1)}, {more(0)}) ELSE array({base} + 240 + shiftright({c}, 18), {more(2)}, {more(1)}, {more(0)}) END"
    return f"IF(exists(ids, i -> i < 0), flatten(transform(ids, i -> IF(i >= 0, array(i), {raw}))), ids)"


_BLOCK = "concat(input_file_name(), '#', input_file_block_start())"


def _filed(docs: DataFrame) -> DataFrame:
    """``docs`` as rows that come straight from files, so that each has a block to be known by."""
    return docs if docs.inputFiles() and "Exchange" not in docs._jdf.queryExecution().executedPlan().toString() else written(docs, "lattice-docs")


def _block_paths(folder: str, block: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Units of one block, where the ids of each begin (and the end), and all ids; none of a block that the first scan didn't have."""
    store, root = pafs.FileSystem.from_uri(folder)
    at = f"{root}/block={hashlib.md5(block.encode()).hexdigest()}"
    if store.get_file_info(at).type == pafs.FileType.NotFound:
        return pa.array([], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, "<u4")
    got = pads.dataset(at, filesystem=store, format="parquet").to_table(columns=["unit", "ids"]).combine_chunks()
    ids = got.column("ids").combine_chunks()
    return got.column("unit").combine_chunks().cast(pa.large_string()), ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy().astype("<u4")


def one_path(unit: str, known: dict[str, tuple[int, float]], longest: int, unknown: float, base: int) -> list[int]:
    """Ids of one unit's best path, as best_paths finds it, for units that no table of paths has."""
    best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]
    for e in range(1, len(unit) + 1):
        top = (-float("inf"), 0, [])
        for n in range(1, min(longest, e) + 1):
            piece = unit[e - n : e]
            found = known.get(piece)
            if found is None and n > 1:
                continue
            ids, score = ([found[0]], found[1]) if found else ([base + b for b in piece.encode("utf-8", "surrogatepass")], unknown)
            if best[e - n][0] + score >= top[0]:
                top = (best[e - n][0] + score, n, ids)
        best.append(top)
    out, e = [], len(unit)
    while e:
        out.append(best[e][2])
        e -= best[e][1]
    return [i for ids in reversed(out) for i in ids]


def _encoder(pieces: Pieces, folder: str, at: int, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(pieces.pairs)
        held, paths, known = None, None, {}

        def completed(asked: pa.Array, paths: tuple[pa.Array, np.ndarray, np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            """``paths`` with those of units that it lacks: where files were split otherwise when their units were gathered."""
            own, begin, flat = paths
            lacking = asked.filter(pc.invert(pc.is_in(asked, value_set=own)))
            if not len(lacking):
                return paths
            if not known:
                known.update({p: (i, x) for p, i, x in pieces.rows})
            lacking = pc.unique(lacking)
            new = [np.array(one_path(u, known, pieces.longest, pieces.unknown, pieces.byte_base), "<u4") for u in lacking.to_pylist()]
            return pa.concat_arrays([own, lacking]), np.concatenate([begin, begin[-1] + np.cumsum([len(x) for x in new])]), np.concatenate([flat, *new])

        def coded(block: str, texts: list[str | None]) -> list[bytes]:
            nonlocal held, paths
            cuts = [cut.units(texts[k : k + _ROWS]) for k in range(0, len(texts), _ROWS)]
            coded_units = [(u.dictionary_encode(), first) for u, first in cuts]
            del cuts
            if not any(len(u) for u, _ in coded_units):
                return [b""] * len(texts)
            if block != held:
                paths = None
                held, paths = block, _block_paths(folder, block)
            asked = pa.concat_arrays([u.dictionary for u, _ in coded_units])
            paths = completed(asked, paths)
            own, begin, flat = paths
            where = pc.index_in(asked, value_set=own).to_numpy(zero_copy_only=False).astype(np.int64)
            out, at = [], 0
            for units, first in coded_units:
                c = where[at : at + len(units.dictionary)][units.indices.to_numpy()]
                at += len(units.dictionary)
                n = begin[c + 1] - begin[c]
                end = np.cumsum(n)
                ids = flat[np.repeat(begin[c] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
                edge = np.concatenate([[0], end])[first].tolist()
                out += [ids[s:e].tobytes() for s, e in zip(edge, edge[1:], strict=False)]
            give_back()
            return out

        for batch in batches:
            for k in range(0, batch.num_rows, 4 * _ROWS):
                part, out = batch.slice(k, 4 * _ROWS), []
                blocks, texts = part.column(0).to_pylist(), part.column(at).to_pylist()
                edges = [0, *(i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1]), len(blocks)]
                for s, e in zip(edges, edges[1:], strict=False):
                    out += coded(blocks[s], texts[s:e])
                done = pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(out, pa.binary())], names=[*part.schema.names[1:], "token_ids"])
                yield then(done) if then else done

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", then: tuple[str, Callable[[pa.RecordBatch], pa.RecordBatch]] | None = None) -> DataFrame:
    """All columns of ``docs`` and ``token_ids``: little-endian 32-bit ids as one binary value.

    ``then``, a schema and a function, turns each encoded batch into another
    one within the same Python worker.

    Each file block's distinct units go to the lattice once for all blocks
    that have them; their paths come back in one folder a block, which the
    block's rows then look up. Should the files be split otherwise when they
    are read again, as other executors or settings may have it, the units that
    a block's folder lacks are folded where they are needed. Null and empty
    texts have no ids; repeated rows are encoded alike; a column named
    token_ids is replaced; an empty table stays empty; a very long text is
    cut in windows.
    """
    spark = docs.sparkSession
    pieces = Pieces.load(path)
    docs = _filed(docs.drop("token_ids"))
    folder = scratch(spark, "lattice")
    found = docs.select(F.expr(_BLOCK).alias("block"), F.col(text_col).alias("text")).transform(mapped, _distinct(pieces.pairs), "block string, unit string")
    dealt = found.select("unit", F.md5("block").alias("block")).where("unit IS NOT NULL").repartition("unit")
    # The hash of a block is asked for so that both sides need the same columns and one exchange serves them; the length is an aggregate so that no filter on it goes below that exchange.
    units = dealt.groupBy("unit").agg(F.max(F.xxhash64("block")).alias("some"), F.max(F.char_length("unit")).alias("len"))
    known = _piece_table(spark, pieces)
    found = [dealt.join(_short_units(units, known, pieces).hint("shuffle_hash"), "unit"), dealt.join(_long_units(units, known, pieces), "unit")]
    answers = found[0].unionAll(found[1]).where("some IS NOT NULL").select("block", "unit", "ids").repartition("block")
    answers.write.partitionBy("block").option("compression", "zstd").parquet(folder)
    kept = docs.select(F.expr(_BLOCK).alias("__block"), *docs.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out, finish = then or (f"{schema}, token_ids binary", None)
    return kept.transform(mapped, _encoder(pieces, folder, 1 + docs.columns.index(text_col), finish), out)


def decode_ids(ids: bytes, pieces: Pieces) -> str:
    """The text of little-endian 32-bit ids, without the blank that encoding put in front."""
    raw = b"".join(map(pieces.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return raw[1:].decode("utf-8", "surrogatepass")


def _digests(pieces: Pieces) -> tuple[str, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, text, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            ids = ids.as_py()
            back = decode_ids(ids, pieces)
            rows.append((key, len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (text.as_py() or "").replace(BLANK, " ")))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(kind)], schema=kind)

    return "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean", run


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, then=_digests(Pieces.load(path)))

"""Token ids in byte-aligned variable-length coding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import mapped, scratch, table

#: Pieces whose ids a worker remembers.
CACHE = 1_200_000
END_ID = 2
#: A shard holds about so many ids at most.
SHARD_IDS = 1 << 27
#: Bytes of texts encoded together, about: more find more equal pieces, and hold more memory.
_BYTES = 12 << 20

_COUNTS = pa.schema([("id", pa.int64()), ("n", pa.int64())])
FILE = "shard int, doc_id long, tie long, n_tokens long, control binary, data binary"
_FILE = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])


#: Texts with any of these, or with an added token, go through the library whole: white space at an
#: end or beside a blank, white space other than blank, tab and line ends, and
#: the marks that pieces use.
_WHOLE = r"^[ \t\n\f\r]|[ \t\n\f\r]\z|[ \t\n\f\r] | [\t\n\f\r]|[\x01\x02\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FIRST, _CUT = "\x01", "\x02"
#: The public byte-level pattern, in terms that re knows, for pieces of plain characters only.
_PRETOKENS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\x00-\x7f\xc0-\u017f]*")
#: Pieces that are one pre-token: letters, with or without a blank before them. For Arrow.
_SINGLE = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}]+\z"


def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level models write bytes: printable ones stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class PieceTokenizer:
    """A byte-level BPE tokenizer that encodes each distinct piece of a batch once.

    The model's pre-tokenizer never joins the text before a blank to what
    follows it, unless white space touches the blank on either side; nor a
    letter to a full stop or comma, either of these to a line end, or a line
    end to a letter. So a text falls into pieces at these places, and equal
    pieces have equal ids. Arrow cuts the texts and finds the distinct
    pieces; the library encodes those that the worker doesn't remember, split
    into pre-tokens; numpy puts the ids together. Other texts go through the
    library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # The model's added tokens are found in raw text, so texts that hold one aren't cut.
        self.uncut = "|".join([_WHOLE, *(re.escape(t.content) for t in self.model.get_added_tokens_decoder().values())])
        self.bare = Tokenizer(self.model.model)
        self.size = max(self.model.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _learn(self, pieces: list[str], single: list[bool]) -> None:
        """Encode pieces; ``single`` says which are one pre-token as they stand."""
        plain, parts, counts = [], [], []
        for c, one in zip(pieces, single, strict=True):
            if one:
                plain.append(c)
                counts.append(1)
                parts.append(c)
                continue
            text = c[1:] if c.startswith(_FIRST) else c
            if _PLAIN.fullmatch(text):
                got = _PRETOKENS.findall(text)
                plain.append(c)
                counts.append(len(got))
                parts += got
            else:
                self.new[c] = self._whole(text)
        if plain:
            spelled = _CUT.join(parts).encode().decode("latin-1").translate(self.letters).split(chr(self.letters[ord(_CUT)]))
            got = self.bare.encode(spelled, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, dtype=self.dtype)
            ends = np.searchsorted(np.array(got.word_ids, dtype=np.int64), np.cumsum(counts)).tolist()
            raw, width, at = ids.tobytes(), self.dtype.itemsize, 0
            for c, e in zip(plain, ends, strict=True):
                self.new[c] = raw[at * width : e * width]
                at = e

    def _of(self, distinct: pa.Array) -> list[bytes]:
        """The ids of each distinct piece. What hasn't been seen for CACHE / 2 new pieces is forgotten."""
        if len(self.new) > CACHE // 2:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        # By way of numpy, as to_pylist makes a scalar of each value first.
        pieces = distinct.to_numpy(zero_copy_only=False).tolist()
        got = list(map(new.get, pieces))
        missing = []
        for i in [i for i, x in enumerate(got) if x is None]:
            c = pieces[i]
            if (x := old.get(c)) is None:
                missing.append(i)
            else:
                got[i] = new[c] = x
        if missing:
            single = pc.match_substring_regex(distinct.take(pa.array(missing)), _SINGLE).to_pylist()
            for k in range(0, len(missing), 50_000):
                self._learn([pieces[i] for i in missing[k : k + 50_000]], single[k : k + 50_000])
            for i in missing:
                got[i] = new[pieces[i]]
        return got

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (null: none), as little-endian bytes."""
        kind = pa.large_string()
        texts = pc.fill_null(texts.cast(kind), "")
        whole = pc.or_(pc.match_substring_regex(texts, self.uncut), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(whole).tolist():
            if text := texts[i].as_py():
                out[i] = self._whole(text)
        rows = np.flatnonzero(~whole)
        if not len(rows):
            return out
        # The first piece of a text, which has no blank before it, is marked, so that it equals no other.
        cut = pc.binary_join_element_wise(pa.scalar(_FIRST, kind), texts.take(pa.array(rows)), pa.scalar("", kind))
        cut = pc.replace_substring(cut, " ", f"{_CUT} ")
        cut = pc.replace_substring_regex(cut, r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}])([.,])", f"\\1{_CUT}\\2")
        cut = pc.replace_substring_regex(cut, r"([.,])\n([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}])", f"\\1{_CUT}\n{_CUT}\\2")
        lists = pc.split_pattern(cut, _CUT)
        first = lists.offsets.to_numpy()
        distinct = lists.flatten().dictionary_encode()
        code = distinct.indices.to_numpy()
        got = self._of(distinct.dictionary)
        width = self.dtype.itemsize
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // width
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(got), dtype=self.dtype)
        k = 0
        while k < len(rows):  # about a million ids at a time
            e = max(k + 1, int(np.searchsorted(first, first[k] + 300_000, side="right")) - 1)
            c = code[first[k] : first[e]]
            n = size[c]
            end = np.cumsum(n)
            ids = flat[np.repeat(start[c] - (end - n), n) + np.arange(end[-1])]
            edge = np.concatenate([[0], end])[first[k : e + 1] - first[k]].tolist()
            for i, a, b in zip(rows[k:e].tolist(), edge, edge[1:], strict=False):
                out[i] = ids[a:b].tobytes()
            k = e
        return out


_held: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer a worker process and file."""
    if path not in _held:
        _held[path] = PieceTokenizer(path)
    return _held[path]


#: For each two-bit code which of a number's four bytes are kept.
_KEEP = np.tri(4, dtype=bool)
#: For each control byte the four byte counts.
_COUNT = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Unsigned 32-bit numbers as control bytes (four two-bit byte counts each) and data bytes."""
    r = numbers.astype("<u4")
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    four = np.zeros(-(-len(r) // 4) * 4, dtype=np.uint8)
    four[: len(r)] = code
    control = four[0::4] | four[1::4] << 2 | four[2::4] << 4 | four[3::4] << 6
    if code.max(initial=0) <= 1:  # at most two bytes each, so half as many need be looked at
        keep = np.ones((len(r), 2), dtype=bool)
        keep[:, 1] = code
        return control.tobytes(), r.astype("<u2").view(np.uint8)[keep.ravel()].tobytes()
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[_KEEP[code]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers that pack() wrote: a table gives each control byte's four byte counts."""
    width = _COUNT[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    at = np.cumsum(width) - width
    if n and at[-1] + width[-1] != len(data):
        raise ValueError("control and data bytes don't fit")
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, int(width.max(initial=1))):
        more = np.flatnonzero(width > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


RAW = "doc_id long, tie long, n_tokens long, ids binary"
_RAW = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, where they came in smaller ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _tokenizer(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        end = np.array([end_id], dtype=t.dtype).tobytes()
        for batch in _together(batches, _BYTES):
            if batch.num_rows:
                ids = [x + end for x in t.encode(batch.column(2))]
                n = [len(x) // t.dtype.itemsize for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, type=pa.int64()), pa.array(ids, type=pa.binary())], schema=_RAW)

    return run


def _counter(dtype: np.dtype, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                flat = b"".join(batch.column(0).to_pylist())
                total += np.bincount(np.frombuffer(flat, dtype=dtype), minlength=size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], schema=_COUNTS)

    return run


def _encoder(dtype: np.dtype, rank: np.ndarray, bounds: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                keys = part.column(0).to_pylist()
                # A null id goes to the first shard, where it sorts first.
                shard = np.searchsorted(bounds, [bounds[0] if x is None else x for x in keys]).tolist() if len(bounds) else [0] * len(keys)
                yield _rows([(s, i, tie, n, *pack(rank[np.frombuffer(x.as_buffer(), dtype=dtype)])) for s, i, tie, n, x in zip(shard, keys, part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3), strict=True)], _FILE)

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize whole texts and write the token files below ``folder``.

    ``folder``/raw has the plain ids, as tokenizing is by far the dearest
    step. ``folder``/ranks maps ranks to ids, the most frequent id first (ties
    by id), by counts over all documents; the vocabulary bounds it.
    ``folder``/ids holds a row for each document in ascending id order (by
    ``shard``, then within its file): control and data bytes of its ranks,
    ``end_id`` last. Shards are ranges of ids of about equal counts. Null
    texts have the end id only; null ids come first; rows of equal id are
    ordered by their text's hash. Texts are encoded whole, however long; an
    empty table gives empty files; other columns are not read.
    """
    spark = docs.sparkSession
    t = tokenizer(path)
    size = max(t.size, end_id + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    rows.transform(mapped, _tokenizer(path, end_id), RAW).write.option("compression", "zstd").parquet(f"{folder}/raw")
    raw = spark.read.schema(RAW).parquet(f"{folder}/raw")
    counts = raw.select("ids").transform(mapped, _counter(t.dtype, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).select("rank", "id", "n").write.parquet(f"{folder}/ranks")
    rank = np.zeros(size, dtype=np.uint32)
    ids_of = _ids_of(spark, folder)
    rank[ids_of] = np.arange(len(ids_of))
    total = raw.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_IDS))
    cuts = [(i + 1) / parts for i in range(parts - 1)]
    bounds = raw.agg(F.percentile_approx("doc_id", cuts, 100 * parts).alias("b")).first()["b"] if cuts else []
    coded = raw.transform(mapped, _encoder(t.dtype, rank, np.array(bounds or [], dtype=np.int64)), FILE)
    coded.repartitionById(parts, "shard").sortWithinPartitions("shard", "doc_id", "tie").write.parquet(f"{folder}/ids")


def _decoder(ids_of: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(ids_of[unpack(c.as_py(), d.as_py(), n)]) for c, d, n in zip(batch.column(4), batch.column(5), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, type=pa.int64())], schema=kind)

    return run


def _ids_of(spark: SparkSession, folder: str) -> np.ndarray:
    ranks = spark.read.schema("rank int, id long, n long").parquet(f"{folder}/ranks").toPandas()
    out = np.zeros(len(ranks), dtype="<u4")
    out[ranks["rank"]] = ranks["id"]
    return out


def _lister(ids_of: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [ids_of[unpack(c.as_py(), d.as_py(), n)].astype(np.int64) for c, d, n in zip(batch.column(4), batch.column(5), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, type=pa.list_(pa.int64()))], schema=kind)

    return run


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array, end id included) from the token files."""
    return spark.read.schema(FILE).parquet(f"{folder}/ids").transform(mapped, _lister(_ids_of(spark, folder)), "doc_id long, ids array<long>")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: ``start`` (ids before it), ``n_tokens``, ``ids_crc32``.

    Running sums stay within a shard; a shard's own start comes from one row
    a shard.
    """
    rows = spark.read.schema(FILE).parquet(f"{folder}/ids").transform(mapped, _decoder(_ids_of(spark, folder)), "shard int, doc_id long, tie long, n_tokens long, ids_crc32 long")
    sizes = spark.read.schema(FILE).parquet(f"{folder}/ids").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    first = sizes.select(F.col("shard").alias("of"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    inside = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return rows.join(first, F.col("shard") == F.col("of")).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "token-ids")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(spark, folder)

"""Media columns: lossless PNG in binary columns and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import mapped, table, written

#: 64 pixels of three 8-bit samples: one row of the image holds this many bytes.
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
#: The eight bytes that open every PNG stream.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel of each PNG colour type at 8 bits.
_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
_FLUSH_BYTES = 8 << 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, padded by spaces to a positive multiple of a row; and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % ROW or (0 if raw else ROW)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """An RGB image, 64 pixels wide, whose samples are the payload.

    A row equal to the one above is stored by the filter Up (all zeros), any
    other unfiltered, which suits text best.
    """
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    out = np.zeros((len(rows), ROW + 1), dtype=np.uint8)
    out[:, 1:] = rows
    same = np.flatnonzero((rows[1:] == rows[:-1]).all(axis=1)) + 1
    out[same, 0], out[same, 1:] = 2, 0
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(out, level)) + _chunk(b"IEND", b"")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Undo PNG's five row filters. lines: a filter byte and the filtered samples in each row.

    Runs of rows with one filter go at once: Sub is a running sum along the
    row, Up one down the rows, both modulo 256. Average and Paeth depend on
    the pixel before and go pixel by pixel.
    """
    kinds, data = lines[:, 0], lines[:, 1:]
    out = np.empty_like(data)
    above = np.zeros(data.shape[1], dtype=np.uint8)
    edges = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
    for s, e in zip(edges, edges[1:], strict=False):
        kind, block = kinds[s], data[s:e]
        if kind == 0:
            out[s:e] = block
        elif kind == 1:
            out[s:e] = np.cumsum(block.reshape(e - s, -1, step), axis=1, dtype=np.uint8).reshape(e - s, -1)
        elif kind == 2:
            out[s:e] = np.cumsum(block, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for y in range(s, e):
                up = above.astype(np.int16).reshape(-1, step)
                line, left, corner = data[y].astype(np.int16).reshape(-1, step), np.zeros(step, np.int16), np.zeros(step, np.int16)
                for x in range(len(up)):
                    guess = (left + up[x]) // 2 if kind == 3 else _paeth(left, up[x], corner)
                    left, corner = (line[x] + guess) & 255, up[x]
                    out[y, x * step : x * step + step] = left
                above = out[y]
        else:
            raise ValueError(f"unknown PNG filter {kind}")
        above = out[e - 1]
    return out


def decode_png(stored: bytes) -> np.ndarray:
    """The samples of an 8-bit PNG as (height, width * samples); ValueError if a checksum or a length is wrong."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, body, ended = 8, None, [], False
    while at < len(stored):
        (n,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        data, crc = stored[at + 8 : at + 8 + n], stored[at + 8 + n : at + 12 + n]
        if len(crc) != 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + data):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended |= kind == b"IEND"
        at += 12 + n
    if header is None or not ended or header[2] != 8 or header[3] not in _SAMPLES or header[6]:
        raise ValueError("not a whole 8-bit PNG without interlacing")
    step = _SAMPLES[header[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    if len(raw) != header[1] * (header[0] * step + 1):
        raise ValueError("wrong number of samples")
    return unfilter(raw.reshape(header[1], -1), step)


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n) + 0.5) * np.arange(k)[:, None] / n)


_SIDE, _LOW = 32, 8
_DCT = _cosines(_SIDE, _LOW)


def cosine_hash(samples: np.ndarray, channels: int = CHANNELS) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine coefficients of the grey image, averaged to 32 x 32, exceed their median."""
    grey = samples.reshape(len(samples), -1, channels).mean(axis=2)
    for _ in range(2):  # area means down the rows, then, transposed, along them
        total = np.concatenate([np.zeros((1, grey.shape[1])), np.cumsum(grey, axis=0)])
        at = np.linspace(0, len(grey), _SIDE + 1)
        low = np.minimum(at.astype(int), len(grey) - 1)
        grey = (np.diff(total[low] + (at - low)[:, None] * (total[low + 1] - total[low]), axis=0) * (_SIDE / len(grey))).T
    c = np.round(_DCT @ grey @ _DCT.T, 4).ravel()
    return np.packbits(c > np.median(c[1:])).tobytes().hex()


def _parts(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_STORED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_READ = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            payload, n = payload_of(text.as_py())
            rows.append((key, n, encode_png(payload)))
            held += len(rows[-1][2])
            if held > _FLUSH_BYTES:
                yield _parts(list(zip(*rows, strict=True)), _STORED)
                rows, held = [], 0
        if rows:
            yield _parts(list(zip(*rows, strict=True)), _STORED)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, n, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            media = cell.as_py()
            samples = decode_png(media)
            payload = samples.tobytes()
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)))
        if rows:
            yield _parts(list(zip(*rows, strict=True)), _READ)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id``, ``n_bytes``, ``media``: each text as one PNG.

    A null text is stored as an empty one, 192 blanks; a very long one is one
    tall image; repeated rows and ids give a row each, equal texts equal
    bytes; an empty table stays empty; other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).transform(mapped, _encode, "id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What reading each PNG back gives: payload size and digests, the stored form's size and digest, and the cosine hash as ``feature``."""
    return media.select("id", "n_bytes", "media").transform(mapped, _features, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(to_media(table(spark, sf_dir, "documents")), "media")
    return media_features(stored).withColumnRenamed("id", "doc_id")

"""WARC archives: index first, then coalesced byte-range reads."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import mapped, scratch, table

#: Payloads below this many bytes are never made revisits.
MIN_REVISIT = 100
#: Reads join ranges that are at most GAP apart, up to READ bytes; SPAN bytes of a file are one unit of work.
GAP, READ, SPAN = 64 << 10, 8 << 20, 64 << 20
#: Bytes that a task reads about, where there are more stretches than shuffle partitions.
TASK = 1 << 30
#: A new archive begins beyond this size.
ARCHIVE = 1 << 30
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
READ_BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_READ_BACK = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _urn(page_id: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id)).urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own, as .warc.gz files have them.

    A revisit holds the HTTP header only; the page's number, the number that
    it refers to and the payload's length travel in extension fields.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id) if page_id is not None else f"<urn:sha256:{digest}>"), ("WARC-Date", _DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else url))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body))), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (of a revisit: empty) of one record; ValueError if it is damaged."""
    raw = zlib.decompress(member, 31)
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not mark or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("wrong record length")
    return fields, body.partition(b"\r\n\r\n")[2]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns)), strict=True):
                    if out is None or at > ARCHIVE:
                        if out is not None:
                            out.close()
                        # A name for each attempt: a task that runs again leaves no half-read file in the index.
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data = record(page_id, url, (html.as_py() or "").encode("utf-8", "surrogatepass"), digest, refers_to)
                    out.write(data)
                    rows.append((name, at, len(data), page_id, url, digest, "response" if refers_to is None else "revisit", refers_to))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write each row of ``pages`` (page_id, url, html) as a record below ``folder`` and return the index, read back from ``folder``/index.

    Of records with equal payloads of at least 100 bytes, the one with the
    least page_id is a response and the others revisit it; smaller ones are
    all responses, and so are rows that share that least page_id. Null html
    is an empty payload; a null url or page_id leaves its field out; where
    all ids of equal payloads are null, all are responses. Every url, however
    frequent, is spread with its payload. A payload is compressed in one
    piece, so a very long one needs its own size a few times. An empty table
    gives an empty index; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    spark = pages.sparkSession
    copies = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies.write.parquet(f"{folder}/copies")
    copies = spark.read.schema("digest string, first long").parquet(f"{folder}/copies")
    marked = rows.join(copies, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))
    marked.transform(mapped, _writer(f"{folder}/archives"), INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) ranges joined into reads: start, end, number of ranges in it."""
    out: list[list[int]] = []
    for at, n in ranges:
        if out and at - out[-1][1] <= GAP and at + n - out[-1][0] <= READ:
            out[-1][1], out[-1][2] = max(out[-1][1], at + n), out[-1][2] + 1
        else:
            out.append([at, at + n, 1])
    return [tuple(x) for x in out]


def _reader(folder: str, each: Callable[[dict[str, str], bytes], tuple], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for name, at, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                by_file.setdefault(name, []).append((at, n))
            for name, ranges in by_file.items():
                with store.open_input_file(f"{root}/{name}") as f:
                    k = 0
                    for start, end, count in coalesced(ranges):
                        data = f.read_at(end - start, start)
                        rows = [each(*parse(data[at - start : at - start + n])) for at, n in ranges[k : k + count]]
                        k += count
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=x.type) for c, x in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _summary(fields: dict[str, str], payload: bytes) -> tuple:
    digest, kind, n = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"], int(fields["X-Payload-Length"])
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload doesn't match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-Id"), n, digest, kind, number("X-Refers-To-Page")


def read_records(index: DataFrame, folder: str, each: Callable[[dict[str, str], bytes], tuple] = _summary, schema: str = READ_BACK, arrow: pa.Schema = _READ_BACK) -> DataFrame:
    """Read the records that ``index`` (any selection of its rows) names.

    Rows are dealt by file and stretch of the file and sorted by offset, so a
    task reads few, long, ascending ranges; there are as many tasks as
    stretches, up to one for each TASK bytes. ``each`` turns header fields and
    payload into a row. A response whose payload fails its digest is an error.
    """
    ranges = index.select("file", "offset", "length").withColumn("span", F.floor(F.col("offset") / SPAN))
    # The index is small beside what it names, so the number of tasks comes from the bytes to read.
    size = ranges.agg(F.sum("length").alias("n"), F.approx_count_distinct(F.struct("file", "span")).alias("spans")).first()
    tasks = min(max(1, size["spans"]), max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size["n"] or 0) // TASK)))
    dealt = ranges.repartition(tasks, "file", "span").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").transform(mapped, _reader(f"{folder}/archives", each, arrow), schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder)

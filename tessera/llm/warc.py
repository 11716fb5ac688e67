"""WARC archives, index first.

Writing: each task writes its records, one gzip member each, to files of bounded size in the shared folder and returns the
index: file, offset, length, URL and digest per record. The index is a table; it names only the files of tasks that
succeeded, so a lost or repeated task leaves files that nothing refers to. Reading: the wanted index rows are sorted by
file and offset, neighbouring byte ranges are merged into reads of bounded size, and records are cut out of them.

Equal payloads are stored once: the one with the smallest page_id is a response, the others are revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _exchange as ex

#: Pages of one payload that a task gets; a more frequent payload is dealt out.
PART_PAGES = 20_000
#: Bytes of payload that are read before they are passed on.
STEP = 4 << 20
FILE_BYTES = 64 << 20
#: A read ends where the next record is further away than GAP, or would make it longer than READ.
GAP, READ = 64 << 10, 4 << 20
_INDEX = "page_id long, record_type string, refers_to long, url string, digest string, file string, offset long, length long"
_NAMES = {"WARC-Type": "type", "WARC-Payload-Digest": "digest", "WARC-Target-URI": "url"}


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header's value holds no line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP header, which tells the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of an uncompressed record; names in lower case."""
    fields = lambda part: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in part.decode().split("\r\n")[1:])}
    end = raw.index(b"\r\n\r\n")
    warc = fields(raw[:end])
    block = raw[end + 4 : end + 4 + int(warc["content-length"])]
    end = block.index(b"\r\n\r\n")
    return warc, fields(block[:end]), block[end + 4 :]


def _fs(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else pafs.FileSystem.from_uri(folder if folder.startswith("file:") else f"file://{folder}")


def _gzip(raw: bytes) -> bytes:
    coder = zlib.compressobj(1, zlib.DEFLATED, 31)
    return coder.compress(raw) + coder.flush()


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Writes a record per row of pages to WARC files in folder (a URI that all executors can write to) and returns the
    index: page_id, record_type, refers_to, url, digest, file, offset, length, as a table in the shared folder.

    pages: page_id long, url string, html string, others ignored. The payload is the html in UTF-8, null counts as empty.
    Of records with equal payloads of at least min_bytes bytes the one with the smallest page_id is a response, the
    others revisit it; smaller ones are all responses. A row without a page_id is a response always, and nothing refers
    to it. Of rows that repeat the smallest page_id all are responses. Null URLs are empty. An empty table writes nothing.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("n"))
    several = rows.filter((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).filter("k > 1")
    several = ex.materialise(several, "payloads", small=True)
    salts = max(1, -(-(several.agg(F.max("k")).first()[0] or 0) // PART_PAGES))  # one number
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.coalesce("page_id", F.lit(0))), F.lit(salts)))
    first = several.select("sha", "n", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    typed = rows.join(first, ["sha", "n", "salt"], "left").select("page_id", "url", "html", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index: list[tuple] = []
                for page_id, url, text, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    payload = text.encode()
                    digest = payload_digest(payload)
                    data = _gzip(record(page_id, url, payload, digest, refers, refers is not None, date))
                    out.write(data)
                    index.append((page_id, "response" if refers is None else "revisit", refers, url, digest, name, at, len(data)))
                    at += len(data)
                if index:
                    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    return ex.materialise(typed.mapInArrow(write, _INDEX), "warc-index")


_READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean"


def read_archive(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of these index rows (any selection of write_archive's): page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, verified (a response's payload has the digest of its header), and with payloads the
    payload (null for revisits). payload_bytes of a revisit is the length that its HTTP header tells.

    Rows are dealt by file and stretch of FILE_BYTES / 16, sorted by offset, and merged into reads of at most READ bytes.
    """
    dealt = index.select("file", "offset", "length", F.floor(F.col("offset") / (FILE_BYTES // 16)).alias("stretch"))
    dealt = dealt.repartition("file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")

    def cut(fs, root: str, file: str, offsets: np.ndarray, lengths: np.ndarray) -> Iterator[bytes]:
        with fs.open_input_file(f"{root}/{file}") as source:
            at = 0
            while at < len(offsets):
                to, end = at + 1, offsets[at] + lengths[at]
                while to < len(offsets) and offsets[to] - end <= GAP and offsets[to] + lengths[to] - offsets[at] <= READ:
                    end = max(end, offsets[to] + lengths[to])
                    to += 1
                block = memoryview(source.read_at(int(end - offsets[at]), int(offsets[at])))
                for i in range(at, to):
                    lo = offsets[i] - offsets[at]
                    yield zlib.decompress(block[lo : lo + lengths[i]], 31)
                at = to

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        for batch in batches:
            files, offsets, lengths = batch.column("file").to_pylist(), batch.column("offset").to_numpy(), batch.column("length").to_numpy()
            rows: list[tuple] = []
            at = size = 0
            while at < len(files):
                to = at
                while to < len(files) and files[to] == files[at]:
                    to += 1
                for raw in cut(fs, root, files[at], offsets[at:to], lengths[at:to]):
                    warc, http, payload = parse(raw)
                    revisit = warc["warc-type"] == "revisit"
                    digest = warc["warc-payload-digest"].removeprefix("sha1:")
                    number = lambda k: int(warc[k]) if k in warc else None  # noqa: E731, B023
                    row = (number("x-page-id"), warc["warc-target-uri"], warc["warc-type"], number("x-refers-to-page-id"), int(http["content-length"]), digest,
                           revisit or payload_digest(payload) == digest)
                    rows.append((*row, None if revisit else payload) if payloads else row)
                    size += len(payload) if payloads else 0
                    if size >= STEP:
                        yield as_batch(rows)
                        rows, size = [], 0
                at = to
            if rows:
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        names = [*(x.split()[0] for x in _READ.split(", ")), "payload"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names[: len(rows[0])])

    return dealt.mapInArrow(read, _READ + (", payload binary" if payloads else ""))


def query(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified, read back from archives of all pages."""
    folder = ex.new_path(spark, "warc")
    index = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archive(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


#: base32 from the digest's 32 hexadecimal digits: five bits at a time, as DuckDB has no base32.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS least FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', sha[i]) - 1), 4, '0')), '') AS b FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    1 + 16 * b[5 * k + 1]::INT + 8 * b[5 * k + 2]::INT + 4 * b[5 * k + 3]::INT + 2 * b[5 * k + 4]::INT + b[5 * k + 5]::INT]), '') AS payload_digest,
  CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN least < page_id THEN least END AS refers_to, true AS verified
FROM bits
"""

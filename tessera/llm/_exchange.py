"""Exchanges of packed blocks between documents and hash buckets.

A corpus-wide question about hashes (is this window known elsewhere? how often?) costs one row per hash if it is asked
row by row. Here documents are dealt into groups of GROUP consecutive ids, and what a group has to say to a bucket of
the hash space travels as one binary value: differences of sorted distinct hashes, stored byte plane by byte plane so that
the shuffle's compression sees that their high bytes are alike. A hot hash is sent once per group and batch of documents, never once per document.

Groups follow the order of the ids: whatever a smaller group holds belongs to smaller ids. How many ids make a group follows
from the texts' bytes and from how densely the ids lie (group_bits). Rows without an id belong to groups of their own, by a
hash of the text, which all count as one group that is larger than the others.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a group is meant to hold, of text that a task gathers, and of input that a bucket stands for.
GROUP_BYTES = 1 << 20
FLUSH_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: Groups of rows without an id begin here; their number.
NULL_GROUP = 1 << 62
NULL_GROUPS = 1 << 18
NO_ID = (1 << 63) - 1
#: Arrow batches of intermediate tables are small, and their shuffle files go once the table is written.
_WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Sets these values, and what stood before afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; an own one only on a local master without any."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialise(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors.

    small: the rows are far fewer than the input's, so an eighth of the shuffle partitions write them.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = new_path(spark, name)
    with _settings(spark, _WRITING):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(df: DataFrame) -> int:
    """Buckets in proportion to the input, and at least the session's shuffle partitions; these alone if the plan knows no size."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 60 else max(least, -(-size // BUCKET_BYTES))


def group_bits(docs: DataFrame, target: int = GROUP_BYTES, column: str = "text") -> int:
    """How many low bits of an id a group leaves out, so that it holds about target bytes where the ids lie densest.

    The density is that of the densest of 1,000 equal parts of the rows. Consecutive ids of short texts make groups of
    hundreds, long texts smaller ones, sparse (hashed) ids groups over wide stretches.
    """
    cuts = [i / 1000 for i in range(1001)]
    known = docs.filter("doc_id IS NOT NULL")
    n, size, at = known.agg(F.count("*"), F.sum(F.octet_length(column).cast("long")), F.percentile_approx("doc_id", cuts)).first()  # 1,001 numbers
    if not n:
        return 0
    rows = max(1.0, target * n / max(size or 0, n))  # rows that make up a group
    first = [i for i in range(len(at)) if i == 0 or at[i] > at[i - 1]]
    density = max(((j - i) * n / 1000 / (at[j] - at[i]) for i, j in zip(first[:-1], first[1:], strict=True)), default=1.0)
    return min(62, max(0, round(math.log2(rows / min(density, 1.0)))))


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def unplanes(blob: bytes, kind: type = np.uint64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).ravel()


def sorted_blob(values: np.ndarray) -> bytes:
    """Sorted distinct hashes as differences, whose high planes are almost all zeros."""
    return planes(np.diff(values, prepend=np.zeros(1, np.uint64)))


def sorted_values(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob), dtype=np.uint64)


def small(values: np.ndarray) -> bytes:
    """Numbers that are mostly small, compressed."""
    return len(values).to_bytes(8, "little") + pa.compress(planes(values.astype(np.int64)), codec="zstd", asbytes=True)


def unsmall(blob) -> np.ndarray:
    n = int.from_bytes(bytes(blob[:8]), "little")
    return unplanes(pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.int64)


def cuts(sorted_hashes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets present in sorted hashes, and where each begins, with the end at last."""
    which = ((sorted_hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    begins = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, np.int64)
    return which[begins].astype(np.int64), np.r_[begins, len(which)]


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(blobs: list) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(b).read_all() for b in blobs)


def group_of(table: pa.Table, bits: int) -> np.ndarray:
    """Group of each row: 2^bits consecutive ids; a null id gets one of the last groups, by its text."""
    ids = table.column("doc_id").combine_chunks()
    out = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) >> bits
    null = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
    if len(null):
        texts = table.column("text").take(pa.array(null)).to_pylist()
        out[null] = [NULL_GROUP + zlib.crc32((t or "").encode()) % NULL_GROUPS for t in texts]
    return out


def by_group(table: pa.Table, groups: np.ndarray) -> Iterator[tuple[int, pa.Table]]:
    if not len(groups):
        return
    if (groups[1:] < groups[:-1]).any():
        order = np.argsort(groups, kind="stable")
        table, groups = table.take(pa.array(order)), groups[order]
    begins = np.r_[np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]), len(groups)]
    for lo, hi in zip(begins[:-1], begins[1:], strict=True):
        yield int(groups[lo]), table.slice(lo, hi - lo)


def flushes(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = FLUSH_BYTES) -> Iterator[pa.Table]:
    """Batches gathered to tables of about limit bytes of text, larger ones cut."""
    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rest = batch.slice(at)
            used = np.cumsum(np.diff(_offsets(rest.column(text))))
            take = max(1, int(np.searchsorted(used, limit - size, side="right"))) if size < limit else 0
            if take:
                held.append(rest.slice(0, take))
                size += int(used[min(take, len(used)) - 1])
                at += min(take, rest.num_rows)
            if size >= limit or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    buffer = col.buffers()[1]
    if buffer is None or not len(col):
        return np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(buffer, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


PACKED = "g long, data binary"


def packed(docs: DataFrame, bits: int) -> DataFrame:
    """(g, data): the documents of a group that met in a task, as one compressed block. docs: doc_id, text and plainly named others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in flushes(batches):
            parts = list(by_group(table, group_of(table, bits)))
            yield pa.record_batch({"g": pa.array([g for g, _ in parts], pa.int64()), "data": pa.array([pack(t) for _, t in parts], pa.binary())})

    return docs.mapInArrow(run, PACKED)


SENT = "bucket int, g long, data binary"


def sent(docs: DataFrame, hashes_of, n_buckets: int, bits: int) -> DataFrame:
    """(bucket, g, data): what each group sends to each bucket. hashes_of: table of doc_id and text -> hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in flushes(batches):
            for g, part in by_group(table, group_of(table, bits)):
                yield addressed(g, np.unique(hashes_of(part)), n_buckets)

    return docs.select("doc_id", "text").mapInArrow(run, SENT)


def addressed(g: int, hashes: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Rows of SENT for the sorted distinct hashes of a group."""
    which, at = cuts(hashes, n_buckets)
    return pa.record_batch({
        "bucket": pa.array(which.astype(np.int32), pa.int32()),
        "g": pa.array(np.full(len(which), g, np.int64), pa.int64()),
        "data": pa.array([sorted_blob(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
    })


def answered(rows: DataFrame, later_only: bool) -> DataFrame:
    """(g, data): to each group its hashes that other groups hold too, or only those that a smaller group holds."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("g")
        blobs = [sorted_values(x.as_buffer()) for x in table.column("data")]
        h = np.concatenate(blobs)
        g = np.repeat(table.column("g").to_numpy(), [len(b) for b in blobs])
        order = np.argsort(h, kind="stable")
        h, g = h[order], g[order]
        first = np.r_[True, h[1:] != h[:-1]]
        begins = np.flatnonzero(first)
        run_of = np.cumsum(first) - 1
        if later_only:
            held = np.minimum(g, NULL_GROUP) > np.minimum(g[begins], NULL_GROUP)[run_of]
        else:
            held = (np.maximum.reduceat(g, begins) > g[begins])[run_of]
        h, g = h[held], g[held]
        order = np.lexsort((h, g))
        h, g = h[order], g[order]
        at = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)] if len(g) else np.zeros(1, np.int64)
        pairs = list(zip(at[:-1], at[1:], strict=True))
        return pa.table({"g": pa.array([int(g[a]) for a, _ in pairs], pa.int64()), "data": pa.array([sorted_blob(np.unique(h[a:b])) for a, b in pairs], pa.binary())})

    return rows.select("bucket", "g", "data").groupBy("bucket").applyInArrow(run, PACKED)


def meeting(docs: DataFrame, answers: DataFrame, apply, schema: str) -> DataFrame:
    """Brings each group's documents and answers together. apply: g, documents, sorted hashes -> table of schema."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        data = table.column("data")
        own = [data[i].as_buffer() for i, k in enumerate(kinds) if k == 0]
        said = [sorted_values(data[i].as_buffer()) for i, k in enumerate(kinds) if k == 1]
        known = np.unique(np.concatenate(said)) if said else np.zeros(0, np.uint64)
        return apply(table.column("g")[0].as_py(), unpack(own), known)

    both = docs.select("g", F.lit(0).alias("kind"), "data").unionByName(answers.select("g", F.lit(1).alias("kind"), "data"))
    return both.groupBy("g").applyInArrow(run, schema)


def within(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == values

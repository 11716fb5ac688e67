"""Scores of all pairs of a similarity join in blocks, of which only each record's best pairs leave a task.

A row for each feature, or for each pair that shares one, is many times the input. Here a block of records has each of its
features once, as a 64-bit number. Blocks ask buckets of the hash space how many right records hold their features, and every
block of left records then meets every block of right records of its pool, read from the folder that the cluster shares. A
task adds up the scores of two blocks in one array and keeps the k best of each record; the best of all follow from these.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.tables import shared_folder

#: Features of a block, cells and products of a step, bytes of the blocks of a task: they bound memory, not results.
BLOCK, CELLS, PRODUCTS, TASK = 750_000, 300_000, 300_000, 32_000_000


def _released() -> None:
    """Gives freed memory back; a worker that is used again would hold it through the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32, first all their low bytes: this compresses well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _whole(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows id, src, pool, keys, counts (of keys by type) to blocks of one pool."""
    held: dict[str, list[pa.Table]] = {}
    n: dict[str, int] = {}
    number = 0

    def packed(pool: str) -> pa.RecordBatch:
        nonlocal number
        rows = pa.concat_tables(held.pop(pool)).combine_chunks()
        n.pop(pool)
        number += 1
        lists = rows["keys"].combine_chunks()
        keys, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        counts = rows["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        types = np.repeat(np.tile(np.arange(len(counts) // max(len(sizes), 1)), len(sizes)), counts).astype(np.uint8)
        right = rows["src"].to_numpy() > 1
        own, first, codes = np.unique(keys, return_index=True, return_inverse=True)
        df = np.bincount(codes[np.repeat(right, sizes)], minlength=len(own))
        made = {"block": f"{TaskContext.get().partitionId()}-{number}", "pool": pool, "ids": rows["id"].combine_chunks(), "right": right.astype(np.uint8).tobytes(), "sizes": _planes(sizes),
                "codes": _planes(codes), "keys": own.astype("<i8").tobytes(), "types": types[first].tobytes(), "df": _planes(df)}
        ids = pa.ListArray.from_arrays(pa.array([0, len(made["ids"])], pa.int32()), made["ids"])
        return pa.RecordBatch.from_arrays([ids if k == "ids" else pa.array([v]) for k, v in made.items()], list(made))

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        for pool in pc.unique(rows["pool"]).to_pylist():
            own = rows.filter(pc.equal(rows["pool"], pool))
            for at in range(0, own.num_rows, 500):  # a batch may hold more than a block
                part = own.slice(at, 500)
                held.setdefault(pool, []).append(part)
                n[pool] = n.get(pool, 0) + (pc.sum(pc.list_value_length(part["keys"])).as_py() or 0)
                if n[pool] >= BLOCK:
                    yield packed(pool)
    for pool in list(held):
        yield packed(pool)
    _released()


def _asked(buckets: int):
    """Blocks to rows block, bucket, keys, df: a part of the hash space each."""
    edges = np.array([-(2**63) + (2**64 * i) // buckets for i in range(1, buckets)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, df = np.frombuffer(r["keys"], "<i8"), _whole(r["df"])
                cuts = [0, *np.searchsorted(keys, edges), len(keys)]
                spans = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["block"]] * len(spans), pa.string()), pa.array([i for i, _, _ in spans], pa.int32()),
                    pa.array([keys[a:b].tobytes() for _, a, b in spans], pa.binary()), pa.array([_planes(df[a:b]) for _, a, b in spans], pa.binary()),
                ], ["block", "bucket", "keys", "df"])

    return run


def _answered(rows: pa.Table) -> pa.Table:
    """A bucket's rows: df over all blocks instead of the block's own."""
    keys = [np.frombuffer(k, "<i8") for k in rows["keys"].to_pylist()]
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(at, np.concatenate([_whole(x) for x in rows["df"].to_pylist()]), len(own))[at]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return pa.table({"block": rows["block"], "bucket": rows["bucket"], "df": pa.array([_planes(x) for x in np.split(df, cuts)], pa.binary())})


def _weighted(weights: list[float], caps: list[float] | None, prefix_m: int | None):
    """Blocks with df to their left and right halves: probes of left records, lists of right records by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i] for n in batch.schema.names}
                df = np.concatenate([_whole(x["df"]) for x in sorted(r["answers"].as_py(), key=lambda x: x["bucket"])] or [np.zeros(0, int)])
                types, keys = np.frombuffer(r["types"].as_py(), np.uint8), np.frombuffer(r["keys"].as_py(), "<i8")
                w = np.array(weights)[types] * np.log((r["n_right"].as_py() + 1) / np.maximum(df, 1))
                w[(df == 0) | (False if caps is None else df > np.array(caps)[types])] = 0
                codes, sizes, right = _whole(r["codes"].as_py()), _whole(r["sizes"].as_py()), np.frombuffer(r["right"].as_py(), np.uint8) > 0
                row = np.repeat(np.arange(len(sizes)), sizes)
                on = w[codes] != 0
                row, codes = row[on], codes[on]
                norm = np.sqrt(np.bincount(row, w[codes] ** 2, len(sizes)))
                ids = r["ids"].values
                place = np.where(right, np.cumsum(right), np.cumsum(~right)) - 1  # of a record in its half
                out = {"block": r["block"].as_py(), "pool": r["pool"].as_py(), "l_ids": ids.filter(pa.array(~right)), "r_ids": ids.filter(pa.array(right)), "l_norm": norm[~right].tobytes(), "r_norm": norm[right].tobytes()}
                # left: the heaviest features; those of equal weight are in the order of type and feature already
                own = ~right[row]
                a, c = row[own], codes[own]
                if prefix_m is not None:
                    best = np.lexsort((-(w[c] / norm[a]), a))  # stable
                    n = np.bincount(a, minlength=len(sizes))
                    rank = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
                    best = best[rank < prefix_m]
                    a, c = a[best], c[best]
                used, c = np.unique(c, return_inverse=True)
                out |= {"l_keys": keys[used].tobytes(), "l_w": w[used].tobytes(), "l_codes": _planes(c), "l_n": _planes(np.bincount(place[a], minlength=int((~right).sum())))}
                # right: records by feature
                a, c = row[~own], codes[~own]
                order = np.argsort(c, kind="stable")
                used, n = np.unique(c, return_counts=True)
                out |= {"r_keys": keys[used].tobytes(), "r_w": w[used].tobytes(), "r_n": _planes(n), "r_rows": _planes(place[a[order]])}
                lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([lists(v) if k.endswith("_ids") else pa.array([v]) for k, v in out.items()], list(out))
        _released()

    return run


class _Best:
    """The k best (score, then the smaller id of the other side) of each of n records so far."""

    def __init__(self, n: int, k: int, other: np.ndarray):
        self.k, self.least = k, np.zeros(n)
        self.row, self.score, self.other = np.zeros(0, np.int64), np.zeros(0), other[:0]

    def add(self, row: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        if not len(row):
            return
        row, score, other = np.concatenate([self.row, row]), np.concatenate([self.score, score]), np.concatenate([self.other, other])
        order = np.lexsort((other, -score, row))
        row, score, other = row[order], score[order], other[order]
        n = np.bincount(row, minlength=len(self.least))
        rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        last = rank == self.k - 1
        self.least[row[last]] = score[last]
        on = rank < self.k
        self.row, self.score, self.other = row[on], score[on], other[on]


def _floor(best: _Best, scores: np.ndarray, rows: slice, axis: int) -> np.ndarray:
    """Scores below it are not among a record's k best; rounding takes half of 1e-9 at most. Pairs that share nothing have 0."""
    least = best.least[rows]
    at = scores.shape[axis] - best.k
    if at > 0 and np.mean(least == 0) > 0.3:
        least = np.maximum(least, np.partition(scores, at, axis=axis).take(at, axis=axis))
    return np.maximum(least - 2e-9, 5e-324)


def _ids(x: pa.Array) -> np.ndarray:
    return np.array(x.to_pylist(), str) if pa.types.is_string(x.type) or pa.types.is_large_string(x.type) else x.to_numpy(zero_copy_only=False)


def _scored(k_left: int, k_right: int):
    """Rows of a left and a right block to side, a, b, pool, score: the best of each left record (side 0) and of each right one (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[str, tuple[str, np.ndarray, _Best]] = {}
        right: dict[str, tuple[str, np.ndarray, _Best]] = {}
        last, probes, kind = None, None, None
        _released()
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i] for n in batch.schema.names}
                name, other, pool = r["block"].as_py(), r["r_block"].as_py(), r["pool"].as_py()
                floats, wide = lambda c: np.frombuffer(r[c].as_py(), "<f8"), lambda c: np.frombuffer(r[c].as_py(), "<i8")  # noqa: E731, B023
                kind = r["l_ids"].values.type
                if name != last:
                    sizes, codes = _whole(r["l_n"].as_py()), _whole(r["l_codes"].as_py())
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    w = floats("l_w")
                    with np.errstate(invalid="ignore"):
                        v = w[codes] * w[codes] / floats("l_norm")[row]
                    last, probes, l_ids = name, (wide("l_keys"), codes, row, v), _ids(r["l_ids"].values)
                r_ids, r_norm = _ids(r["r_ids"].values), floats("r_norm")
                if not len(l_ids) or not len(r_ids):
                    continue
                best_l = left.setdefault(name, (pool, l_ids, _Best(len(l_ids), k_left, r_ids)))[2]
                best_r = right.setdefault(other, (pool, r_ids, _Best(len(r_ids), k_right, l_ids)))[2]
                keys, ends, rows = wide("r_keys"), np.cumsum(_whole(r["r_n"].as_py())), _whole(r["r_rows"].as_py())
                if not len(keys):
                    continue
                begins = np.concatenate([[0], ends[:-1]])
                own, codes, row, v = probes
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                on = (keys[at] == own)[codes]
                row, v, at = row[on], v[on], at[codes[on]]
                n = ends[at] - begins[at]
                made = np.concatenate([[0], np.cumsum(n)])
                of_row = np.searchsorted(row, np.arange(len(l_ids) + 1))  # first probe of a record
                norm = np.where(r_norm > 0, r_norm, 1.0)
                step = max(1, CELLS // len(r_ids))
                lo = 0
                while lo < len(l_ids):
                    hi = min(lo + step, len(l_ids), max(lo + 1, int(np.searchsorted(made[of_row], made[of_row[lo]] + PRODUCTS, "right")) - 1))
                    p, q = of_row[lo], of_row[hi]
                    if q > p:
                        m = n[p:q]
                        place = np.repeat(begins[at[p:q]] - (made[p:q] - made[p]), m) + np.arange(made[q] - made[p])
                        flat = np.repeat((row[p:q] - lo) * len(r_ids), m) + rows[place]
                        scores = np.bincount(flat, np.repeat(v[p:q], m), (hi - lo) * len(r_ids)).reshape(hi - lo, -1) / norm
                        for best, floor, ids in ((best_l, _floor(best_l, scores, slice(lo, hi), 1)[:, None], r_ids), (best_r, _floor(best_r, scores, slice(None), 0)[None, :], l_ids)):
                            x, y = np.divmod(np.flatnonzero(scores >= floor), len(r_ids))
                            s = np.floor(scores[x, y] * 1e9 + 0.5) / 1e9
                            best.add(*((x + lo, s, ids[y]) if best is best_l else (y, s, ids[x + lo])))
                    lo = hi
        for side, found in ((0, left), (1, right)):
            for pool, ids, best in found.values():
                mine, others = pa.array(ids[best.row].tolist(), kind), pa.array(best.other.tolist(), kind)
                a, b = (mine, others) if side == 0 else (others, mine)
                yield pa.RecordBatch.from_arrays([pa.array([side] * len(a), pa.int32()), a, b, pa.array([pool] * len(a), pa.string()), pa.array(best.score)], ["side", "a", "b", "pool", "score"])

    return run


#: While an intermediate table is written: batches that fit a worker, and no shuffle files are left once it stands.
WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def write_kept(spark, rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        rows.write.mode(mode).option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _kept(spark, rows: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    write_kept(spark, rows, path)
    return spark.read.parquet(path), path


def _removed(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def best_pairs(keyed: DataFrame, sizes: DataFrame, weights: list[float], caps: list[float] | None, prefix_m: int | None, k1: int, rev_k: int) -> DataFrame:
    """(side, a, b, pool, score, rank): the k1 best right records of each left one (side 0), the rev_k best left ones of each right
    one (side 1). keyed: id (unique), src, pool, keys (features as numbers, by type and feature), counts (keys of each type);
    sizes: pool, n_right; weights and caps by type."""
    spark = keyed.sparkSession
    kind = keyed.schema["id"].dataType.simpleString()
    blocks, first = _kept(spark, keyed.mapInArrow(_blocks, f"block string, pool string, ids array<{kind}>, right binary, sizes binary, codes binary, keys binary, types binary, df binary"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    asked = blocks.select("block", "keys", "df").mapInArrow(_asked(buckets), "block string, bucket int, keys binary, df binary")
    answers = asked.groupBy("bucket").applyInArrow(_answered, "block string, bucket int, df binary")
    lists = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "df")).alias("answers"))
    none = F.array().cast("array<struct<bucket:int,df:binary>>")
    full = blocks.drop("df").join(lists, "block", "left").join(F.broadcast(sizes), "pool").withColumn("answers", F.coalesce("answers", none))
    halves, second = _kept(spark, full.mapInArrow(_weighted(weights, caps, prefix_m), f"block string, pool string, l_ids array<{kind}>, r_ids array<{kind}>, l_norm binary, r_norm binary, l_keys binary, l_w binary, l_codes binary, l_n binary, r_keys binary, r_w binary, r_n binary, r_rows binary"))
    _removed(spark, first)
    left = halves.select("block", "pool", *(c for c in halves.columns if c.startswith("l_")))
    right = halves.select(F.col("block").alias("r_block"), F.col("pool").alias("r_pool"), *(c for c in halves.columns if c.startswith("r_")))
    held = halves.agg(F.sum(F.length("r_keys") + F.length("r_w") + F.length("r_n") + F.length("r_rows"))).first()[0] or 0
    on_right = int(-(-held // TASK)) or 1
    on_left = max(on_right, -(-4 * spark.sparkContext.defaultParallelism // on_right))
    # two bounds in place of an equality: each left block meets the right ones where they are read, and none is shuffled
    met = left.coalesce(on_left).hint("shuffle_replicate_nl").join(right.coalesce(on_right), (F.col("pool") <= F.col("r_pool")) & (F.col("pool") >= F.col("r_pool"))).drop("r_pool")
    best, third = _kept(spark, met.mapInArrow(_scored(k1, rev_k), f"side int, a {kind}, b {kind}, pool string, score double"))
    _removed(spark, second)
    own, other = F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a"))
    rank = F.row_number().over(Window.partitionBy("side", own).orderBy(F.desc("score"), other))
    return best.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("side") == 0, k1).otherwise(rev_k))

"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a unit vector v by floor((a.v + b) / width) for a few Gaussian directions a, made orthogonal to each other so
that none repeats what another tells; its bucket is the tuple. A query visits, in each table, its own bucket and perturbed
ones (one step up or down in some of the functions), in the order of their estimated success: the smaller the squared
distances to the crossed borders, the earlier. Candidates of all tables are merged and ranked by their exact cosines in
double precision.

A visit is a bucket's key and a query's id. Buckets of more than PART vectors are dealt out in parts, and parts are gathered in
cells, whose number follows from the visits; a query's vector goes to each cell once, with the parts that it visits there. A
task streams a part's members past these queries and keeps each query's best few, so that no list of pairs is made. Of equal
vectors only the k + 1 smallest ids can be among a query's nearest, so a much repeated vector does not swell its bucket.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import _exchange as ex
from tessera.llm._text import mix

TABLES, FUNCTIONS, WIDTH, PROBES = 10, 8, 1.8, 200
#: Members of a bucket that form a part, visits that a cell is meant to get, queries whose probes are ordered together.
PART, CELL_VISITS, STEP = 4096, 1 << 16, 64
#: Candidates of a cell that are held before each query's first k are picked.
FOUND = 1 << 20
_FOUND = "query_id long, vec_id long, score double"


def _directions(table: int, dim: int, functions: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions, orthogonal where the dimension allows it (then as long as Gaussian ones are on average), and offsets."""
    rng = np.random.default_rng([seed, table, dim])
    a = rng.normal(size=(functions, dim))
    if functions <= dim:
        a = np.linalg.qr(a.T)[0].T * np.sqrt(dim)
    return a, rng.uniform(0, width, functions)


def _bucket(table: int, dim: int, cells: np.ndarray) -> np.ndarray:
    key = np.full(len(cells), (table << 32) + dim, np.uint64)
    for j in range(cells.shape[1]):
        key = mix(key + cells[:, j].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, unit vectors) by dimension."""
    lists = batch.column("v")
    off = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(off)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        x = values[(off[:-1][rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)
        yield rows, x / np.abs(x).max(axis=1)[:, None]


def index(vectors: DataFrame, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, seed: int = 7) -> DataFrame:
    """(key, vec_id, v): each vector under its bucket of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch):
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                own = batch.take(pa.array(rows))
                for t in range(tables):
                    a, b = _directions(t, x.shape[1], functions, width, seed)
                    key = _bucket(t, x.shape[1], np.floor((x @ a.T + b) / width))
                    yield pa.record_batch({"key": pa.array(key), "vec_id": own.column("vec_id"), "v": own.column("v")})

    return vectors.select("vec_id", "v").mapInArrow(run, "key long, vec_id long, v array<double>")


def probes(queries: DataFrame, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, n_probes: int = PROBES, seed: int = 7) -> DataFrame:
    """(key, vec_id): the buckets that each query visits, n_probes in each table."""
    steps = np.array(list(itertools.product((0, -1, 1), repeat=functions)))
    up, down = (steps == 1).astype(float), (steps == -1).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch):
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                ids = batch.column("vec_id").to_numpy()[rows]
                for t in range(tables):
                    a, b = _directions(t, x.shape[1], functions, width, seed)
                    place = (x @ a.T + b) / width
                    for at in range(0, len(ids), STEP):
                        cell = np.floor(place[at : at + STEP])
                        above = place[at : at + STEP] - cell
                        cost = ((1 - above) ** 2) @ up.T + (above**2) @ down.T
                        order = np.argsort(cost, axis=1, kind="stable")[:, :n_probes]
                        cells = (cell[:, None, :] + steps[order]).reshape(-1, functions)
                        key = _bucket(t, x.shape[1], cells)
                        yield pa.record_batch({"key": pa.array(key), "vec_id": pa.array(np.repeat(ids[at : at + STEP], order.shape[1]))})

    return queries.select("vec_id", "v").mapInArrow(run, "key long, vec_id long")


def _cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, the same for the same vectors wherever they stand."""
    q, c = q / np.abs(q).max(axis=1)[:, None], c / np.abs(c).max(axis=1)[:, None]
    return (q * c).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1)))


def _scan(visits: DataFrame, queries: DataFrame, members: DataFrame, k: int, n_cells: int) -> DataFrame:
    """(query_id, vec_id, score): in each part of a bucket the k nearest members of each query that visits it.

    visits: key, vec_id; queries: vec_id, v; members: key, vec_id, v.
    """
    parts = members.groupBy("key").agg(F.ceil(F.count("*") / PART).alias("parts"))
    cell = F.pmod(F.xxhash64("key", "part"), F.lit(n_cells)).alias("cell")
    right = members.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))
    right = right.select(cell, F.lit(1).alias("turn"), "key", "part", "vec_id", "v", F.lit(None).cast("array<struct<key:long,part:long>>").alias("to"))
    left = visits.join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    left = left.groupBy(cell, "vec_id").agg(F.collect_list(F.struct("key", "part")).alias("to"))  # at most a query's visits
    left = left.join(queries, "vec_id").select("cell", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("part"), "vec_id", "v", "to")
    dealt = right.unionByName(left).repartition("cell").sortWithinPartitions("cell", "turn", "key", "part")

    def best(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in own, member, score) of all that may be among the first k members of each query; own: the queries' ids."""
        unit = lambda x: x / np.sqrt((x * x).sum(axis=1))[:, None]
        scaled = lambda x: unit(x / np.abs(x).max(axis=1)[:, None])
        rough = scaled(queries) @ scaled(vectors).T
        rough[own[:, None] == ids[None, :]] = -np.inf
        if rough.shape[1] > k:  # the exact cosines decide
            limit = -np.partition(-rough, k - 1, axis=1)[:, k - 1] - 1e-12
            i, j = np.nonzero(rough >= np.maximum(limit, -2)[:, None])
        else:
            i, j = np.nonzero(rough > -2)
        return i, ids[j], _cosines(queries[i], vectors[j])

    def reduced(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's first k of what was found, a member once."""
        q, i, score = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((-score, i, q))
        q, i, score = q[order], i[order], score[order]
        once = np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])] if len(q) else np.zeros(0, bool)
        q, i, score = q[once], i[once], score[once]
        order = np.lexsort((i, -score, q))
        q, i, score = q[order], i[order], score[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[top], i[top], score[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, vectors = None, [], []  # the queries of the cell at hand, CELL_VISITS or so at most
        visitors: dict[tuple[int, int], list[int]] = {}
        found, size = [], 0

        def out() -> pa.RecordBatch:
            q, i, score = reduced(found)
            return pa.record_batch([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cells, turn, key, part, vec_id = (batch.column(c).to_numpy() for c in ("cell", "turn", "key", "part", "vec_id"))
            lists = batch.column("v")
            off, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            change = np.r_[True, (cells[1:] != cells[:-1]) | (turn[1:] != turn[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
            begins = np.r_[np.flatnonzero(change), len(key)]
            for lo, hi in zip(begins[:-1], begins[1:], strict=True):
                if cells[lo] != name:
                    if found:
                        yield out()
                    name, ids, vectors, visitors, found, size = cells[lo], [], [], {}, [], 0
                if turn[lo] == 0:
                    for i in range(lo, hi):
                        for to in batch.column("to")[i].as_py():
                            visitors.setdefault((to["key"], to["part"]), []).append(len(ids))
                        ids.append(vec_id[i])
                        vectors.append(values[off[i] : off[i + 1]].copy())
                elif own := visitors.get((int(key[lo]), int(part[lo]))):
                    x = values[off[lo] : off[hi]].reshape(hi - lo, -1)
                    for at in range(0, len(own), 256):
                        some = own[at : at + 256]
                        mine = np.array([ids[i] for i in some])
                        i, member, score = best(np.stack([vectors[i] for i in some]), mine, vec_id[lo:hi], x)
                        found.append((mine[i], member, score))
                        size += len(i)
                    if size > FOUND:
                        found = [reduced(found)]
                        size = len(found[0][0])
        if found:
            yield out()

    return dealt.mapInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return distinct.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, n_probes: int = PROBES, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is_query picks, by cosine, ties to smaller ids.

    vectors: vec_id long, embedding array of numbers, others ignored. Candidates are all rows but those with the query's
    own vec_id. Rows with a null vec_id or embedding, or an embedding that is empty, zero or holds null or non-finite
    components take no part. Only vectors of one length are compared. Equal rows count once; of rows that repeat a vec_id with
    other vectors each is searched, and the best score of a pair of ids counts. Queries that find fewer than k in their
    buckets are compared with all rows, in blocks, so that small tables give all they have. Other columns may have any
    name; an empty table gives an empty result.
    """
    v = F.col("embedding").cast("array<double>")
    valid = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 + 0.0 is 0.0: equal vectors look alike to the window below
    rows = vectors.withColumn("_q", F.coalesce(is_query, F.lit(False))).select(F.col("vec_id").cast("long"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"), "_q")
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(valid)
    rows = ex.materialise(rows.groupBy("vec_id", "v").agg(F.max("_q").alias("_q")), "vectors")
    queries = rows.filter("_q").select("vec_id", "v")
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    members = ex.materialise(rows.select("vec_id", "v", place.alias("place")).filter(F.col("place") <= k + 1).drop("place"), "members")

    least = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_cells = max(least, -(-queries.count() * tables * n_probes // CELL_VISITS))  # one number
    visits = probes(queries, tables, functions, width, n_probes, seed)
    found = _scan(visits, queries, index(members, tables, functions, width, seed), k, n_cells)
    top = ex.materialise(_first(found, k), "nearest")
    enough = top.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id")).distinct()
    short = ex.materialise(queries.join(enough, "vec_id", "left_anti"), "short", small=True)
    n_short = short.count()
    if n_short:  # the exact way: all rows, in blocks of PART
        size = F.size("v").cast("long")
        n_blocks = max(least, -(-members.count() // PART))
        block = lambda c: F.xxhash64(size, c)
        members = members.withColumn("key", block(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))))
        visits = short.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).withColumn("key", block(F.col("b")))
        more = _scan(visits.select("key", "vec_id"), short, members.select("key", "vec_id", "v"), k, max(least, -(-n_short * n_blocks // CELL_VISITS)))
        top = top.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(_first(more, k))
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: five neighbours of each row whose vec_id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


#: Approximate; tests hold its recall and scores against brute force.
SQL = None

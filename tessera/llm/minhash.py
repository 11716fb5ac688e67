"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A signature has CHUNKS * WIDTH symbols of 16 bits. Two signatures that differ in fewer than 2 * CHUNKS symbols agree, by
pigeonhole, in all but one symbol of some chunk at least; so each chunk is indexed under each choice of the one symbol that
may be wrong, and documents that share an index key are candidates. Every pair within that signature distance is met.
Candidates are confirmed on their full shingle sets.

Groups of copies may be huge, and all their pairs are never listed:

* Documents with equal sets are one class; only the class's smallest id takes part.
* Round 1 pairs each member of a key with the key's smallest id only (as many pairs as members), confirms these stars and
  takes connected components.
* Round 2 looks again at keys whose members are still in different components, compares signatures across components in
  bounded blocks, and confirms each pair that is near enough, once. Pairs inside a component need no look: they are
  connected. So no link between components is lost to the stars. Members of a key's largest component don't meet each other,
  nor do sets whose sizes differ by more than the threshold allows; of n members that are in components of their own and of
  like size, as unlike texts around one long boilerplate, still all pairs of signatures are compared.

Before two sets are compared in full, bitmaps of the sets bound their intersection from above: each bit that one has alone
stands for a shingle that the other lacks. What the bound rules out is no link for certain, so of a group of half-similar
documents hardly any pair leaves the task that holds their signatures.

Components are found by alternating large and small stars over tables in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _exchange as ex
from tessera.llm._text import Words, mix, utf8, windows

SHINGLE = 5
CHUNKS, WIDTH = 12, 4
SYMBOLS = CHUNKS * WIDTH
#: Symbols that must agree for a look at the full sets. At a similarity of 0.75 fewer have a chance below 1e-6.
LEAST_EQUAL = 20
#: Members of a star, and of a block of round 2, that one task holds together.
STAR_PART, BLOCK = 256, 1024
#: Logarithm of the ratio of sizes within a band; a little more than that of 4 / 3, beyond which sets are never linked.
BAND = math.log(4 / 3) * (1 + 1e-9)
#: A class of copies is hot from this fraction of all rows on.
HOT = 1000

_RNG = np.random.default_rng(7_500_000)
_FLIP = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
_TIMES = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_SALT_A, _SALT_B = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def shingle_sets(text: pa.Array | pa.ChunkedArray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, off): hashes[off[i]:off[i + 1]] is the sorted set of text i's shingles.

    Words of the lower-cased (A-Z) text; with fewer than `size` words the whole sequence is the one shingle.
    """
    words = Words(*utf8(text), lower=True)
    hashes, counts = words.hashes(), words.counts
    full = windows(hashes, size)
    valid = words.left()[: len(full)] >= size
    doc = words.doc[: len(full)][valid]
    out = [full[valid]], [doc]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for i, s in enumerate(short):
            part = hashes[words.off[s] : words.off[s + 1]]
            own[i] = windows(part, len(part))[0] ^ np.uint64(len(part))
        out[0].append(mix(own + _SALT_B))
        out[1].append(short)
    h, d = np.concatenate(out[0]), np.concatenate(out[1])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(counts) + 1))


def signatures(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """n x SYMBOLS symbols of the non-empty sets; rows of empty ones mean nothing."""
    out = np.zeros((len(off) - 1, SYMBOLS), np.uint16)
    some = np.flatnonzero(np.diff(off) > 0)
    if len(some):
        for k in range(SYMBOLS):
            least = np.minimum.reduceat((hashes ^ _FLIP[k]) * _TIMES[k], off[some])
            out[some, k] = mix(least).astype(np.uint16)
    return out


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """n x SYMBOLS keys: for each chunk and each symbol of it left out, a hash of the others."""
    out = np.empty((len(symbols), SYMBOLS), np.uint64)
    wide = symbols.astype(np.uint64)
    for c in range(CHUNKS):
        for j in range(WIDTH):
            key = np.full(len(symbols), c * WIDTH + j, np.uint64)
            for i in range(WIDTH):
                if i != j:
                    key = (key << np.uint64(16)) | wide[:, c * WIDTH + i]
            out[:, c * WIDTH + j] = mix(key)
    return out


def bitmap(hashes: np.ndarray) -> bytes:
    """A bitmap of a set, with four to eight bits an element; the size is a power of two, so larger ones fold."""
    size = max(64, 1 << (4 * len(hashes) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes >> np.uint64(7)) & np.uint64(size - 1)] = 1
    return np.packbits(bits).tobytes()


def _fold(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[-1] > width:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] | rows[..., half:]
    return rows


def _may_link(a: np.ndarray, na: int, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the bitmap a of a set of na can be that of a set linked with those in the rows of b, by the bound alone."""
    width = min(a.shape[-1], b.shape[-1])
    a, b = _fold(a, width), _fold(b, width)
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    most = np.minimum(na - only_a, nb - only_b)
    return 100 * most >= 75 * (na + nb - most)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (16 bytes; null without shingles), symbols and bits of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in ex.flushes(batches, limit=2 << 20):
            h, off = shingle_sets(table.column("text"))
            n = np.diff(off)
            sums = np.zeros((len(n), 2), np.uint64)
            some = np.flatnonzero(n)
            for k, salt in enumerate((_SALT_A, _SALT_B)):
                if len(some):
                    sums[some, k] = np.add.reduceat(mix(h + salt), off[some])
            rows = signatures(h, off)
            yield pa.record_batch({
                "doc_id": table.column("doc_id").combine_chunks(),
                "n_shingles": pa.array(n.astype(np.int64)),
                "set_hash": pa.array([s.tobytes() if m else None for s, m in zip(sums, n, strict=True)], pa.binary()),
                "symbols": pa.array([r.tobytes() if m else None for r, m in zip(rows, n, strict=True)], pa.binary()),
                "bits": pa.array([bitmap(h[a:b]) if b > a else None for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, symbols binary, bits binary")


def _keys(reps: DataFrame) -> DataFrame:
    """(key, a) of every representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                symbols = np.frombuffer(b"".join(batch.column("symbols").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                keys = index_keys(symbols).view(np.int64)
                yield pa.record_batch({"key": pa.array(keys.ravel()), "a": pa.array(np.repeat(batch.column("a").to_numpy(), SYMBOLS))})

    return reps.select("a", "symbols").mapInArrow(run, "key long, a long")


def _near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose signatures are near enough."""
    own = reps.select("a", "n_shingles", "symbols", "bits")
    both = pairs.join(own.withColumnsRenamed({"n_shingles": "na", "symbols": "sa", "bits": "ba"}), "a").join(
        own.withColumnsRenamed({"a": "b", "n_shingles": "nb", "symbols": "sb", "bits": "bb"}), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sa", "sb"))
                near = (sa == sb).sum(axis=1) >= LEAST_EQUAL
                na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                for i in np.flatnonzero(near):
                    ba, bb = (np.frombuffer(batch.column(c)[int(i)].as_buffer(), np.uint8) for c in ("ba", "bb"))
                    near[i] = _may_link(ba, na[i], bb, nb[i])
                yield batch.select(["a", "b"]).filter(pa.array(near))

    allowed = 100 * F.least("na", "nb") >= 75 * F.greatest("na", "nb")
    return both.filter(allowed).select("a", "b", "na", "nb", "sa", "sb", "ba", "bb").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets.

    texts: doc_id, text of every document in a pair. The members of a star are dealt out in parts, so that one
    document with very many partners is spread; a task holds one star's set and one batch of members.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_PART).alias("parts"))
    members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.col("b").alias("doc_id"), F.lit(1).alias("turn"))
    stars = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc_id"), F.lit(0).alias("turn"))
    rows = members.unionByName(stars).join(texts, "doc_id").select("a", "part", "turn", "doc_id", "text")
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, held = None, []  # the sets of the star's texts: several only if a doc_id has several texts
        for table in ex.flushes(batches, limit=2 << 20):
            h, off = shingle_sets(table.column("text"))
            left, right = [], []
            for i, (a, turn, b) in enumerate(zip(*(table.column(c).to_pylist() for c in ("a", "turn", "doc_id")), strict=True)):
                own = h[off[i] : off[i + 1]]
                if not turn:
                    held = [*held, own] if star == a else [own]
                    star = a
                    continue
                assert star == a
                common = [int(ex.within(x, own).sum()) for x in held]
                if any(c and 100 * c >= percent * (len(own) + len(x) - c) for c, x in zip(common, held, strict=True)):
                    left.append(a)
                    right.append(b)
            yield pa.record_batch({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every end of a link (a, b): the smallest id that it is connected with.

    Alternates large stars (link larger neighbours to the smallest one) and small stars (link smaller neighbours to
    it) until nothing changes; each round is a table in the shared folder. Neighbours are never gathered in a row.
    """
    edges = ex.materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", small=True)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = ex.materialise(small, "stars", small=True)
        # done if each id points to one other, and none of these points on
        ends = after.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("begins")), F.struct(F.col("b").alias("id"), F.lit(0).alias("begins")))).alias("e"))
        ends = ends.groupBy("e.id").agg(F.sum("e.begins").alias("n"), F.min("e.begins").alias("only"))
        if ends.filter("n > 1 OR (n = 1 AND only = 0)").limit(1).count() == 0:
            break
        edges = after
    return after.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(after.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels after these links between their components; a small graph, of the components that the links join."""
    named = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"l{side}"))
    ends = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    joined = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    every = ends.select(F.col("a").alias("id"), F.col("la").alias("label")).unionByName(ends.select(F.col("b").alias("id"), F.col("lb").alias("label"))).unionByName(labels.select("id", "label")).distinct()
    return every.join(joined.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))


def _across(hits: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of near signatures whose ends share a key and are in different components, each once."""
    own = reps.select("a", "n_shingles", "symbols", "bits").join(labels.withColumnRenamed("id", "a"), "a", "left")
    own = own.withColumn("label", F.coalesce("label", "a")).withColumn("band", F.floor(F.log("n_shingles") / BAND).cast("long"))
    named = hits.join(own.select("a", "label", "band"), "a")
    # members of a key's largest component need not meet each other; sets that may be linked are in the same band or in neighbouring ones
    per = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = per.groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("major")).filter("labels > 1").select("key", "major")
    rows = named.join(mixed, "key").select("key", "a", "band", (F.col("label") == F.col("major")).cast("long").alias("is_major"))
    sizes = rows.groupBy("key", "is_major", "band").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    cell = lambda i: (F.col("is_major") * (1 << 24) + F.col("band")) * (1 << 32) + i
    cells = sizes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.select("key", F.col("is_major").alias("other_major"), F.col("band").alias("other_band"), cell(F.col("i")).alias("other"))
    rows = rows.join(sizes, ["key", "is_major", "band"]).withColumn("block", cell(F.pmod(F.xxhash64("a"), F.col("parts"))))
    # a member goes to each pair of its cell with another one, or with itself, that may hold links across components
    rows = rows.join(cells, "key").filter("abs(band - other_band) <= 1 AND is_major + other_major < 2")
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "a")
    rows = rows.join(own.drop("band"), "a").select("key", "lo", "hi", "block", "a", "label", "n_shingles", "symbols", "bits")
    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "a")

    def pairs_of(table: pa.Table) -> pa.RecordBatch:
        """Near pairs of whole groups of rows with the same key and blocks."""
        key, lo, hi, block, a, label, n = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "a", "label", "n_shingles"))
        symbols = np.frombuffer(b"".join(table.column("symbols").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        keys = index_keys(symbols).view(np.int64)
        which = (keys == key[:, None]).argmax(axis=1)
        bits = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits").combine_chunks()]
        width = np.array([len(x) for x in bits])
        begins = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        ends = np.repeat(np.r_[begins[1:], len(key)], np.diff(np.r_[begins, len(key)]))
        left, right = [], []
        for i in range(len(key)):
            other = np.arange(i + 1, ends[i])
            other = other[label[other] != label[i]] if len(other) else other
            if lo[i] != hi[i]:
                other = other[block[other] != block[i]]
            other = other[100 * np.minimum(n[other], n[i]) >= 75 * np.maximum(n[other], n[i])]
            if not len(other):
                continue
            other = other[(symbols[other] == symbols[i]).sum(axis=1) >= LEAST_EQUAL]
            if not len(other):
                continue
            other = other[(keys[other] == keys[i]).argmax(axis=1) == which[i]]  # only under the first key that both have
            for w in np.unique(width[other]):
                some = other[width[other] == w]
                some = some[_may_link(bits[i], n[i], np.stack([bits[j] for j in some]), n[some])]
                left += [a[i]] * len(some)
                right += a[some].tolist()
        return pa.record_batch({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of a group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            key, lo, hi = (batch.column(c).to_numpy() for c in ("key", "lo", "hi"))
            last = np.flatnonzero((key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (cut or any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("key", "lo", "hi"))):
                yield pairs_of(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            elif cut:
                yield pairs_of(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield pairs_of(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id long, text string, others ignored).

    Links documents whose sets of distinct 5-word shingles have 100 * intersection >= percent * union; component_id is
    the smallest doc_id reachable over links, kept is doc_id = component_id. percent must be 75 at least. A document
    without words (null, empty or blank) has no shingles, is linked with nothing and is kept; fewer words than five make
    one shingle. Rows with a null doc_id are kept, without a component and without links. Rows that repeat a doc_id are
    one document in the graph, and each is returned. An empty table gives an empty result. Sets are compared by 64-bit
    hashes of shingles.
    """
    if percent < 75:
        raise ValueError("signatures are made for a percentage of 75 or more")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketches = ex.materialise(sketch(docs), "sketches")
    known = sketches.filter("doc_id IS NOT NULL AND set_hash IS NOT NULL")
    # one row a class by aggregation alone: copies are merged before they are dealt out
    one = F.struct("n_shingles", "symbols", "bits")
    classes = known.groupBy("set_hash").agg(F.min("doc_id").alias("a"), F.count("*").alias("copies"), F.min_by(one, "doc_id").alias("x"))
    classes = ex.materialise(classes.select("set_hash", "a", "copies", "x.*"), "classes")
    reps = classes.select("a", "n_shingles", "symbols", "bits")

    keys = _keys(reps)
    stars = keys.groupBy("key").agg(F.min("a").alias("star"), F.count("*").alias("n")).filter("n > 1").select("key", "star")
    hits = ex.materialise(keys.join(stars, "key"), "hits")
    first = hits.filter("a <> star").select(F.col("star").alias("a"), F.col("a").alias("b")).distinct()
    first = ex.materialise(_near(first, reps).distinct(), "stars", small=True)

    texts = ex.materialise(_texts(docs.filter("doc_id IS NOT NULL"), hits.select("a").distinct()), "texts")
    links = ex.materialise(confirm(first, texts, percent), "links", small=True)
    labels = components(links)
    second = _across(hits.select("key", "a"), labels, reps).distinct().join(first, ["a", "b"], "left_anti")
    more = ex.materialise(confirm(ex.materialise(second, "across"), texts, percent), "links", small=True)
    if more.limit(1).count():
        labels = _merged(labels, more)

    label = classes.join(labels.select(F.col("id").alias("a"), "label"), "a", "left").select("set_hash", "copies", F.coalesce("label", "a").alias("label"))
    rows = sketches.select("doc_id", "n_shingles", "set_hash")
    # A class with a thousandth of all rows or more is hot; there are a thousand of them at most, so they are broadcast.
    least = max(1, -(-sketches.count() // HOT))
    hot = label.filter(F.col("copies") >= least).select("set_hash", F.col("label").alias("hot"))
    marked = rows.join(F.broadcast(hot), "set_hash", "left")
    rest = marked.filter("hot IS NULL AND set_hash IS NOT NULL").drop("hot").join(label.filter(F.col("copies") < least).drop("copies"), "set_hash", "left")
    out = rest.unionByName(marked.filter("hot IS NOT NULL OR set_hash IS NULL").withColumnRenamed("hot", "label"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents with these ids (column a), each text of an id once."""
    bits = ex.group_bits(docs)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("a").to_numpy().astype(np.int64)
            parts = list(ex.by_group(pa.Table.from_batches([batch]), wanted >> bits))
            blobs = [ex.sorted_blob(np.sort(t.column("a").to_numpy().astype(np.int64).view(np.uint64))) for _, t in parts]
            yield pa.record_batch({"g": pa.array([g for g, _ in parts], pa.int64()), "data": pa.array(blobs, pa.binary())})

    def pick(g: int, table: pa.Table, wanted: np.ndarray) -> pa.Table:
        own = table.column("doc_id").to_numpy().view(np.uint64)
        table, own = table.take(pa.array(some := np.flatnonzero(ex.within(wanted, own)))), own[some]
        if len(np.unique(own)) == len(own):
            return table
        seen = dict.fromkeys(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True))
        return pa.table({"doc_id": pa.array([i for i, _ in seen], pa.int64()), "text": pa.array([t for _, t in seen], pa.string())})

    answers = ids.mapInArrow(asked, ex.PACKED)
    return ex.meeting(ex.packed(docs, bits), answers, pick, "doc_id long, text string")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates, the one with the smallest doc_id, with the columns of docs.

    Nulls, empty and long texts, ties, repeated rows and empty tables: as in near_duplicates; rows without a doc_id and all
    rows of a kept doc_id stay. Other columns may have any name.
    """
    kept = near_duplicates(docs).filter("kept").select("doc_id")
    known = docs.join(kept.filter("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    return known.unionByName(docs.filter("doc_id IS NULL")).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM docs
),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.k = b.k AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least l ON l.a = s.doc_id
"""

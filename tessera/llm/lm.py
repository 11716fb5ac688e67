"""Language-model scores by stupid backoff.

Counts of n-grams over the whole corpus are tables partitioned by hash. Each group of documents joins its distinct n-grams
with them, in packed blocks (see _exchange) in place of a row per n-gram, and sums the logarithms per document. A document
is scored by the counts of all others: its own occurrences are taken off, so an n-gram that it alone has backs off to a
shorter one.

The lengths are counted level by level: words and pairs first, then one length a level. An n-gram that two documents have
is made of two shorter ones that both have, so of each further length only those are sent whose two parts another document
has; what is left out is never counted elsewhere, and no count changes by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _exchange as ex
from tessera.llm._text import Words, mix, utf8

#: The factor of each step back, and the words of the longest n-grams.
BACKOFF, ORDER = 0.4, 3
_PAIR = np.uint64(0x9FB21C651E98DF25)
#: Larger groups than elsewhere share more n-grams, of which each is sent once.
GROUP_BYTES = 2 << 20
_SENT = "bucket int, g long, data binary, counts binary"
_ANSWER = "g long, bucket int, data binary"


def _elsewhere(keys: np.ndarray, unique: np.ndarray, total: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Count of each n-gram over all documents but the one it stands in. unique, total: the group's n-grams and their corpus counts."""
    place = np.searchsorted(unique, keys)
    _, inverse, own = np.unique(docs * len(unique) + place, return_inverse=True, return_counts=True)
    return total[place] - own[inverse]


class Grams:
    """The n-grams of some texts, by their last words, and how often other documents have them, as far as that is known."""

    def __init__(self, texts: pa.ChunkedArray):
        self.words = Words(*utf8(texts))
        self.doc = self.words.doc
        self.whole = [self.words.hashes()]  # by length: hash of the n-gram that ends at each word (0 if it would begin in another text)
        self.place = np.arange(len(self.doc)) - np.repeat(self.words.off[:-1], self.words.counts)
        self.others: list[np.ndarray] = []  # by length: count elsewhere of the n-gram that ends at each word

    def _of_length(self, n: int) -> np.ndarray:
        while len(self.whole) < n:
            k = len(self.whole)
            at = np.flatnonzero(self.place >= k)
            longer = np.zeros(len(self.doc), np.uint64)
            longer[at] = mix(self.whole[-1][at - 1] * (_PAIR + np.uint64(2 * (k - 1))) + self.whole[0][at])
            self.whole.append(longer)
        return self.whole[n - 1]

    def level(self, lengths: range) -> list[np.ndarray]:
        """For each length of a level the words at which its n-grams end. Levels come one after the other, with learn() between."""
        out = []
        for n in lengths:
            at = np.flatnonzero(self.place >= n - 1)
            if n > 2:
                parts = self.others[n - 2] > 0
                at = at[parts[at] & parts[at - 1]]
            out.append(at)
        return out

    def keys(self, lengths: range) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of a level, and how often these texts have them."""
        return np.unique(np.concatenate([self._of_length(n)[at] for n, at in zip(lengths, self.level(lengths), strict=True)]), return_counts=True)

    def learn(self, lengths: range, n_buckets: int, answers: list[tuple[int, bytes]]) -> None:
        """Takes up how often other groups have a level's n-grams."""
        unique, total = self.keys(lengths)
        which, cut = ex.cuts(unique, n_buckets)
        begin = dict(zip(which.tolist(), cut[:-1].tolist(), strict=True))
        for bucket, blob in answers:
            n = ex.unsmall(blob)
            total[begin[bucket] : begin[bucket] + len(n)] += n
        for n, at in zip(lengths, self.level(lengths), strict=True):
            found = np.zeros(len(self.doc), np.int64)
            found[at] = _elsewhere(self._of_length(n)[at], unique, total, self.doc[at])
            self.others.append(found)


def levels(order: int) -> list[range]:
    """The lengths that are counted together."""
    return [range(1, min(order, 2) + 1), *(range(n, n + 1) for n in range(3, order + 1))]


def _addressed(g: int, keys: np.ndarray, n: np.ndarray, n_buckets: int) -> pa.Table:
    which, at = ex.cuts(keys, n_buckets)
    cut = list(zip(at[:-1], at[1:], strict=True))
    return pa.table({
        "bucket": pa.array(which.astype(np.int32)), "g": pa.array(np.full(len(which), g, np.int64)),
        "data": pa.array([ex.sorted_blob(keys[a:b]) for a, b in cut], pa.binary()), "counts": pa.array([ex.small(n[a:b]) for a, b in cut], pa.binary()),
    })


def counts(docs: DataFrame, n_buckets: int, lengths: range, bits: int) -> DataFrame:
    """(bucket, g, data, counts): each group's distinct n-grams of the first level with their counts, by bucket of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in ex.flushes(batches):
            for g, part in ex.by_group(table, ex.group_of(table, bits)):
                yield from _addressed(g, *Grams(part.column("text")).keys(lengths), n_buckets).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, _SENT)


def joined(sent: DataFrame) -> DataFrame:
    """(g, bucket, data): to each group how often other groups have its n-grams, in the order of the n-grams' hashes.

    The hashes need not come back: a group knows its n-grams, and which bucket has them.
    """

    def run(table: pa.Table) -> pa.Table:
        blobs = [ex.sorted_values(x.as_buffer()) for x in table.column("data")]
        n = np.concatenate([ex.unsmall(x.as_buffer()) for x in table.column("counts")])
        h = np.concatenate(blobs)
        g = np.repeat(table.column("g").to_numpy(), [len(b) for b in blobs])
        order = np.lexsort((h, g))  # a group's rows of several tasks come together
        h, n, g = h[order], n[order], g[order]
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        h, n, g = h[new], np.add.reduceat(n, new), g[new]
        order = np.argsort(h, kind="stable")
        first = np.r_[True, h[order][1:] != h[order][:-1]]
        others = np.empty(len(h), np.int64)
        others[order] = np.add.reduceat(n[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        others -= n
        at = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
        bucket = table.column("bucket")[0].as_py()
        return pa.table({
            "g": pa.array(g[at[:-1]]), "bucket": pa.array([bucket] * (len(at) - 1), pa.int32()),
            "data": pa.array([ex.small(others[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
        })

    return sent.groupBy("bucket").applyInArrow(run, _ANSWER)


def score(docs: DataFrame, backoff: float = BACKOFF, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_backoff and log_score of each row of docs (doc_id long, text string, others ignored).

    log_score sums over the words the logarithm of count(n-gram) / count(n-gram without its last word), for the longest n-gram
    of at most order words that ends there and that another document has; at a single word of count(word) / words of all
    other documents. Each word by which it is shorter than order, and than the text up to there, gives a factor of backoff. A
    word that no other document has counts as one, and an empty rest of the corpus as one word. n_backoff counts the words
    that were not scored by an n-gram of order words. A null, empty or blank text has no words and a score of 0. Rows that repeat a doc_id are documents
    of their own; null ids too. An empty table gives an empty result. N-grams are told apart by 64-bit hashes. A text of any
    length, and all rows of one doc_id, are held by one task; rows without one are spread by their texts.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bits = ex.group_bits(docs, GROUP_BYTES)
    n_buckets = 2 * ex.bucket_count(docs)  # a bucket's n-grams are held at once

    def meet(table: pa.Table, known: list[range]) -> tuple[pa.Table, Grams]:
        """A group's documents and their n-grams, after what the answers of these levels say."""
        rows = list(zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("data"), strict=True))
        part = ex.unpack([x.as_buffer() for kind, _, x in rows if kind == 0])
        grams = Grams(part.column("text"))
        for i, lengths in enumerate(known, 1):
            grams.learn(lengths, n_buckets, [(bucket, x.as_buffer()) for kind, bucket, x in rows if kind == i])
        return part, grams

    def sender(i: int):
        return lambda table: _addressed(table.column("g")[0].as_py(), *meet(table, every[:i])[1].keys(every[i]), n_buckets)

    def sum_up(table: pa.Table) -> pa.Table:
        part, grams = meet(table, every)
        doc, place = grams.doc, grams.place
        longest = np.minimum(place, order - 1)  # words before this one that an n-gram can have
        used = np.zeros(len(doc), np.int64)
        terms = np.log(np.maximum(grams.others[0], 1).astype(float)) + longest * np.log(backoff)
        for k in range(1, order):
            n = grams.others[k]
            to = np.flatnonzero(n > 0)
            terms[to] = np.log(n[to].astype(float)) - np.log(np.maximum(grams.others[k - 1][to - 1], 1).astype(float)) + (longest[to] - k) * np.log(backoff)
            used[to] = k
        sums = lambda x: np.bincount(doc, x, len(part))
        return pa.table({"doc_id": part.column("doc_id"), "n_words": pa.array(grams.words.counts.astype(np.int64)), "n_backoff": pa.array(sums(used < order - 1).astype(np.int64)),
                         "n_single": pa.array(sums(used == 0).astype(np.int64)), "logs": pa.array(sums(terms).astype(float))})

    every = levels(order)
    blocks = ex.packed(docs, bits).select("g", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("bucket"), "data")
    if len(every) > 1:
        blocks = ex.materialise(blocks, "blocks")
    met = blocks
    for i, lengths in enumerate(every):
        if i == 0:
            sent = counts(docs, n_buckets, lengths, bits)
        else:
            sent = met.groupBy("g").applyInArrow(sender(i), _SENT)
        answers = ex.materialise(joined(sent), "counts").select("g", F.lit(i + 1).alias("kind"), "bucket", "data")
        met = met.unionByName(answers)
    sums = ex.materialise(met.groupBy("g").applyInArrow(sum_up, "doc_id long, n_words long, n_backoff long, n_single long, logs double"), "scores")
    total = sums.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]  # one number
    rest = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double")
    return sums.select("doc_id", "n_words", "n_backoff", (F.col("logs") - F.col("n_single") * F.log(rest)).alias("log_score"))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_backoff, log_score (six digits) of every document."""
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("log_score", F.round("log_score", 6))


SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
triples AS (SELECT *, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT count(*) AS n FROM words),
counted AS (
  SELECT p.doc_id, p.i, d.n_words,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY p.doc_id, w) AS cw,
    CASE WHEN v IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY p.doc_id, v, w) END AS cp,
    CASE WHEN u IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY p.doc_id, u, v, w) END AS ct
  FROM triples p JOIN (SELECT doc_id, len(ws) AS n_words FROM docs) d ON d.doc_id = p.doc_id
),
before AS (SELECT *, lag(cw) OVER d AS cv, lag(cp) OVER d AS cuv FROM counted WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
terms AS (
  SELECT doc_id, CASE WHEN ct > 0 THEN 0 ELSE 1 END AS b,
    CASE WHEN ct > 0 THEN ln(ct) - ln(cuv) WHEN cp > 0 THEN ln(cp) - ln(cv) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
      ELSE ln(greatest(cw, 1)) + least(i - 1, 2) * ln(0.4) - ln(greatest(n.n - n_words, 1)) END AS t
  FROM before, n
)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(sum(t.b), 0)::BIGINT AS n_backoff, round(coalesce(sum(t.t), 0), 6) AS log_score
FROM docs d LEFT JOIN terms t ON t.doc_id = d.doc_id GROUP BY d.doc_id, len(d.ws)
"""

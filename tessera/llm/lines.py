"""Line dedup by overlapping windows of three lines.

Windows of three consecutive lines are hashed, repeated ones found over the whole corpus, and the lines that later
occurrences cover are removed; overlapping occurrences merge into one covered stretch. Groups of consecutive documents
exchange packed distinct hashes (see _exchange): a window that a smaller group holds is later in this one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _exchange as ex
from tessera.llm._text import Words, _BYTES, _Powers, _BLOCK, mix, spans, utf8, windows


class Lines:
    """\\n-split lines of a batch of texts, blank ones too; off[i]:off[i + 1] are the lines of text i. An empty text has one line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        inner = np.searchsorted(breaks, offsets)  # breaks before each text
        self.counts = np.diff(inner) + 1
        self.off = np.r_[0, np.cumsum(self.counts)]
        n = self.off[-1]
        self.starts, self.ends = np.empty(n, np.int64), np.empty(n, np.int64)
        self.starts[self.off[:-1]] = offsets[:-1]
        self.ends[self.off[1:] - 1] = offsets[1:]
        owner = np.repeat(np.arange(len(self.counts)), np.diff(inner))
        place = np.arange(len(breaks)) - inner[0] + owner + 1 if len(breaks) else np.zeros(0, np.int64)
        self.starts[place] = breaks + 1
        self.ends[place - 1] = breaks
        words = Words(data, offsets)
        self.blank = np.searchsorted(words.starts, self.ends) == np.searchsorted(words.starts, self.starts)
        self.data = data

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + _BLOCK, side="right")))
            lo, hi = self.starts[at], self.ends[to - 1]
            up, down = _Powers.upto(int(hi - lo) + 1)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTES[self.data[lo:hi]] * up[: hi - lo], out=total[1:])
            s, e = self.starts[at:to] - lo, self.ends[at:to] - lo
            out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            at = to
        return mix(out)


def _windows(table: pa.Table, size: int) -> tuple[Lines, np.ndarray, np.ndarray]:
    """Lines, the numbers of the lines where windows begin, and the windows' hashes; windows of blank lines don't count."""
    lines = Lines(*utf8(table.column("text")))
    left = np.repeat(lines.off[1:], lines.counts) - np.arange(len(lines.starts))
    full = windows(lines.hashes(), size)
    filled = np.cumsum(np.r_[0, ~lines.blank])
    n = len(full)
    some = filled[size : size + n] > filled[:n]
    at = np.flatnonzero((left[:n] >= size) & some)
    return lines, at, full[at]


def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """The rows of docs with the lines removed that a repeated window covers, and n_lines, n_removed.

    Lines are split at \\n and compared whole. A window is `size` consecutive lines of a document, not all of them
    without a word. Of equal windows the first by (doc_id, place) stays; the lines of all others go, judged on the
    input. The lines left are joined by \\n again; a document may be left empty. A null text stays null, with no lines;
    an empty one has one line. Rows that repeat a doc_id follow each other by the digests of their texts. A row without a
    doc_id comes after all that have one, and keeps what only other rows without one have. Other columns stay, whatever
    their names (n_lines and n_removed of the input are replaced). Windows are compared by 64-bit hashes. An empty table
    gives an empty result. A text of any length is held whole by one task, and so are all rows of one doc_id.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    names = {c: f"r{i}" for i, c in enumerate(rest)}  # plain names on the way through Arrow
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    n_buckets, bits = ex.bucket_count(docs), ex.group_bits(docs)

    def windows_of(table: pa.Table) -> np.ndarray:
        return _windows(table, size)[2]

    def remove(g: int, table: pa.Table, known: np.ndarray) -> pa.Table:
        ids = table.column("doc_id").fill_null(ex.NO_ID).to_numpy()
        if len(np.unique(ids)) < len(ids):
            digests = np.array([hashlib.md5((t or "").encode()).hexdigest() for t in table.column("text").to_pylist()])
            table = table.take(pa.array(np.lexsort((digests, ids))))
        elif (ids[1:] < ids[:-1]).any():
            table = table.take(pa.array(np.argsort(ids, kind="stable")))
        lines, at, keys = _windows(table, size)
        later = ex.within(known, keys)
        same = lines.doc[at] if g >= ex.NULL_GROUP else np.zeros(len(at), np.int64)
        order = np.lexsort((at, same, keys))
        k, d = keys[order], same[order]
        later[order] |= np.r_[False, (k[1:] == k[:-1]) & (d[1:] == d[:-1])] if len(k) else np.zeros(0, bool)
        mask = np.zeros(len(lines.starts), bool)
        mask[at[later]] = True
        gone = spans(mask, size)
        null = table.column("text").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        n_removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), lines.off[:-1])
        texts = table.column("text").to_pylist()
        for i in np.flatnonzero(n_removed):
            drop = gone[lines.off[i] : lines.off[i + 1]]
            texts[i] = "\n".join(x for x, d in zip(texts[i].split("\n"), drop, strict=True) if not d)
        out = table.set_column(table.column_names.index("text"), "text", pa.array(texts, pa.string()))
        return out.append_column("n_lines", pa.array(np.where(null, 0, lines.counts))).append_column("n_removed", pa.array(n_removed))

    schema = docs.withColumns({"n_lines": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    schema = type(schema)([type(f)(f.name, f.dataType, True) for f in schema])
    answers = ex.answered(ex.sent(docs, windows_of, n_buckets, bits), later_only=True)
    found = ex.meeting(ex.packed(docs, bits), answers, remove, schema)
    return found.select("doc_id", "text", *(F.col(n).alias(c) for c, n in names.items()), "n_lines", "n_removed")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without repeated lines, with the columns of docs; n_chars follows the text.

    Nulls, empty and long texts, ties, repeated rows, empty tables and other columns: as in dedup_lines. No row goes.
    """
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in fresh]  # doc_id at least; the text goes once
    rows = docs.select(F.struct(*rest).alias("_all"), "doc_id", "text")
    return dedup_lines(rows).select(*((fresh[c] if c in fresh else F.col("_all").getField(c)).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every document."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
),
wins AS (
  SELECT doc_id, i, n, l, lead(l, 1) OVER d AS l2, lead(l, 2) OVER d AS l3 FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
late AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY l, l2, l3 ORDER BY doc_id, i) AS r FROM wins
    WHERE i + 2 <= n AND regexp_matches(l || l2 || l3, '[^\x20\x09-\x0D]')
  ) WHERE r > 1
),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM late),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.l END, chr(10) ORDER BY l.i), '') AS kept
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

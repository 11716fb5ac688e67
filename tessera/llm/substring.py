"""Removal of passages that an earlier document holds, found through difference-cover anchors.

{0, 1, 3} is a difference cover modulo 7: for any two positions i and j some k < 7 puts both i + k and j + k on it. So if
documents share `width` consecutive words, they share an anchor of width - 6 words that begins on a cover position in
both. Only anchors (3 of 7 positions) are exchanged over the whole corpus; windows of `width` words are hashed and
exchanged just where an anchor is known elsewhere, which is the extension of the match.

Steps: (1) every group of documents sends its distinct anchors to buckets of the hash space and learns which of them
other groups hold; (2) documents meet these answers, documents without a shared anchor are finished, the others are kept
with a mark on each window around a shared anchor; (3) marked windows are sent likewise, a group learns which of them a
smaller group holds, and removes covered words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _exchange as ex
from tessera.llm._text import Words, mix, spans, utf8, windows

#: A smallest difference cover and its period.
PERIOD, COVER = 7, (0, 1, 3)

_FOUND = "kind int, g long, data binary, doc_id long, n_words long, n_removed long, kept string"
_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _anchors(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors (numbers of words) and their hashes."""
    size = width - PERIOD + 1
    place = np.arange(len(hashes)) - np.repeat(words.off[:-1], words.counts)
    on = np.isin(place % PERIOD, COVER) & (words.left() >= size)
    at = np.flatnonzero(on)
    return at, mix(windows(hashes, size)[at] + np.uint64(size)) if len(at) else np.zeros(0, np.uint64)


def _several(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Sorted keys that more than one document has."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    return np.unique(k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])])


def _kept(text: bytes, keep: np.ndarray | None) -> str:
    parts = text.split()
    return b" ".join(parts if keep is None else compress(parts, keep)).decode()


def dedup_substrings(docs: DataFrame, width: int = 13) -> DataFrame:
    """Removes each word covered by a window of `width` words that also begins in a document with a smaller doc_id.

    docs: doc_id long, text string, others ignored. Returns doc_id, n_words, n_removed and kept, the words left joined
    by single spaces. Windows are judged on the input. A null text has no words; a null doc_id counts as larger than
    all others (and as equal to other nulls); rows that repeat a doc_id do not remove each other's words. An empty table
    gives an empty result. width must be 7 at least. Windows are compared by 64-bit hashes. A text of any length is held
    whole by one task, and so are all rows of one doc_id; rows without one are spread by their texts.
    """
    if width < PERIOD:
        raise ValueError(f"width must be at least {PERIOD}")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_buckets, bits = ex.bucket_count(docs), ex.group_bits(docs)

    def anchors_of(table: pa.Table) -> np.ndarray:
        words = Words(*utf8(table.column("text")))
        return _anchors(words, words.hashes(), width)[1]

    def extend(g: int, table: pa.Table, known: np.ndarray) -> pa.Table:
        ids = table.column("doc_id").fill_null(ex.NO_ID).to_numpy()
        words = Words(*utf8(table.column("text")))
        hashes, doc = words.hashes(), words.doc
        at, keys = _anchors(words, hashes, width)
        hit = ex.within(known, keys)
        hit |= ex.within(_several(keys, ids[doc[at]]), keys)
        near = np.zeros(len(hashes), bool)  # windows that hold a shared anchor: they begin up to 6 words before it
        shared = at[hit]
        for k in range(PERIOD):
            start = shared - k
            start, own = start[start >= 0], doc[shared[start >= 0]]
            near[start[doc[start] == own]] = True
        near &= words.left() >= width
        open_docs = np.zeros(len(ids), bool)
        open_docs[doc[near]] = True
        done = np.flatnonzero(~open_docs)
        text = table.column("text")
        rows = [_rows(0, g, doc_id=table.column("doc_id").take(pa.array(done)), n_words=words.counts[done], n_removed=np.zeros(len(done), np.int64), kept=[_kept(_bytes(text, i), None) for i in done])]
        still = np.flatnonzero(open_docs)
        if len(still):
            marks = pa.array([np.packbits(near[words.off[i] : words.off[i + 1]]).tobytes() for i in still], pa.binary())
            rows.append(_rows(1, g, data=[ex.pack(table.take(pa.array(still)).append_column("marks", marks))]))
        return pa.concat_tables(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, blob in zip(batch.column("g").to_pylist(), batch.column("data"), strict=True):
                table = ex.unpack([blob.as_buffer()])
                words = Words(*utf8(table.column("text")))
                marks = [np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(table.column("marks").to_pylist(), words.counts, strict=True)]
                marked = np.flatnonzero(np.concatenate(marks))
                yield ex.addressed(g, np.unique(windows(words.hashes(), width)[marked]), n_buckets)

    def remove(g: int, table: pa.Table, known: np.ndarray) -> pa.Table:
        ids = table.column("doc_id").fill_null(ex.NO_ID).to_numpy()
        words = Words(*utf8(table.column("text")))
        full, doc = windows(words.hashes(), width), words.doc[: max(0, len(words.starts) - width + 1)]
        valid = np.flatnonzero(words.left()[: len(full)] >= width)
        keys, owner = full[valid], ids[doc[valid]]
        later = ex.within(known, keys)
        order = np.lexsort((owner, keys))
        k, o = keys[order], owner[order]
        first = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
        least = o[np.flatnonzero(first)][np.cumsum(first) - 1] if len(k) else o
        later[order] |= o > least
        mask = np.zeros(len(words.starts), bool)
        mask[valid[later]] = True
        keep = ~spans(mask, width)
        text = table.column("text")
        n_removed = np.add.reduceat(np.r_[~keep, False].astype(np.int64), words.off[:-1]) * (words.counts > 0) if len(ids) else np.zeros(0, np.int64)
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(words.counts.astype(np.int64)), "n_removed": pa.array(n_removed),
                         "kept": pa.array([_kept(_bytes(text, i), keep[words.off[i] : words.off[i + 1]]) for i in range(len(ids))], pa.string())})

    anchors = ex.answered(ex.sent(docs, anchors_of, n_buckets, bits), later_only=False)
    found = ex.materialise(ex.meeting(ex.packed(docs, bits), anchors, extend, _FOUND), "substrings")
    pending = found.filter("kind = 1").select("g", "data")
    answers = ex.answered(pending.mapInArrow(send, ex.SENT), later_only=True)
    changed = ex.meeting(pending, answers, remove, _RESULT)
    return found.filter("kind = 0").select("doc_id", "n_words", "n_removed", "kept").unionByName(changed)


def _bytes(text: pa.ChunkedArray, i: int) -> bytes:
    value = text[int(i)].as_py()
    return value.encode() if value else b""


def _rows(kind: int, g: int, **given) -> pa.Table:
    types = {"data": pa.binary(), "doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
    n = len(next(iter(given.values())))
    cols = {"kind": pa.array([kind] * n, pa.int32()), "g": pa.array([g] * n, pa.int64())}
    for name, type_ in types.items():
        value = given.get(name)
        if value is None:
            value = pa.nulls(n, type_)
        elif not isinstance(value, pa.Array | pa.ChunkedArray):
            value = pa.array(value, type_)
        cols[name] = value
    return pa.table(cols)


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
wins AS (SELECT doc_id, i, string_agg(w, ' ') OVER r AS k, count(*) OVER r AS n FROM words WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM wins WHERE n = 13) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM late),
kept AS (SELECT w.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN w.w END, ' ' ORDER BY w.i), '') AS kept FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until a leaf is short; leaves are encoded on their own. Two neighbours are joined by re-encoding a window
around their border and keeping the tokens outside. The window grows until the tokens outside provably stay:

* Between a character that is no white space and a white space after it the splitting pattern always ends a match, and no
  match before looks past it. So it does between letters, digits and other characters, except after an apostrophe, which
  may begin a match with letters. A window that begins and ends at such places changes nothing outside.
* Within one long run of letters, of digits or of other characters the window grows token by token. A token sequence is the
  encoding of its bytes exactly if each pair of neighbours encodes to itself, so the window may end where the pairs at its
  ends do.

Decoding concatenates the bytes of halves up the same kind of tree. Neither direction needs more memory than a text and
its tokens; the depth is logarithmic.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _exchange as ex

#: Code points of a leaf when encoding, tokens of a leaf when decoding.
LEAF = 1024
#: Bytes of text that are encoded, and rows that are decoded, before they are passed on.
STEP, ROWS = 1 << 20, 256
#: White space as the pattern's \s has it, beyond what str.isspace() agrees on: fixed values.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
#: Fixed value: the pattern whose runs of letters, digits and other characters are known to be matches of their own.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _is_space(c: str) -> bool:
    return c.isspace() and c not in _NO_SPACE


def _kind(c: str) -> str:
    """L, N, O: letter, digit, other; what is white space is not asked."""
    return "L" if c.isalpha() else "N" if unicodedata.category(c)[0] == "N" else "O"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines: token in base64, rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class TreeBPE:
    """Encoder and decoder; only leaves and windows go to the sequential encoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        import tiktoken

        self.leaf = max(2, leaf)
        self.runs = pattern == RUNS
        self.sequential = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self._pairs: dict[tuple[int, int], bool] = {}

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.sequential.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        a, b = self._ends_near(text, lo, mid, hi, 64)
        if a < 0 or b < 0:
            merged = self._join_match(text, lo, mid, hi, left, right)
            if merged is not None:
                return merged
            a, b = self._ends_near(text, lo, mid, hi, 4 * self.leaf)
            a, b = a if a >= 0 else self._end_before(text, lo, mid, lo), b if b >= 0 else self._end_after(text, mid, hi, hi)
        window = self.sequential.encode_ordinary(text[a:b])
        keep_left = self._tokens_from_end(left, len(text[a:mid].encode()))
        keep_right = self._tokens_from_start(right, len(text[mid:b].encode()))
        return left[: len(left) - keep_left] + window + right[keep_right:]

    def _ends_near(self, text: str, lo: int, mid: int, hi: int, most: int) -> tuple[int, int]:
        """The nearest places around mid where matches must end, in windows of growing reach; -1 where there is none."""
        a, b, reach = mid, mid, 8
        while True:
            a = self._end_before(text, max(lo, mid - reach), min(a, mid), lo)
            b = self._end_after(text, max(b, mid), min(hi, mid + reach), hi)
            if (a >= 0 and b >= 0) or reach >= most or (mid - reach <= lo and mid + reach >= hi):
                return a, b
            a, b, reach = a if a >= 0 else mid, b if b >= 0 else mid, reach * 2

    def _ends(self, text: str, p: int) -> bool:
        """Whether a match must end before text[p], whatever stands around."""
        before, after = text[p - 1], text[p]
        if _is_space(before) or _is_space(after):
            return _is_space(after) and not _is_space(before)
        return self.runs and _kind(before) != _kind(after) and not (before == "'" and after.isalpha())

    def _end_before(self, text: str, lo: int, start: int, bound: int) -> int:
        """The last p in (lo, start] where a match must end, bound if lo reaches it, else -1."""
        for p in range(start, lo, -1):
            if bound < p < len(text) and self._ends(text, p):
                return p
        return bound if lo <= bound else -1

    def _end_after(self, text: str, start: int, hi: int, bound: int) -> int:
        for p in range(start, hi):
            if p > 0 and self._ends(text, p):
                return p
        return bound if hi >= bound else -1

    def _join_match(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int] | None:
        """Joins inside one long match, token by token; None if the characters around the border are not of one class."""
        k = 2
        while k < len(left) and k < len(right):
            n_left, n_right = (sum(self.length[t] for t in side) for side in (left[-k:], right[:k]))
            raw = b"".join(self.bytes_of[t] for t in (*left[-k:], *right[:k]))
            if not self._one_match(text, lo, mid, hi, n_left + 8, n_right + 8):
                return None
            window = self.sequential._encode_single_piece(raw)
            if self._stays(left[-k - 1], window[0]) and self._stays(window[-1], right[k]):
                return left[:-k] + window + right[k:]
            k *= 2
        return None

    def _one_match(self, text: str, lo: int, mid: int, hi: int, n_left: int, n_right: int) -> bool:
        """Whether the characters around the border are of one kind, so that they are part of one match."""
        around = text[max(lo, mid - n_left) : min(hi, mid + n_right)]
        if around.isalpha():
            return True
        kind = _kind(around[0])
        return self.runs and all(not _is_space(c) and _kind(c) == kind for c in around)

    def _stays(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            known = self.sequential._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self._pairs) < 100_000:
                self._pairs[a, b] = known
        return known

    def _tokens_from_end(self, tokens: list[int], n_bytes: int) -> int:
        n = 0
        while n_bytes > 0:
            n += 1
            n_bytes -= self.length[tokens[-n]]
        assert n_bytes == 0
        return n

    def _tokens_from_start(self, tokens: list[int], n_bytes: int) -> int:
        n = 0
        while n_bytes > 0:
            n_bytes -= self.length[tokens[n]]
            n += 1
        assert n_bytes == 0
        return n

    def decode(self, tokens: list[int]) -> bytes:
        if len(tokens) <= self.leaf:
            return self.sequential.decode_bytes(tokens)
        mid = len(tokens) // 2
        return self.decode(tokens[:mid]) + self.decode(tokens[mid:])


_LOADED: dict = {}


def _coder(key: tuple, data: bytes) -> TreeBPE:
    if key not in _LOADED:
        _LOADED[key] = TreeBPE(read_ranks(data), key[1], key[2])
    return _LOADED[key]


def _with_coder(docs: DataFrame, ranks_path: str, pattern: str | None, leaf: int, schema, each: Callable, sized_by: str | None = "text") -> DataFrame:
    """each(coder, batch) over batches of about STEP bytes in the column sized_by, or of ROWS rows."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(ranks_path, "rb") as file:
        data = file.read()
    ranks = docs.sparkSession.sparkContext.broadcast(data)  # as large as the vocabulary
    key = (hashlib.sha256(data).hexdigest(), pattern, leaf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(key, ranks.value)
        if sized_by:
            parts = (t.combine_chunks().to_batches()[0] for t in ex.flushes(batches, sized_by, STEP))
        else:
            parts = (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS))
        for part in parts:
            yield each(coder, part)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (array of int), the tokens of each whole text, without special tokens.

    docs: doc_id long, text string, others ignored. A null or empty text has no ids; rows and null doc_ids stay as they
    are, repeated ones too. ranks_path: a file of base64 tokens and ranks that the driver can read.
    """

    def each(coder: TreeBPE, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [coder.encode(t or "") for t in batch.column("text").to_pylist()]
        return pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _with_coder(picked, ranks_path, pattern, leaf, "doc_id long, ids array<int>", each)


def with_counts(docs: DataFrame, ranks_path: str, name: str, pattern: str | None = None, leaf: int = LEAF) -> DataFrame:
    """docs with the number of tokens of each whole text in column `name`; a null text has none. Columns need plain names."""

    def each(coder: TreeBPE, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [len(coder.encode(t or "")) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, name])

    kept = docs.select(*(c for c in docs.columns if c != name)).withColumn("text", F.col("text").cast("string"))
    return _with_coder(kept, ranks_path, pattern, leaf, kept.withColumn(name, F.lit(None).cast("long")).schema, each)


def decode(tokens: DataFrame, ranks_path: str, pattern: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id and decoded (binary) of rows with doc_id and ids; null ids give no bytes. Ids must be of the vocabulary."""

    def each(coder: TreeBPE, batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [coder.decode(i or []) for i in batch.column("ids").to_pylist()]
        return pa.record_batch({"doc_id": batch.column("doc_id"), "decoded": pa.array(out, pa.binary())})

    return _with_coder(tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), ranks_path, pattern, leaf, "doc_id long, decoded binary", each, sized_by=None)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (binary): encoded, then decoded.

    As encode() and decode() in one pass, so that the ids need no way through the JVM as lists.
    """

    def each(coder: TreeBPE, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, packed, decoded = [], [], []
        for text in batch.column("text").to_pylist():
            ids = coder.encode(text or "")
            raw = np.array(ids, "<u4").tobytes()
            counts.append(len(ids))
            packed.append(raw)
            decoded.append(coder.decode(np.frombuffer(raw, "<u4").tolist()))
        return pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(packed, pa.binary()), "decoded": pa.array(decoded, pa.binary())})

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _with_coder(picked, ranks_path, pattern, leaf, "doc_id long, n_tokens long, ids binary, decoded binary", each)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, n_tokens, ids (binary), and whether they decode to the text again.

    A null or empty text has no ids; rows, repeated ones and null doc_ids too, stay as they are; other columns, whatever
    their names, go; an empty table gives an empty result. A text of any length is encoded whole by one task.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def each(coder: TreeBPE, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, packed, same = [], [], []
        for text in batch.column("text").to_pylist():
            ids = coder.encode(text or "")
            counts.append(len(ids))
            packed.append(np.array(ids, "<u4").tobytes())
            same.append(coder.decode(ids) == (text or "").encode())
        return pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(packed, pa.binary()), "round_trip": pa.array(same, pa.bool_())})

    return _with_coder(picked, path, None, LEAF, "doc_id long, n_tokens long, ids binary, round_trip boolean", each)


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    out = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: SQL has no BPE; tests hold the query against the sequential encoder.
SQL = None

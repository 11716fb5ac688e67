"""Vectorised word splitting and hashing of Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, so UTF-8 text can be split on its bytes.
All functions work on one Arrow batch; memory is a small multiple of the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 20
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step & _MASK
    return out


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    up = down = np.ones(0, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _BLOCK)
            cls.up, cls.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a batch of texts: starts and ends in bytes, and off[i]:off[i + 1] are the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        begins, closes = inside.copy(), inside
        begins[1:] &= ~inside[:-1] | _marks(len(data), offsets[:-1])[1:]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | _marks(len(data) + 1, offsets[1:])[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        self.off = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.off)

    @property
    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def left(self) -> np.ndarray:
        """How many words of the same text begin here or later."""
        return np.repeat(self.off[1:], self.counts) - np.arange(len(self.starts))

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words; equal words have equal hashes in any batch."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + _BLOCK, side="right")))
            lo, hi = self.starts[at], self.ends[to - 1]
            up, down = _Powers.upto(int(hi - lo) + 1)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTES[self.data[lo:hi]] * up[: hi - lo], out=total[1:])
            s, e = self.starts[at:to] - lo, self.ends[at:to] - lo
            out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _STEP
            at = to
        return mix(out)


def _marks(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at[at < n]] = True
    return out


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each word, for all but the last n - 1 (texts not told apart)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= _STEP
        out += hashes[k : m + k]
    return mix(out)


def spans(mask: np.ndarray, width: int) -> np.ndarray:
    """Marks every position covered by a window of this width that begins at a marked one."""
    out = np.zeros(len(mask) + width, np.int32)
    at = np.flatnonzero(mask)
    out[at] += 1
    np.subtract.at(out, at + width, 1)
    return np.cumsum(out)[: len(mask)] > 0

"""Words, word hashes and n-gram hashes of whole Arrow text columns, without a Python loop over words.

Every function works on the bytes of many texts at once. A text is never cut: batches are
sliced between rows, and one very long text makes one slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
_M = 0x9E3779B97F4A7C55
_M_INV = pow(_M, -1, 1 << 64)
_C = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _lower(byte: int) -> int:
    return byte + 32 if 0x41 <= byte <= 0x5A else byte


def byte_values(is_word: np.ndarray) -> np.ndarray:
    """A random 64-bit value per byte; A-Z share those of a-z and separators have 0."""
    v = mix(np.array([_lower(b) + 1 for b in range(256)], dtype=U) * U(0xA0761D6478BD642F))
    return np.where(is_word, v, U(0))


#: Words of [^\x20\x09-\x0D]+ after lower-casing A-Z.
SPACED = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= _lower(b) <= 0x7A for b in range(256)])

_pow = np.ones(1, dtype=U), np.ones(1, dtype=U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if len(_pow[0]) < n:
        with np.errstate(over="ignore"):
            _pow = tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, m, U)]), dtype=U) for m in (_M, _M_INV))
    return _pow


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 row offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about `most` text bytes."""
    _, off = raw(batch.column(column))
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of the texts of one slice: hashes, and for text i the range bounds[i]:bounds[i + 1] of words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, is_word: np.ndarray = SPACED, hashed: bool = True):
        self.data, self.off = data, off
        cls = is_word[data]
        n = len(data)
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        edge = np.empty(n + 1, dtype=bool)
        edge[0], edge[n] = True, True
        if n:
            np.not_equal(cls[1:], cls[:-1], out=edge[1:n])
        edge[cuts] = True
        self.starts = np.flatnonzero(cls & edge[:n]) if n else np.empty(0, np.int64)
        self.ends = np.flatnonzero(cls & edge[1:]) + 1 if n else np.empty(0, np.int64)
        self.bounds = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.bounds)
        self.hashes = self._hash(byte_values(is_word)) if hashed else None

    def __len__(self) -> int:
        return len(self.starts)

    def _hash(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=U)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(out):
                s = self.starts[at]
                to = max(at + 1, int(np.searchsorted(self.ends, s + SLICE_BYTES, side="right")))
                piece = values[self.data[s : self.ends[to - 1]]]
                p, inv = _powers(max(len(piece), SLICE_BYTES))
                rel = self.starts[at:to] - s
                out[at:to] = np.add.reduceat(piece * p[: len(piece)], rel) * inv[rel]
                at = to
            return mix(out + (self.ends - self.starts).astype(U) * _C)

    def doc(self) -> np.ndarray:
        """The text's number of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def ngrams(self, n: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of the first word) and hashes of the n-grams that lie within one text."""
        pos = positions(self.bounds, n)
        return pos, gram(self.hashes if h is None else h, pos, n)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of each n-gram; a text of fewer words, but some, gives its whole sequence as one."""
        pos, g = self.ngrams(n)
        d = np.searchsorted(self.bounds, pos, side="right") - 1
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        if len(short):
            parts = []
            for k in range(1, n):
                who = short[self.counts[short] == k]
                parts.append((who, gram(self.hashes, self.bounds[who], k) ^ U(0xA5A5 + k)))
            d = np.concatenate([d, *(p[0] for p in parts)])
            g = np.concatenate([g, *(p[1] for p in parts)])
        return d, g


def positions(bounds: np.ndarray, n: int) -> np.ndarray:
    """Where an n-gram may begin, for texts that hold the words bounds[i]:bounds[i + 1]."""
    room = np.maximum(np.diff(bounds) - n + 1, 0)
    total = int(room.sum())
    return np.repeat(bounds[:-1] - (np.cumsum(room) - room), room) + np.arange(total)


def gram(h: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        c, out = _C, h[pos].copy()
        for j in range(1, n):
            out += h[pos + j] * c
            c = c * _C
        return mix(out)


def distinct_pairs(d: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (d, g), ordered by both."""
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    if len(d):
        keep = np.ones(len(d), bool)
        keep[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
        d, g = d[keep], g[keep]
    return d, g


class Lookup:
    """Membership and place in a sorted array of hashes, found by their leading bits."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys = np.unique(keys.astype(U))
        self.shift = U(64 - bits)
        slots = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.concatenate([[0], np.cumsum(slots)]).astype(np.int32)
        self.most = int(slots.max(initial=0))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices into h that are present, in order, and their places among the keys)."""
        slot = (h >> self.shift).astype(np.int64)
        first, end = self.first[slot], self.first[slot + 1]
        at = np.flatnonzero(end > first)
        first, end, want = first[at], end[at], h[at]
        found = np.full(len(at), -1, np.int64)
        live = np.arange(len(at))
        for k in range(self.most):
            place = first[live] + k
            same = self.keys[place] == want[live]
            found[live[same]] = place[same]
            live = live[~same & (place + 1 < end[live])]
            if not len(live):
                break
        ok = found >= 0
        return at[ok], found[ok]

"""Words and word hashes of an Arrow string column, as numpy arrays.

Works on the column's bytes at once: word bounds from a table of blank bytes,
hashes from one running sum of byte values times powers of an odd number, so
the cost is a few operations per byte whatever the words are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = 0x9E3779B97F4A7C15
_STRIDE = 1 << 19
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Letters only: a-z, A-Z and the bytes of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h):
    """A finalizer of 64-bit values (splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the odd number and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


class Words(NamedTuple):
    """``raw``: the column's bytes; ``texts``: bounds of the rows in it;
    ``starts``, ``ends``: bounds of the words; ``rows``: bounds of the rows in
    words; ``hashes``: one 64-bit hash per word;
    ``prefixes``: per asked length, hashes of the first bytes (0: not longer)."""

    raw: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    prefixes: tuple[np.ndarray, ...] = ()

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def slices(column: pa.Array, most_bytes: int = 1 << 22) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) pieces of about ``most_bytes``; a longer text is a piece of its own."""
    first, size = 0, 0
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > most_bytes:
            yield first, column.slice(first, i - first)
            first, size = i, 0
        size += n
    if first < len(column):
        yield first, column.slice(first)


def words(column: pa.Array, lower: bool, of: np.ndarray = _IS_WORD, prefixes: tuple[int, ...] = ()) -> Words:
    """Runs of the bytes marked in ``of`` (words ``[^\\x20\\x09-\\x0D]+`` by default)
    in each row, none for null, hashed after lower-casing A-Z if ``lower``."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]] if buffers[2] is not None and len(offsets) else np.zeros(0, np.uint8)
    texts = offsets - offsets[0]
    inside = of[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = texts[(texts > 0) & (texts < len(raw))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    heads = tuple(np.zeros(len(starts), np.uint64) for _ in prefixes)
    at = 0
    while at < len(starts):  # strides bound the memory of long columns
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _STRIDE)))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = _power(hi - lo)
        part = raw[lo:hi]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[part] if lower else part] * up, out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        hashes[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for head, n in zip(heads, prefixes):
            longer = np.flatnonzero(e - s > n)
            head[at:to][longer] = mix((sums[s[longer] + n] - sums[s[longer]]) * down[s[longer]] + np.uint64(n * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF))
        at = to
    return Words(raw, texts, starts, ends, np.searchsorted(starts, texts), mix(hashes), heads)


def windows(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` values (rows are not looked at)."""
    out = np.full(max(0, len(hashes) - n + 1), seed, np.uint64)
    for i in range(n if len(out) else 0):
        out *= np.uint64(0xD1B54A32D192ED03 + 2 * seed)
        out += hashes[i:len(hashes) - n + 1 + i]
    return mix(out)


def window_rows(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``n`` words that stay in one row, and their rows."""
    counts = np.maximum(np.diff(rows) - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(rows[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return first + np.arange(len(row)), row

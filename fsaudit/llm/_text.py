"""NumPy kernels over Arrow string columns: words, word hashes, word n-grams.

All kernels work on the UTF-8 buffer of a column, so no Python string is made
per word. Two tokenisations exist:

* ``SPACE``: words are maximal runs of bytes other than space, tab, CR, LF, FF.
* ``ALNUM``: the text is lower-cased; words are maximal runs of ASCII letters,
  digits and non-ASCII characters, so ASCII punctuation separates words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: The power of an offset in a word is taken modulo this, so that one endless word needs no endless table.
_POWERS = 1 << 12

_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 2**64, 256, np.uint64)
_POW = np.cumprod(np.full(_POWERS, 0x9E3779B97F4A7C15, np.uint64))
_TABLE2 = _rng.integers(1, 2**64, 256, np.uint64)

_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: For texts as they were before they were lower-cased; lower-casing changes no character's class, so words keep their numbers.
_CASED = _ALNUM.copy()
_CASED[65:91] = True
CLASSES = {"SPACE": _SPACE, "ALNUM": _ALNUM, "CASED": _CASED}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together; one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some rows: ``start``/``end`` byte offsets in ``data``, ``row`` and ``first`` (index of a row's first word)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str):
        self.data, self.offsets = data, offsets
        rows = len(offsets) - 1
        inside = CLASSES[kind][data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        last = offsets[1:] - 1
        after[last[(last >= 0) & (np.diff(offsets) > 0)]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, second: bool = False) -> np.ndarray:
        """A polynomial hash of each word's bytes."""
        table = _TABLE2 if second else _TABLE
        n, out = len(self.start), np.empty(len(self.start), np.uint64)
        size = self.end - self.start
        total = np.cumsum(size)
        i = 0
        while i < n:
            had = total[i] - size[i]
            j = max(i + 1, int(np.searchsorted(total, had + BLOCK_BYTES, "right")))
            s, k = self.start[i:j], size[i:j]
            at = np.cumsum(k) - k
            rel = np.arange(int(k.sum())) - np.repeat(at, k)
            x = table[self.data[rel + np.repeat(s, k)]]
            x *= _POW[rel & (_POWERS - 1)]
            out[i:j] = np.add.reduceat(x, at) + k.astype(np.uint64)
            i = j
        return mix(out)

    def grams(self, h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside one row, and the index of each run's first word."""
        m = len(h) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        x = h[:m].copy()
        q = np.uint64(base)
        for k in range(1, n):
            x *= q
            x += h[k : k + m]
        return mix(x[at]), at


def lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col)

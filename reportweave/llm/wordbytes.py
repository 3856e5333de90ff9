"""Vectorised word spans and word hashes over the UTF-8 bytes of an Arrow string column.

Every separator used here is ASCII, so words can be found on the bytes without decoding them. A batch is
worked on in blocks of about a megabyte (a longer text forms a block of its own), which bounds the memory
that a task needs by its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_tables: dict[str, np.ndarray] = {}


def separators(spec: str) -> np.ndarray:
    """Boolean table over bytes. 'space': \\x20 and \\x09-\\x0D. 'alnum': ASCII other than 0-9, A-Z and a-z."""
    table = np.zeros(256, bool)
    if spec == "space":
        table[[0x20, *range(0x09, 0x0E)]] = True
    else:
        table[:128] = True
        for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
            table[lo : hi + 1] = False
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser in the manner of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        size = max(n, 2 * BLOCK_BYTES)
        for name, step in (("p", _STEP), ("q", pow(_STEP, -1, 1 << 64))):
            t = np.full(size, step, np.uint64)
            t[0] = 1
            _tables[name] = np.cumprod(t, dtype=np.uint64)
    return _tables["p"], _tables["q"]


@dataclass
class Block:
    """Consecutive rows of a batch. Row i has the bytes data[offsets[i]:offsets[i+1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of an Arrow string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(offsets, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Block(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a block in order; row[i] is the row within the block that word i belongs to."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # first[r]:first[r+1] are the words of row r

    def __len__(self) -> int:
        return len(self.start)


def words(block: Block, sep: np.ndarray) -> Words:
    data, offsets = block.data, block.offsets
    is_word = np.zeros(len(data) + 2, bool)
    is_word[1:-1] = ~sep[data]
    begin = is_word[1:] & ~is_word[:-1]  # at i: a word begins at byte i
    end = is_word[:-1] & ~is_word[1:]
    inner = offsets[1:-1]
    joint = inner[is_word[inner] & is_word[inner + 1]]  # a row's edge between two word bytes
    begin[joint] = True
    end[joint] = True
    start, stop = np.flatnonzero(begin), np.flatnonzero(end)
    first = np.searchsorted(start, offsets, "left")
    row = np.repeat(np.arange(block.rows), np.diff(first))
    return Words(start, stop, row, first)


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    if not len(w):
        return np.zeros(0, np.uint64)
    p, q = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    h = (total[w.end] - total[w.start]) * q[w.start]
    return mix(h + (w.end - w.start).astype(np.uint64) * _MUL)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries of h (len(h) - n + 1 of them), blind to row edges."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(_STEP) + h[i : i + count]
    return mix(out)


def whole_grams(w: Words, n: int) -> np.ndarray:
    """Indexes of the words at which n consecutive words of one row begin."""
    count = len(w) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.row[:count] == w.row[n - 1 :])

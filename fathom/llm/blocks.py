"""Vectorised word hashing over the UTF-8 bytes of a column of texts.

An Arrow string column is one byte buffer with offsets, so words, their hashes
and shingles of a whole batch come from a few numpy passes over that buffer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
_LONG = 64
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but ASCII white space.
SOLID = np.ones(256, dtype=bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words: digits, letters and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(column: pa.Array, most: int = 1 << 20, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of `rows` whole texts at most with
    about `most` bytes, one text at least; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word: a maximal run of bytes of `kind` in one text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    a, b = offsets[:-1][full], offsets[1:][full] - 1
    first[a], last[b] = inside[a], inside[b]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes. Eight bytes
    at a time go through a bijection that isn't linear, and long spans through
    BLAKE2, so that no family of texts collides by its structure."""
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    rest = np.flatnonzero((size > 0) & (size <= _LONG))
    for at in range(0, _LONG, 8):
        if not len(rest):
            break
        left = size[rest] - at
        some = eight[start[rest] + at] & _MASKS[np.minimum(left, 8)]
        out[rest] = mix(out[rest] * np.uint64(0xD6E8FEB86659FD93) + mix(some + np.uint64(0x632BE59BD9B4E019)))
        rest = rest[left > 8]
    for k in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest()
        out[k] = np.uint64(int.from_bytes(digest, "little"))
    return out


def runs(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of the n words from each word on; valid if they are in one text."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, np.uint64(n * 0x51ED270B), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + size]
    return mix(out), text[:size] == text[n - 1 :][:size]

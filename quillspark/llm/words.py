"""Vectorised word hashing over Arrow text columns.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z
lowered.  A word's 64-bit hash takes in eight bytes at a time, each block through a
non-linear mixer, so a chunk of texts costs a few numpy passes and no Python work
per word.  A word of more than ``LONG`` bytes is hashed by BLAKE2b on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  # bytes of text that are hashed at once; a longer text is a chunk of its own

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LONG = 512  # bytes of a word that are hashed in blocks
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, word starts, word ends, first word of each row and the total)."""
    low = _LOWER[raw]
    word = ~_SPACE[low]
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | begins[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | begins[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per span of bytes; equal bytes have equal hashes, wherever they stand."""
    padded = np.concatenate((low, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(low) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    length = ends - starts
    h = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at, left, which = starts, length, None
    for _ in range(LONG // 8):
        h_now = h if which is None else h[which]
        h_now = mix((h_now ^ (eight[at] & _MASK[np.minimum(left, 8)])) + np.uint64(0x9E3779B97F4A7C15))
        if which is None:
            h = h_now
        else:
            h[which] = h_now
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        at, left = at[more] + 8, left[more] - 8
        which = more if which is None else which[more]
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the total)."""
    low, starts, ends, rows = word_spans(raw, offsets)
    return hash_spans(low, starts, ends), rows

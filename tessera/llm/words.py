"""Words of whole Arrow text columns, found and hashed with numpy over the raw UTF-8 bytes.

All word rules here are sets of bytes: separators are ASCII, so cutting the bytes equals cutting the characters.
A word's 64-bit key folds its bytes in blocks of eight, each mixed before the next is added (a sum of powers of any base
would give equal keys to some long words of two letters); words over ``LONG`` bytes take a BLAKE2 digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20          # texts are worked on in slices of about this many bytes; one longer text is one slice
LONG = 64
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_FILLED = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)     # the low k bytes


def byte_set(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SPACES = byte_set([0x20, *range(0x09, 0x0E)])
NOT_SPACE = ~SPACES
#: ASCII digits and letters, and every byte of a non-ASCII character
ALNUM = byte_set([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows holding about ``size`` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    if len(texts) == 0:
        return
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every longest run of member bytes that does not cross a row's border."""
    inside = members[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def marked(n: int, *places: np.ndarray) -> np.ndarray:
    """The distinct numbers below ``n`` among ``places``, ascending."""
    found = np.zeros(n, bool)
    for at in places:
        found[at] = True
    return np.flatnonzero(found)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _block(eights: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    return eights[at] & _FILLED[np.minimum(left, 8)]


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of the byte runs [start, end)."""
    size = ends - starts
    eights = _eights(data)
    made = mix(size.astype(np.uint64) * _LENGTH)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(live):
        left = size[live] - at
        made[live] = mix(made[live] ^ _block(eights, starts[live] + at, left))
        live = live[left > 8]
        at += 8
    for k in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[k]:ends[k]].tobytes(), digest_size=8).digest()
        made[k] = int.from_bytes(digest, "little")
    return made


def same_runs(data: np.ndarray, starts: np.ndarray, other: np.ndarray, begins: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes of ``data`` from each start equal those of ``other`` from each begin."""
    same = np.ones(len(size), bool)
    mine, its = _eights(data), _eights(other)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(live):
        left = size[live] - at
        same[live] &= _block(mine, starts[live] + at, left) == _block(its, begins[live] + at, left)
        live = live[left > 8]
        at += 8
    for k in np.flatnonzero(size > LONG).tolist():
        same[k] = np.array_equal(data[starts[k]:starts[k] + size[k]], other[begins[k]:begins[k] + size[k]])
    return same


def count_by_row(rows: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(rows, minlength=n_rows).astype(np.int64)


def sum_by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte array over each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]

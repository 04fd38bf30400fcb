"""Elias-Fano sequences over numpy arrays: monotone numbers in about 2 + log2(universe / n) bits each, with vectorised
successor search. The arrays may be views of a mapped file."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the (rank + 1)-th set bit of each word."""
    word, rank, place = word.copy(), rank.copy(), np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        go = rank >= low
        rank -= np.where(go, low, 0)
        place += np.where(go, width, 0)
        word = np.where(go, word >> np.uint64(width), word)
    return place


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, one after another, as bytes (eight spare ones at the end)."""
    if not width or not len(values):
        return np.zeros(8, np.uint8)
    places, step = np.arange(width, dtype=np.uint64), 1 << 16      # steps end at whole bytes
    parts = [np.packbits(((values[i:i + step, None] >> places) & _ONE).astype(np.uint8).ravel(), bitorder="little")
             for i in range(0, len(values), step)]
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


def unpack_at(packed: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The values number ``at`` of ``pack_bits`` (width up to 56)."""
    out = np.zeros(len(at), np.uint64)
    if not width:
        return out
    bit = at.astype(np.int64) * width
    byte = bit >> 3
    for k in range((width + 14) // 8):
        out |= packed[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


class EliasFano:
    """``arrays()`` and ``n``, ``width`` are all there is to store."""

    def __init__(self, n: int, width: int, high: np.ndarray, zeros: np.ndarray, low: np.ndarray):
        self.n, self.width, self.high, self.zeros, self.low = n, width, high, zeros, low

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        buckets = (values >> np.uint64(width)).astype(np.int64)
        size = n + (int(buckets[-1]) if n else 0) + 2            # a zero ends every bucket
        words = np.zeros(-(-size // 64) * 64, np.uint8)
        words[buckets + np.arange(n)] = 1
        high = np.packbits(words, bitorder="little").view(np.uint64)
        zeros = np.cumsum(64 - np.bitwise_count(high).astype(np.int64)).astype(np.uint32)
        return cls(n, width, high, zeros, pack_bits(values, width))

    def arrays(self) -> list[np.ndarray]:
        return [self.high, self.zeros, self.low]

    def _before(self, bucket: np.ndarray) -> np.ndarray:
        """Number of values in lower buckets."""
        out = np.zeros(len(bucket), np.int64)
        some = np.flatnonzero(bucket > 0)
        nth = bucket[some] - 1                                   # the zero that ends the bucket before
        total = int(self.zeros[-1])
        beyond = nth >= total
        nth = np.minimum(nth, total - 1)
        word = np.searchsorted(self.zeros, nth, "right")
        earlier = np.where(word > 0, self.zeros[np.maximum(word - 1, 0)], 0).astype(np.int64)
        place = word * 64 + _select_in_word(~self.high[word], nth - earlier)
        out[some] = np.where(beyond, self.n, np.minimum(place - nth, self.n))
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values number ``at``."""
        word_ones = np.arange(1, len(self.high) + 1) * 64 - self.zeros.astype(np.int64)
        word = np.searchsorted(word_ones, at, "right")
        earlier = np.where(word > 0, word_ones[np.maximum(word - 1, 0)], 0)
        place = word * 64 + _select_in_word(self.high[word], at - earlier)
        return ((place - at).astype(np.uint64) << np.uint64(self.width)) | unpack_at(self.low, self.width, at)

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first value not below ``wanted``, whether it equals it)."""
        wanted = wanted.astype(np.uint64)
        bucket = (wanted >> np.uint64(self.width)).astype(np.int64)
        low, high = self._before(bucket), self._before(bucket + 1)
        end = high.copy()
        rest = wanted & np.uint64((1 << self.width) - 1)
        while len(busy := np.flatnonzero(low < high)):
            middle = (low[busy] + high[busy]) // 2
            less = unpack_at(self.low, self.width, middle) < rest[busy]
            low[busy] = np.where(less, middle + 1, low[busy])
            high[busy] = np.where(less, high[busy], middle)
        found = low < end
        found[found] = unpack_at(self.low, self.width, low[found]) == rest[found]
        return low, found

"""Elias-Fano sequences over memory-mapped arrays, with vectorised access and successor search.

A monotone sequence of n values below u keeps the lower ``l = floor(log2(u / n))`` bits of each value in a packed array
and the upper parts in unary: value i sets bit ``(value >> l) + i``. Selecting the i-th one gives a value back, and
selecting zeros gives the range of values that share an upper part. Every 64th one and zero has its word noted.
"""

from __future__ import annotations

import numpy as np

_SAMPLE = 64
_ONE = np.uint64(1)


_LOWS, _HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: The place of the k-th one of a byte, at byte * 8 + k.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for byte in range(256) for k in range(8)], np.int8)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) one of each word: the byte by sums of all bytes at once, the bit by a table."""
    u = np.uint64
    x = word - ((word >> u(1)) & u(0x5555555555555555))
    x = (x & u(0x3333333333333333)) + ((x >> u(2)) & u(0x3333333333333333))
    sums = ((x + (x >> u(4))) & u(0x0F0F0F0F0F0F0F0F)) * _LOWS  # ones up to each byte
    k = k.astype(np.uint64)
    shift = np.bitwise_count(((k * _LOWS | _HIGHS) - sums) & _HIGHS).astype(np.uint64) * u(8)
    k -= ((sums << u(8)) >> shift) & u(0xFF)
    byte = (word >> shift) & u(0xFF)
    return shift.astype(np.int64) + _IN_BYTE[(byte * u(8) + k).astype(np.int64)]


class _Bits:
    """Select of ones or of zeros over 64-bit words with a sample of word numbers."""

    def __init__(self, words: np.ndarray, ranks: np.ndarray, hints: np.ndarray, ones: bool):
        self.words, self.ranks, self.hints, self.ones = words, ranks, hints, ones

    def select(self, i: np.ndarray) -> np.ndarray:
        group = i // _SAMPLE
        at = self.hints[group].astype(np.int64)
        high = self.hints[np.minimum(group + 1, len(self.hints) - 1)].astype(np.int64)
        high = np.where(group + 1 < len(self.hints), high, len(self.words) - 1)
        open_ = np.flatnonzero(at < high)
        while len(open_):  # the last word with no more than i before it
            mid = (at[open_] + high[open_] + 1) >> 1
            up = self._before(mid) <= i[open_]
            at[open_] = np.where(up, mid, at[open_])
            high[open_] = np.where(up, high[open_], mid - 1)
            open_ = open_[at[open_] < high[open_]]
        word = self.words[at]
        return at * 64 + _select_in_word(word if self.ones else ~word, i - self._before(at))

    def _before(self, word: np.ndarray) -> np.ndarray:
        r = self.ranks[word].astype(np.int64)
        return r if self.ones else word * 64 - r


class EliasFano:
    """``parts``: lower bits, words of upper bits, ones before each word, hints for ones, hints for zeros."""

    def __init__(self, n: int, low_bits: int, parts: list[np.ndarray]):
        self.n, self.l = n, low_bits
        self.low, words, ranks, ones, zeros = parts
        self.ones, self.zeros = _Bits(words, ranks, ones, True), _Bits(words, ranks, zeros, False)

    @staticmethod
    def build(values: np.ndarray, universe: int) -> tuple[int, int, list[np.ndarray]]:
        """(n, low bits, parts) of sorted unsigned values below ``universe``."""
        n = len(values)
        values = values.astype(np.uint64)
        l = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * l + 63) // 64 + 1, np.uint64)
        if l:
            lows = values & np.uint64((1 << l) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(l)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, lows << shift)
            over = shift + np.uint64(l) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, lows[over] >> (np.uint64(64) - shift[over]))
        high = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        size = ((universe >> l) + n + 64) // 64 + 1
        words = np.zeros(size, np.uint64)
        np.bitwise_or.at(words, high >> 6, _ONE << (high & 63).astype(np.uint64))
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        zeros = np.arange(size + 1) * 64 - ranks
        pick = lambda r: np.searchsorted(r, np.arange(0, int(r[-1]) + 1, _SAMPLE), "right") - 1
        kind = np.uint32 if size * 64 < 2**32 else np.uint64
        hints = [np.minimum(pick(r), size - 1).astype(kind) for r in (ranks, zeros)]
        return n, l, [low, words, ranks.astype(kind), *hints]

    def _lower(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.l)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> shift
        over = shift + np.uint64(self.l) > np.uint64(64)
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.l) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        high = self.ones.select(i) - i
        return (high.astype(np.uint64) << np.uint64(self.l)) | self._lower(i)

    def _ones_from(self, at: np.ndarray) -> np.ndarray:
        """The ones in a row from each place on."""
        words = self.ones.words
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        zeros = ~(words[word] >> inside)
        out = np.bitwise_count((zeros & (~zeros + _ONE)) - _ONE).astype(np.int64)
        # A run that reaches the word's end goes on in the next.
        rows = np.flatnonzero(out + inside.astype(np.int64) >= 64)
        out[rows] = 64 - inside[rows].astype(np.int64)
        word = word[rows]
        while len(rows):
            word = word + 1
            zeros = ~words[word]
            run = np.bitwise_count((zeros & (~zeros + _ONE)) - _ONE).astype(np.int64)
            out[rows] += run
            rows, word = rows[run == 64], word[run == 64]
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """The places of ``values``, by successor search; -1 where a value isn't in the sequence."""
        if not self.n:
            return np.full(len(values), -1)
        high = (values >> np.uint64(self.l)).astype(np.int64)
        before = np.where(high > 0, self.zeros.select(np.maximum(high - 1, 0)), -1)
        first = before - high + 1
        last = before + 1 + self._ones_from(before + 1) - high
        low = values & np.uint64((1 << self.l) - 1)
        lo, hi = first, last
        open_ = np.flatnonzero(hi - lo > 1)
        while len(open_):  # within the run of equal upper parts the lower parts are sorted: the last that isn't greater
            mid = (lo[open_] + hi[open_]) >> 1
            up = self._lower(mid) <= low[open_]
            lo[open_] = np.where(up, mid, lo[open_])
            hi[open_] = np.where(up, hi[open_], mid)
            open_ = open_[hi[open_] - lo[open_] > 1]
        hit = np.flatnonzero(lo < hi)
        out = np.full(len(values), -1)
        same = hit[self._lower(lo[hit]) == low[hit]]
        out[same] = lo[same]
        return out

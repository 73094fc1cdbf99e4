"""Word hashes of whole texts, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once; a longer text is worked on alone and whole.
CHUNK_BYTES = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, power = 1, base
    while done < n:
        out[done:2 * done] = out[: min(done, n - done)] * np.uint64(power)
        done, power = 2 * done, power * power % (1 << 64)
    return out


_BYTES = np.arange(256)
_WORD = ~np.isin(_BYTES, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_EXACT = mix((_BYTES + 1).astype(np.uint64) * _GOLD)
_VALUES = _EXACT[np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)]
_POWERS = [_powers(_BASE, CHUNK_BYTES + 1), _powers(_INVERSE, CHUNK_BYTES + 1)]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words, words of each text) of texts that lie in ``data`` between ``bounds``; A-Z lower-cased."""
    starts, ends, counts = word_spans(data, bounds)
    return span_hashes(data, starts, ends), counts


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the words of each text."""
    n = len(data)
    inside = np.empty(n + 1, bool)
    inside[:n], inside[n] = _WORD[data], False
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, inside[:n]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of spans: a polynomial of the bytes modulo 2**64, read off one running sum, and mixed."""
    n = len(data)
    while len(_POWERS[0]) <= n:
        _POWERS[:] = [_powers(_BASE, 2 * n + 2), _powers(_INVERSE, 2 * n + 2)]
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_VALUES if fold else _EXACT)[data] * _POWERS[0][:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _POWERS[1][starts] + (ends - starts).astype(np.uint64) * _GOLD)


def text_chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, bounds) of runs of texts of about CHUNK_BYTES; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64) * _GOLD) | np.uint64(1)


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``k`` words, or all words of a shorter text, or none."""
    n = len(hashes)
    ends = np.cumsum(counts)
    rolled = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        rolled += hashes[i:i + len(rolled)] * _MULTIPLIERS[i]
    rolled = mix(rolled + np.uint64(k))
    out = []
    for end, c in zip(ends.tolist(), counts.tolist(), strict=True):
        if c >= k:
            out.append(distinct(rolled[end - c:end - k + 1]))
        elif c:
            one = (hashes[end - c:end] * _MULTIPLIERS[:c]).sum(dtype=np.uint64)
            out.append(mix(np.array([one + np.uint64(c)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

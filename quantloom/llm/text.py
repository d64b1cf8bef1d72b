"""Vectorised text helpers that run inside Arrow tasks.

A batch of texts is handled as one byte buffer with document offsets, so that words and windows
of many documents are found, hashed and compared by array operations, never row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= _GOLDEN
    x ^= x >> np.uint64(32)
    return x


def multipliers(n: int) -> np.ndarray:
    """Odd multipliers of the window hashes, the same in every task."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


_BASE = 0xA24BAED4963EE407
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the word hash's base and of its inverse modulo 2**64, at least n of them; kept between calls."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            full = np.full(max(n, 1 << 17), np.uint64(base))
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """One uint8 buffer of all texts and n + 1 offsets; null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about `limit` bytes, small enough for a core's cache: first document, bytes, offsets."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


@dataclass
class Words:
    """Words of some documents: byte spans, a hash for each word, and each document's first word (n + 1 indexes)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, width: int) -> np.ndarray:
        """True at each word from which `width` words of the same document follow."""
        out = np.zeros(len(self.starts), bool)
        for a, b in zip(self.first[:-1].tolist(), (self.first[1:] - width + 1).tolist(), strict=True):
            if a < b:
                out[a:b] = True
        return out

    def window_hashes(self, width: int) -> np.ndarray:
        """A hash of the `width` words from each word on; meaningful where windows() holds."""
        n = len(self.starts)
        out = np.zeros(n, np.uint64)
        for j, c in enumerate(multipliers(width)):
            if j < n:
                out[: n - j] += self.hashes[j:] * c
        return mix(out)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data - np.uint8(9)) <= 4)


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else unchanged."""
    return data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words are maximal runs of bytes other than space and 0x09-0x0D; `lower` folds A-Z only."""
    if lower:
        data = fold_case(data)
    n = len(data)
    inside = ~is_space(data)
    edge = np.empty(n + 1, bool)  # edge[i]: a word may start or end before byte i
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    runs = inside[at[:-1]] if n else np.zeros(0, bool)
    starts, ends = at[:-1][runs], at[1:][runs]
    powers, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the index of the least of values[i : i + width]: by the upper 48 bits, then the leftmost."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, out = np.uint64((1 << 16) - 1), np.empty(n, np.int64)
    for at in range(0, n, _SEGMENT):
        here = values[at : at + _SEGMENT + width - 1]
        least, span = (here & ~low) | np.arange(len(here), dtype=np.uint64), 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        m = len(here) - width + 1
        out[at : at + m] = (np.minimum(least[:m], least[width - span : width - span + m]) & low).astype(np.int64) + at
    return out

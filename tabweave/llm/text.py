"""Words of Arrow text columns as flat numpy arrays.

A batch of texts becomes one array of word hashes with the index of each text's
first word. Hashes are 64 bits wide and depend on the word's bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
HASH_BYTES = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Bytes of words: all but [\x20\x09-\x0D].
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.full(size, b, np.uint64) for b in (_BASE, _INVERSE))
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column and the offset of each; null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, or one row if that is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each text's first word (one more at the end)."""
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, in blocks of bytes so that wide arrays stay small.

    It sums a mixed value of each byte and its place in the word. A polynomial
    modulo 2**64 would not do: whatever its base, it is equal for some words of
    1,024 letters and their complements.
    """
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, "right")))
        first, last = int(starts[i]), int(ends[j - 1])
        for low in range(first, last, HASH_BYTES):  # more than once for a single long word only
            high = min(low + HASH_BYTES, last)
            origin = first if j == i + 1 else np.repeat(starts[i:j], np.diff(starts[i:j], append=last))
            place = (np.arange(low, high) - origin).astype(np.uint64)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(mix((place << np.uint64(8)) + data[low:high] + np.uint64(1)), out=total[1:])
            a, b = (np.clip(x[i:j] - low, 0, high - low) for x in (starts, ends))
            out[i:j] += total[b] - total[a]
        i = j
    return mix(out)


def words(column, table: np.ndarray = SPACED, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and each text's first word."""
    data, offsets = buffers(column)
    if lower:
        data = LOWER[data]
    starts, ends, firsts = spans(data, offsets, table)
    return hashes(data, starts, ends), firsts


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that start at each word; shorter by n - 1 than ``h``.

    A polynomial of the words' hashes; safe for runs of far fewer than 1,024 words.
    """
    if len(h) < n:
        return np.empty(0, np.uint64)
    up, down = POWERS.upto(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def row_of(firsts: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def hashes_any(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of short stretches in any order, by their bytes and length."""
    out = np.zeros(len(starts), np.uint64)
    n = ends - starts
    for j in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > j)
        out[on] = out[on] * _BASE + data[starts[on] + j] + np.uint64(1)
    return mix(out)

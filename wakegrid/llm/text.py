"""Vectorised work on batches of texts: words, hashes and windows as numpy arrays.

A batch is the UTF-8 bytes of its texts end to end plus the places where texts
begin.  Prefix sums of ``table[byte] * base**place`` (mod 2**64) give the hash
of any byte range in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; longer texts are handled alone.
SLICE_BYTES = 1 << 20

BASE = 0x9E3779B97F4A7C15 | 3
MASK = (1 << 64) - 1


def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 ... mod 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, np.uint64(base & MASK)
    while done < n:
        more = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + more] = out[:more] * step
            step = step * step
        done += more
    return out


class Hasher:
    """Hashes of byte ranges; powers are kept between batches."""

    def __init__(self, seed: int = 1):
        self.table = byte_table(seed)
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(self.up) < n:
            self.up = powers(BASE, n)
            self.down = powers(pow(BASE, -1, 1 << 64), n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.table[data] * self.up[: n - 1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


#: The white space of the contracts: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of rows of at most ``most`` bytes, or one row; null is empty."""
    column = batch.column(batch.schema.get_field_index(text))
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to - at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word and the place in ``start`` at which each text begins."""
    inside = ~space[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = (inside[0], False) if len(data) else (False, False)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[:-1] < offsets[1:])]
    last = offsets[1:][(offsets[:-1] < offsets[1:])] - 1
    starts[first] = inside[first]
    ends[last] = inside[last]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def window_hashes(words: np.ndarray, width: int, salt: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, width):
        out *= np.uint64(salt | 1)
        out += words[j : j + n]
    return mix(out)


def text_of(places: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The text each of the (sorted) word places belongs to."""
    return np.searchsorted(firsts, places, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    big = (out >= 65) & (out <= 90)
    out[big] += 32
    return out


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def in_order(seen: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array ``seen``."""
    if not len(seen):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(seen, values), len(seen) - 1)
    return seen[at] == values

"""Count-min sketches that are built per partition and merged block by block.

A sketch has two rows of ``2**bits`` cells; a cell only tells "none", "one" or
"two or more", which is what a search for repeats asks.  A partition sends its
non-empty cells as sorted, delta-coded blocks, so what is shuffled follows the
data.  The merged sketch is one bit per cell ("two or more"): its size is set by
``bits`` and not by the data, so it can be sent to all tasks.  Counts are only
ever overestimated: what is counted twice is always reported.  When the data
outgrow the cells, more is reported than repeats, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .text import mix

ROWS = 2
BLOCK_BITS = 20
SALTS = (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
MESSAGES = "block int, cells binary, again binary"


def squeeze(values: np.ndarray) -> bytes:
    """Sorted whole numbers below 2**32 in few bytes: differences, split into byte planes, compressed."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype(np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes()) if len(values) else b""


def unsqueeze(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.int64)


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(SALTS[row])) >> np.uint64(64 - bits)).astype(np.int64)


def messages(keys: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, cells with one key, cells with more) of all keys, repeats included."""
    for row in range(ROWS):
        at, many = np.unique(cells(keys, row, bits), return_counts=True)
        block = at >> BLOCK_BITS
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            if b > a:
                low, twice = at[a:b] & ((1 << BLOCK_BITS) - 1), many[a:b] > 1
                yield (row << (bits - BLOCK_BITS)) + int(block[a]), squeeze(low[~twice]), squeeze(low[twice])


def message_batches(chunks: Iterator[np.ndarray], bits: int, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Messages of a stream of key arrays, gathered to at most about ``most`` keys at a time."""

    def batch(held: list[np.ndarray]) -> pa.RecordBatch:
        block, one, more = zip(*messages(np.concatenate(held), bits), strict=True)
        return pa.record_batch([pa.array(block, pa.int32()), pa.array(one, pa.binary()), pa.array(more, pa.binary())], names=["block", "cells", "again"])

    held: list[np.ndarray] = []
    n = 0
    for keys in chunks:
        if len(keys):
            held.append(keys)
            n += len(keys)
        if n >= most:
            yield batch(held)
            held, n = [], 0
    if held:
        yield batch(held)


def merge_block(part: pd.DataFrame) -> pd.DataFrame:
    seen, twice = np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
    for one, more in zip(part["cells"], part["again"], strict=True):
        at = unsqueeze(one)
        twice[at] |= seen[at]
        seen[at] = True
        twice[unsqueeze(more)] = True
    if not twice.any():
        return pd.DataFrame({"block": [], "bitmap": []}).astype({"block": int, "bitmap": object})
    bits = zstandard.ZstdCompressor(level=1).compress(np.packbits(twice, bitorder="little").tobytes())
    return pd.DataFrame({"block": [int(part["block"].iloc[0])], "bitmap": [bits]})


class Sketch:
    """The merged sketch in a task."""

    def __init__(self, held: Broadcast, bits: int):
        self.rows, self.bits = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(ROWS)], bits
        unit = 1 << (BLOCK_BITS - 3)
        for number, data in held.value:
            row, block = divmod(number, 1 << (bits - BLOCK_BITS))
            self.rows[row][block * unit : (block + 1) * unit] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key's estimated count is two or more."""
        out = np.ones(len(keys), bool)
        for row in range(ROWS):
            at = cells(keys, row, self.bits)
            out &= (self.rows[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def merged(sent: DataFrame, bits: int) -> Broadcast:
    """The partitions' messages as one sketch of at most ``ROWS * 2**bits`` bits, sent compressed to all tasks."""
    found = sent.groupBy("block").applyInPandas(merge_block, "block int, bitmap binary").collect()
    return sent.sparkSession.sparkContext.broadcast([(r["block"], bytes(r["bitmap"])) for r in found])

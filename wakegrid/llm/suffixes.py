"""Removal of byte strings that stand anywhere else, by a logarithmic family of suffix arrays.

Every string of ``width`` bytes contains an anchor: the ``HEAD``-byte run of least
hash in it.  Equal strings have equal anchors at equal places, so it is enough to
index the suffixes that begin at anchors, about one in 85 bytes.  The strings with
the same anchor form a stretch; the bytes they cover are its region.

* A sketch of anchor heads leaves out suffixes whose head stands alone.
* Documents come in batches.  A batch gets its suffix array: (head, region, how
  many), ordered by head.  It is merge-scanned against the array of every level,
  heads found on both sides being long matches; then arrays of equal rank merge
  into the next level, so there are at most log2(batches) levels to scan.
* A region that occurs twice is removed with all its strings.  Where regions differ
  but share a head (at the edges of a copy), their strings are compared; a head
  with more regions than one task should hold is compared string by string.

A string may overlap its equal, and may be in the same document.  Matches never
cross documents, and are judged on the input.  Null texts are empty; texts
shorter than ``width`` stay whole.  Rows that repeat a document are other places,
so both lose all.  Rows without a doc_id drop out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sketch import MESSAGES, Sketch, merged, message_batches
from .tables import id_and_text, kept
from .text import SLICE_BYTES, Hasher, mix, slices

HEAD = 32
SKETCH_BITS = 28
#: Regions of a head that one task compares; heads with more are compared string by string.
TOGETHER = 4096
PLACE_BITS = 23


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def chunks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each text, its first byte's place, bytes, offsets); long texts in parts that overlap by ``width - 1``."""
    for at, n, data, offsets in slices(batch):
        if n > 1 or len(data) <= 2 * SLICE_BYTES:
            yield np.arange(at, at + n), np.zeros(n, np.int64), data, offsets
            continue
        for base in range(0, len(data), SLICE_BYTES):
            part = data[base : base + SLICE_BYTES + width - 1]
            if len(part) >= width or not base:
                yield np.array([at]), np.array([base]), part, np.array([0, len(part)])


class Stretches:
    """Of a chunk: the stretches of strings that share an anchor, equal neighbours as one."""

    def __init__(self, hasher: Hasher, data: np.ndarray, offsets: np.ndarray, width: int):
        hasher.load(data)
        counts = np.maximum(np.diff(offsets) - width + 1, 0)
        self.text = self.begin = self.count = np.zeros(0, np.int64)
        self.head = self.region = np.zeros(0, np.uint64)
        if not counts.sum():
            return
        n = len(data) - HEAD + 1
        heads = mix((hasher.sums[HEAD:] - hasher.sums[:-HEAD]) * hasher.down[:n])
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = sliding_min((heads & ~low) | np.arange(n, dtype=np.uint64), width - HEAD + 1)
        text = np.repeat(np.arange(len(counts)), counts)
        start = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][text]
        anchor = (least[start] & low).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(start)))
        begin, text, head = start[first], text[first], heads[anchor[first]]
        region = hasher.ranges(begin, begin + count - 1 + width)
        # a stretch that follows its equal is one with it
        again = np.zeros(len(begin), bool)
        again[1:] = (region[1:] == region[:-1]) & (head[1:] == head[:-1]) & (text[1:] == text[:-1]) & (count[1:] == count[:-1])
        lead = np.flatnonzero(~again)
        self.times = np.diff(np.append(lead, len(begin)))
        self.text, self.begin, self.head, self.region = text[lead], begin[lead], head[lead], region[lead]
        self.count = np.add.reduceat(count, lead)
        #: strings of one of the equal stretches
        self.each = count[lead]


def send_heads(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(3)

        def heads() -> Iterator[np.ndarray]:
            for batch in batches:
                for _, _, data, offsets in chunks(batch, width):
                    s = Stretches(hasher, data, offsets, width)
                    if len(s.head):
                        yield np.repeat(s.head, np.minimum(s.times, 2))

        yield from message_batches(heads(), bits)

    return run


ENTRIES = "head long, region long, times long, doc_id long, begin long, strings long"


def send_entries(held: Broadcast, width: int, bits: int):
    """Stretches whose head may occur twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = Hasher(3), Sketch(held, bits)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, base, data, offsets in chunks(batch, width):
                s = Stretches(hasher, data, offsets, width)
                k = np.flatnonzero(sketch.repeated(s.head))
                if len(k):
                    begin = s.begin[k] - offsets[:-1][s.text[k]] + base[s.text[k]]
                    columns = [s.head[k].view(np.int64), s.region[k].view(np.int64), s.times[k], ids[rows[s.text[k]]], begin, s.count[k]]
                    yield pa.record_batch([pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in columns], names=[x.split()[0] for x in ENTRIES.split(", ")])

    return run


def send_regions(held: Broadcast, width: int, bits: int):
    """Bytes of the regions whose heads are marked in the sketch, each once in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = Hasher(3), Sketch(held, bits)
        for batch in batches:
            for _, _, data, offsets in chunks(batch, width):
                s = Stretches(hasher, data, offsets, width)
                k = np.flatnonzero(sketch.repeated(s.head))
                if len(k):
                    k = k[np.unique(s.region[k], return_index=True)[1]]
                    raw = data.tobytes()
                    said = [raw[a : a + n - 1 + width] for a, n in zip(s.begin[k].tolist(), s.each[k].tolist(), strict=True)]
                    yield pa.record_batch([pa.array(s.head[k].view(np.int64)), pa.array(s.region[k].view(np.int64)), pa.array(said, pa.binary())], names=["head", "region", "bytes"])

    return run


class Family:
    """Suffix arrays of batches in levels of doubling rank."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}
        self.matches: list[DataFrame] = []

    def add(self, entries: DataFrame) -> None:
        """Index a batch; heads that it shares with itself or with a level are matches."""
        array = self.sorted(entries.groupBy("head", "region").agg(F.sum("times").alias("times")))
        own = array.groupBy("head").agg(F.sum("times").alias("n")).where("n > 1").select("head")
        found = [own, *[array.join(level, "head", "left_semi").select("head") for level in self.levels.values()]]
        matches = found[0]
        for more in found[1:]:
            matches = matches.union(more)
        self.matches.append(kept(matches.distinct(), "matches"))
        rank = 0
        while rank in self.levels:
            both = array.union(self.levels.pop(rank)).groupBy("head", "region").agg(F.sum("times").alias("times"))
            array, rank = self.sorted(both), rank + 1
        self.levels[rank] = array

    @staticmethod
    def sorted(array: DataFrame) -> DataFrame:
        """A written suffix array: in the order of heads, so that a scan meets equal heads side by side."""
        return kept(array.repartition("head").sortWithinPartitions("head", "region"), "suffixes")

    def heads(self) -> DataFrame:
        found = self.matches[0]
        for more in self.matches[1:]:
            found = found.union(more)
        return found.distinct()

    def regions(self) -> DataFrame:
        """(head, region, times) of all matched heads, over all levels."""
        levels = list(self.levels.values())
        every = levels[0]
        for level in levels[1:]:
            every = every.union(level)
        return every.join(self.heads(), "head", "left_semi").groupBy("head", "region").agg(F.sum("times").alias("times"))


def window_keys(hasher: Hasher, said: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, number in it, hash) of all strings of some regions."""
    offsets = np.cumsum([0, *map(len, said)])
    hasher.load(np.frombuffer(b"".join(said), np.uint8))
    counts = np.diff(offsets) - width + 1
    owner = np.repeat(np.arange(len(said)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = number + offsets[:-1][owner]
    return owner, number, hasher.ranges(start, start + width)


def runs(numbers: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(numbers) > 1)
    return zip(numbers[np.append(0, cut + 1)].tolist(), numbers[np.append(cut, len(numbers) - 1)].tolist(), strict=True)


def compare_regions(width: int):
    """For regions sorted by head: which strings of a region occur in another region of the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(13)

        def judged(head: int, part: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
            owner, number, keys = window_keys(hasher, [b for _, b in part], width)
            _, inverse, many = np.unique(keys, return_inverse=True, return_counts=True)
            hit = many[inverse] > 1
            owner, number = owner[hit], number[hit]
            cuts = np.searchsorted(owner, np.arange(len(part) + 1))
            for i, (region, _) in enumerate(part):
                if cuts[i + 1] > cuts[i]:
                    for lo, hi in runs(number[cuts[i] : cuts[i + 1]]):
                        yield head, region, lo, hi

        def batch_of(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["head", "region", "lo", "hi"])

        held: list[tuple[int, bytes]] = []
        head, out = None, []
        for batch in batches:
            for h, region, said in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if h != head:
                    if len(held) > 1:
                        out += judged(head, held)
                    head, held = h, []
                held.append((region, said))
            if out:
                yield batch_of(out)
                out = []
        if len(held) > 1:
            out += judged(head, held)
        if out:
            yield batch_of(out)

    return run


def explode_regions(width: int):
    """A row per string of each region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(13)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                owner, number, keys = window_keys(hasher, part.column(2).to_pylist(), width)
                head, region = part.column(0).to_numpy(), part.column(1).to_numpy()
                yield pa.record_batch([pa.array(head[owner]), pa.array(region[owner]), pa.array(number), pa.array(keys.view(np.int64))], names=["head", "region", "number", "key"])

    return run


def repeated_strings(docs: DataFrame, width: int, bits: int, batches: int) -> DataFrame:
    """(doc_id, first, last): starts of strings to remove, as ranges; ``docs`` has doc_id and text."""
    held = merged(docs.mapInArrow(send_heads(width, bits), MESSAGES), bits)
    entries = kept(docs.mapInArrow(send_entries(held, width, bits), ENTRIES).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "entries")
    family = Family()
    for k in range(batches):
        family.add(entries.where(F.col("batch") == k))
    regions = kept(family.regions(), "regions")
    several = regions.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = kept(several, "several")

    # regions that occur once, beside others with the same head: compare their strings
    def marks(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from message_batches((np.repeat(b.column(0).to_numpy().view(np.uint64), 2) for b in batches_), bits)

    marked = merged(several.select("head").mapInArrow(marks, MESSAGES), bits)
    said = docs.mapInArrow(send_regions(marked, width, bits), "head long, region long, bytes binary")
    said = said.groupBy("head", "region").agg(F.first("bytes").alias("bytes")).join(several, "head")
    said = kept(said.select("head", "region", "bytes", "n"), "regions-said")
    few = said.where(F.col("n") <= TOGETHER).select("head", "region", "bytes").repartition("head").sortWithinPartitions("head", "region")
    few = few.mapInArrow(compare_regions(width), "head long, region long, lo long, hi long")
    many = said.where(F.col("n") > TOGETHER).select("head", "region", "bytes").mapInArrow(explode_regions(width), "head long, region long, number long, key long")
    twice = many.groupBy("head", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("head", "key")
    many = many.join(twice, ["head", "key"]).select("head", "region", F.col("number").alias("lo"), F.col("number").alias("hi"))
    whole = regions.where("times > 1").select("head", "region", F.lit(0).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    edges = few.union(many).join(regions.where("times = 1"), ["head", "region"], "left_semi")
    found = entries.join(whole.union(edges), ["head", "region"])
    return found.select("doc_id", (F.col("begin") + F.col("lo")).alias("first"), (F.col("begin") + F.coalesce("hi", F.col("strings") - 1)).alias("last"))


def cut_bytes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            n_bytes, n_removed, n_spans, out = [], [], [], []
            for at, n, data, offsets in slices(batch):
                raw = data.tobytes()
                for i in range(n):
                    text = raw[offsets[i] : offsets[i + 1]]
                    pieces, gone, removed, end = [], 0, 0, 0
                    # spans by their start; those that touch are one
                    joined: list[list[int]] = []
                    for s in sorted((s["first"], s["last"] + width) for s in spans[at + i] or ()):
                        if joined and s[0] <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], s[1])
                        else:
                            joined.append(list(s))
                    for a, b in joined:
                        pieces.append(text[end:a])
                        gone, removed, end = gone + 1, removed + b - a, b
                    pieces.append(text[end:])
                    n_bytes.append(len(text))
                    n_removed.append(removed)
                    n_spans.append(gone)
                    out.append(b"".join(pieces))
            yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def dedup_bytes(docs: DataFrame, width: int = 200, bits: int = SKETCH_BITS, batches: int = 4) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and the bytes kept."""
    texts = id_and_text(docs)
    spans = repeated_strings(texts, width, bits, batches)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return texts.join(spans, "doc_id", "left").mapInArrow(cut_bytes(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

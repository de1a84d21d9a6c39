"""Removal of word windows that an earlier document has.

A window is ``width`` consecutive words of one text.  The words of a window are
removed when the same word sequence starts in a document with a smaller doc_id;
all windows are judged on the input.

1. Each partition sketches the counts of its windows.  A window is counted under
   its head, the run of ``HEAD`` words of least hash in it: neighbours share it, so
   the sketch holds a quarter of the keys, and no window is rarer than its head.
2. Only windows whose merged count may be two or more go on.  Neighbours with one
   head travel together as a region.  Equal regions are grouped exactly: the
   smallest doc_id of each holds for all their windows.  Where regions differ but
   share a head (at the edges of a copy), their windows are grouped one by one; a
   head with more regions than one task should hold is grouped by window.
3. The regions join those groups; Spark splits a region that a large share of the
   documents holds.  The windows to remove go back to their documents.

Null and empty texts have no words.  Texts shorter than a window keep all words.
Rows that repeat a doc_id are the same document: none removes words of another.
Rows without a doc_id drop out.  Columns named in ``carry`` come along unchanged.
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
from .text import Hasher, mix, slices, spread, window_hashes, word_bounds

HEAD = 6
SKETCH_BITS = 28
#: Regions of a head that one task compares; windows of heads with more are grouped one by one.
TOGETHER = 4096
KEY_SALT = 0x9FB21C651E98DF25


class Regions:
    """The regions of a slice of texts: runs of windows with one head, equal neighbours as one."""

    def __init__(self, hasher: Hasher, data: np.ndarray, offsets: np.ndarray, width: int):
        start, end, firsts = word_bounds(data, offsets)
        counts = np.maximum(np.diff(firsts) - width + 1, 0)
        self.head = self.region = np.zeros(0, np.uint64)
        self.text = self.begin = self.count = self.each = np.zeros(0, np.int64)
        if not counts.sum():
            return
        hasher.load(data)
        words = hasher.ranges(start, end)
        text, number = np.repeat(np.arange(len(counts)), counts), spread(counts)
        first = number + firsts[:-1][text]
        heads = window_hashes(words, HEAD)
        least = heads[: len(heads) - width + HEAD].copy()
        for j in range(1, width - HEAD + 1):
            np.minimum(least, heads[j : j + len(least)], out=least)
        least = least[first]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        # a head that recurs is another place; a run is at most as long as a window has heads
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(least)))
        most = width - HEAD + 1
        cuts = np.repeat(at, -(-length // most)) + most * spread(-(-length // most))
        count = np.diff(np.append(cuts, len(least)))
        self.keys = window_hashes(words, width, KEY_SALT)[first]
        # a region is named by its windows
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.keys), dtype=np.uint64)])
        region = mix(mix(sums[cuts + count] - sums[cuts]) + self.keys[cuts] * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
        again = np.zeros(len(cuts), bool)
        again[1:] = (region[1:] == region[:-1]) & (text[cuts][1:] == text[cuts][:-1]) & (cuts[1:] == cuts[:-1] + count[:-1])
        lead = np.flatnonzero(~again)
        self.head, self.region, self.text = least[cuts][lead], region[lead], text[cuts][lead]
        self.begin, self.each, self.place = number[cuts][lead], count[lead], cuts[lead]
        self.count = np.add.reduceat(count, lead)


def send_heads(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        yield from message_batches((Regions(hasher, data, offsets, width).head for batch in batches for _, _, data, offsets in slices(batch)), bits)

    return run


ENTRIES = "head long, region long, doc_id long, begin long, windows long, each long"


def send_entries(held: Broadcast, width: int, bits: int):
    """Regions whose head may occur twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = Hasher(), Sketch(held, bits)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, _, data, offsets in slices(batch):
                r = Regions(hasher, data, offsets, width)
                k = np.flatnonzero(sketch.repeated(r.head))
                if len(k):
                    columns = [r.head[k].view(np.int64), r.region[k].view(np.int64), ids[at + r.text[k]], r.begin[k], r.count[k], r.each[k]]
                    yield pa.record_batch([pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in columns], names=[x.split()[0] for x in ENTRIES.split(", ")])

    return run


def send_keys(held: Broadcast, width: int, bits: int):
    """Window keys of the regions whose heads are marked in the sketch, each region once in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = Hasher(), Sketch(held, bits)
        for batch in batches:
            for _, _, data, offsets in slices(batch):
                r = Regions(hasher, data, offsets, width)
                k = np.flatnonzero(sketch.repeated(r.head))
                if len(k):
                    k = k[np.unique(r.region[k], return_index=True)[1]]
                    many = r.each[k]
                    keys = r.keys[np.repeat(r.place[k], many) + spread(many)].view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(keys))
                    yield pa.record_batch([pa.array(r.head[k].view(np.int64)), pa.array(r.region[k].view(np.int64)), lists], names=["head", "region", "keys"])

    return run


def least_of_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For regions sorted by head: the smallest document of each of their windows, over all regions of the head."""
    held: pa.Table | None = None
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        held = whole if held is None else pa.concat_tables([held, whole])
        head = held.column("head").to_numpy()
        # the last head may go on in the next batch
        done = int(np.searchsorted(head, head[-1])) if len(head) else 0
        if done:
            yield judged(held.slice(0, done))
            held = held.slice(done)
    if held is not None and held.num_rows:
        yield judged(held)


def judged(part: pa.Table) -> pa.RecordBatch:
    part = part.combine_chunks()
    lists = part.column("keys").chunk(0) if part.column("keys").num_chunks == 1 else pa.concat_arrays(part.column("keys").chunks)
    many = np.diff(lists.offsets.to_numpy())
    keys, first = lists.flatten().to_numpy(), np.repeat(part.column("first").to_numpy(), many)
    head = np.repeat(part.column("head").to_numpy(), many)
    order = np.lexsort((first, keys, head))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (head[order][1:] != head[order][:-1])
    least = np.empty(len(order), np.int64)
    least[order] = first[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(least))
    return pa.record_batch([part.column("head").combine_chunks(), part.column("region").combine_chunks(), out], names=["head", "region", "least"])


def send_marks(bits: int):
    """Keys of the first column, so that a sketch reports all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from message_batches((np.repeat(b.column(0).to_numpy().view(np.uint64), 2) for b in batches), bits)

    return run


def windows_to_remove(texts: DataFrame, width: int, bits: int) -> DataFrame:
    """(doc_id, first, last): ranges of window starts, by words."""
    held = merged(texts.mapInArrow(send_heads(width, bits), MESSAGES), bits)
    entries = texts.mapInArrow(send_entries(held, width, bits), ENTRIES)
    regions = entries.groupBy("head", "region").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    regions = kept(regions, "regions")
    several = regions.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("low"), F.max("last").alias("high"))
    several = kept(several.where("n > 1 and low < high").select("head", "n"), "several")
    marked = merged(several.select("head").mapInArrow(send_marks(bits), MESSAGES), bits)
    keys = texts.mapInArrow(send_keys(marked, width, bits), "head long, region long, keys array<long>")
    keys = keys.groupBy("head", "region").agg(F.first("keys").alias("keys"))
    keys = kept(keys.join(regions.drop("last"), ["head", "region"]).join(several, "head"), "region-keys")
    few = keys.where(F.col("n") <= TOGETHER).select("head", "region", "first", "keys").repartition("head").sortWithinPartitions("head", "region")
    few = few.mapInArrow(least_of_windows, "head long, region long, least array<long>")
    many = keys.where(F.col("n") > TOGETHER).select("head", "region", "first", F.posexplode("keys").alias("number", "key"))
    least = many.groupBy("head", "key").agg(F.min("first").alias("least"))
    many = many.join(least, ["head", "key"]).groupBy("head", "region").agg(F.sort_array(F.collect_list(F.struct("number", "least"))).alias("l")).select("head", "region", F.col("l.least").alias("least"))
    alone = regions.where("first < last").join(several, "head", "left_anti").select("head", "region", F.array("first").alias("least"))
    found = entries.join(few.union(many).union(alone), ["head", "region"])
    found = found.where(F.array_min("least") < F.col("doc_id"))
    every = F.array(F.struct(F.col("begin").alias("first"), (F.col("begin") + F.col("windows") - 1).alias("last")))
    # window t of equal regions side by side is window t mod ``each`` of the region
    chosen = F.filter(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1), lambda t: F.col("least")[(t % F.col("each")).cast("int")] < F.col("doc_id"))
    single = F.transform(chosen, lambda t: F.struct((F.col("begin") + t).alias("first"), (F.col("begin") + t).alias("last")))
    ranges = F.when(F.array_max("least") < F.col("doc_id"), every).otherwise(single)
    return found.select("doc_id", F.explode(ranges).alias("r")).select("doc_id", "r.first", "r.last")


def cut_words(width: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(batch.schema.get_field_index("ranges")).to_pylist()
            n_words, n_removed, out = [], [], []
            for at, n, data, offsets in slices(batch):
                raw = data.tobytes()
                for i in range(n):
                    words = raw[offsets[i] : offsets[i + 1]].split()
                    n_words.append(len(words))
                    if ranges[at + i]:
                        depth = np.zeros(len(words) + 1, np.int32)
                        np.add.at(depth, [r["first"] for r in ranges[at + i]], 1)
                        np.add.at(depth, [r["last"] + width for r in ranges[at + i]], -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
                    n_removed.append(n_words[-1] - len(words))
                    out.append(b" ".join(words))
            made = {"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(out, pa.binary()).cast(pa.string())}
            made |= {c: batch.column(batch.schema.get_field_index(f"carried_{c}")) for c in carry}
            yield pa.record_batch(list(made.values()), names=list(made))

    return run


def dedup_substrings(docs: DataFrame, width: int = 13, bits: int = SKETCH_BITS, carry: list[str] | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_removed, kept_text and the columns of ``carry``.

    ``docs`` is read several times, so it should be a stored table; ``width`` is
    at least ``HEAD``.  The sketch that is sent to the tasks takes ``2**(bits - 2)``
    bytes, whatever the data.
    """
    carry = list(carry or [])
    ranges = windows_to_remove(id_and_text(docs), width, bits)
    ranges = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    whole = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(["doc_id long, n_words long, n_removed long, kept_text string", *[f"`{c}` {kinds[c]}" for c in carry]])
    return whole.join(ranges, "doc_id", "left").mapInArrow(cut_words(width, carry), schema)

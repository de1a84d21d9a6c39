"""Benchmark decontamination: lookup of item shingles, then exact similarity of windows.

For each benchmark item, windows of as many words as the item has (or the whole
text, if it has fewer) are held against it.  Candidates come from an inverted index
of the items' ``width``-word shingles.  All windows of a candidate are verified by
weighted Jaccard similarity of shingles (how often each stands in the window and in
the item).  SimHash is not used to search, as a radius would lose windows; the
distance of the fingerprints is given for what was found.

Windows are taken only where a text has at least ``percent`` % of an item's
shingles (by count): elsewhere no window can be similar enough.

The items are sent to the tasks in parts of at most ``PART`` rows, whatever the
size of the benchmark; a pass over the documents is made for each part.  Null and
empty texts and items have no shingles and match nothing; of rows that repeat an
item one counts.  Words are as in the Jaccard join: lower-case A-Z, split at
white space; fewer than ``width`` words are one shingle, so that an item that
short is found only where it is the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import id_and_text
from .text import Hasher, lower_ascii, slices, window_hashes, word_bounds

BLOCKS = 8
PART = 5000
FOUND = "doc_id long, item_id long, start long, n_words long, distance long, similarity double"


def shingles_of(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of one word sequence, in order."""
    if len(words) >= width:
        return window_hashes(words, width)
    return window_hashes(words, len(words), 0x2545F4914F6CDD1D) if len(words) else np.zeros(0, np.uint64)


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle and bit."""
    return np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(total: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of ``BLOCKS`` bytes, from sums of signs."""
    return np.packbits(total > 0, axis=1)


class Items:
    """A part of the benchmark: shingles with counts, their inverted index, and fingerprints."""

    def __init__(self, rows: list[tuple[int, str]], width: int):
        hasher = Hasher()
        self.ids, self.words, self.shingles, self.weights = [], [], [], []
        prints = []
        for item, text in rows:
            data = lower_ascii(np.frombuffer((text or "").encode(), np.uint8))
            start, end, _ = word_bounds(data, np.array([0, len(data)]))
            if not len(start):
                continue
            hasher.load(data)
            found = shingles_of(hasher.ranges(start, end), width)
            keys, counts = np.unique(found, return_counts=True)
            self.ids.append(item)
            self.words.append(len(start))
            self.shingles.append(keys)
            self.weights.append(counts)
            prints.append(fingerprints(signs(found).sum(0, keepdims=True))[0])
        self.prints = np.array(prints, np.uint8).reshape(len(prints), BLOCKS)
        self.need = np.array([int(c.sum()) for c in self.weights], np.int64)
        # shingle -> items
        every = np.concatenate([*self.shingles, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(self.ids)), [len(k) for k in self.shingles])
        order = np.lexsort((owner, every))
        self.keys, first = np.unique(every[order], return_index=True)
        self.owners, self.first = owner[order], np.append(first, len(every))


def shared_shingles(place: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Shingles that each window of ``n`` shares with an item: of each at most its weight; ``place`` is its number in the item or -1."""
    at = np.flatnonzero(place >= 0)
    order = np.argsort(place[at], kind="stable")
    at, keys = at[order], place[at][order]
    # one counts in the windows that hold it, but not as many equal ones before it as the weight
    back = np.arange(len(at)) - weights[keys]
    full = (back >= 0) & (keys[np.maximum(back, 0)] == keys)
    first = np.maximum(np.where(full, at[np.maximum(back, 0)] + 1, 0), np.maximum(at - n + 1, 0))
    change = np.bincount(first, minlength=len(place) + 1) - np.bincount(at + 1, minlength=len(place) + 1)
    return np.cumsum(change)[: len(place) - n + 1]


def best_window(items: Items, k: int, shingles: np.ndarray, starts: np.ndarray, n: int, percent: int) -> tuple[int, int, float] | None:
    """(start, distance, similarity) of the most similar window of ``n`` shingles at ``starts``."""
    keys, weights, size = items.shingles[k], items.weights[k], int(items.need[k])
    at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
    shared = shared_shingles(np.where(keys[at] == shingles, at, -1), weights, n)[starts]
    s = int(np.argmax(shared))
    most = int(shared[s])
    union = n + size - most
    if 100 * most < percent * union:
        return None
    start = int(starts[s])
    own = fingerprints(signs(shingles[start : start + n]).sum(0, keepdims=True))[0]
    return start, int(np.unpackbits(own ^ items.prints[k]).sum()), most / union


def search(held, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hasher = Items(held.value, width), Hasher()
        if not len(items.keys):
            return
        maybe = np.zeros(1 << 22, bool)
        maybe[(items.keys >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            ids, out = batch.column(0).to_numpy(), []
            for at, n, data, offsets in slices(batch):
                data = lower_ascii(data)
                start, end, firsts = word_bounds(data, offsets)
                if not len(start):
                    continue
                hasher.load(data)
                words = hasher.ranges(start, end)
                found = window_hashes(words, width)
                hits = np.flatnonzero(maybe[(found >> np.uint64(42)).astype(np.int64)])
                text = np.searchsorted(firsts, hits, "right") - 1
                hits = hits[hits + width <= firsts[1:][text]]
                # short texts have one shingle of their own
                short = np.flatnonzero((np.diff(firsts) > 0) & (np.diff(firsts) < width))
                keys = np.concatenate([found[hits], np.array([shingles_of(words[firsts[i] : firsts[i + 1]], width)[0] for i in short], np.uint64)])
                text = np.concatenate([np.searchsorted(firsts, hits, "right") - 1, short])
                k = np.minimum(np.searchsorted(items.keys, keys), len(items.keys) - 1)
                real = items.keys[k] == keys
                k, text = k[real], text[real]
                many = items.first[k + 1] - items.first[k]
                place = np.repeat(items.first[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                pairs, shared = np.unique(np.repeat(text, many) * len(items.ids) + items.owners[place], return_counts=True)
                enough = 100 * shared >= percent * items.need[pairs % len(items.ids)]
                for i, item in zip((pairs[enough] // len(items.ids)).tolist(), (pairs[enough] % len(items.ids)).tolist(), strict=True):
                    own = shingles_of(words[firsts[i] : firsts[i + 1]], width)
                    size = min(items.words[item], int(firsts[i + 1] - firsts[i]))
                    m = max(size - width + 1, 1)
                    # windows that hold one of the item's shingles
                    hit = np.flatnonzero(np.isin(own, items.shingles[item]))
                    change = np.bincount(np.maximum(hit - m + 1, 0), minlength=len(own) + 2) - np.bincount(np.minimum(hit, len(own) - m) + 1, minlength=len(own) + 2)
                    starts = np.flatnonzero(np.cumsum(change)[: len(own) - m + 1] > 0)
                    best = best_window(items, item, own, starts, m, percent)
                    if best:
                        out.append((ids[at + i], items.ids[item], best[0], size, best[1], best[2]))
            if out:
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """A row per document row and item found in it: the most similar window, the first of equals.

    ``start`` counts words from 0; ``distance`` is between the fingerprints.
    """
    spark, texts = docs.sparkSession, id_and_text(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = items.groupBy("item_id").agg(F.min("text").alias("text"))
    parts = max(1, -(-items.count() // PART))
    out = None
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).orderBy("item_id").collect()
        held = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part])
        found = texts.mapInArrow(search(held, width, percent), FOUND)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` in which no item was found, all columns kept."""
    leaks = contaminated(docs, benchmark, width, percent).select(F.col("doc_id").alias("leaking")).distinct()
    return docs.where("doc_id is not null").join(leaks, F.col("doc_id") == F.col("leaking"), "left_anti")

"""Importance resampling towards a target: hashed word features counted through an automaton.

Words are runs of letters, digits and all that is not ASCII; features are runs of 1
to ``width`` words joined by a space, and a feature's bucket is its CRC-32 modulo
``buckets``.  A bucket's gain is the logarithm of its smoothed share in the target
over its share in the documents; a document's weight is the sum over its features,
and the highest weights plus Gumbel noise (from a hash of the doc_id) are drawn.

* **Dictionary.**  A task keeps the distinct words it meets in an Aho-Corasick
  automaton.  A key is a word between two delimiters and its payload is one whole
  number: the word's CRC and its length in bytes.  Keys hold delimiters at both ends
  only, so a scan of the delimited text emits the payload of each word once, in order.
* **Composition.**  The CRC of a run of words follows from the payloads of its
  neighbours: appending n bytes multiplies a CRC by x^(8n), done for whole arrays.
  No feature is built as a string.
* **Counting and scoring** are two passes of such scans: one sums buckets for each
  task, of which there are at most ``buckets`` on the driver; the other adds gains.
* **Drawing.**  Scores are dealt by ranges and numbered by the ranges' row counts.

The dictionary is begun anew beyond ``KEPT`` words, and a word of more than ``LONGEST``
bytes gets its payload where it stands, so a task's memory follows one slice of texts
(8 MB, or one text); both change no result.  Null, empty and wordless texts have no
features and weight 0.  Rows that repeat a doc_id are scored and ranked each; rows
without one drop out and count nowhere.  Other columns are not read.  Equal scores:
the smaller doc_id first, then the row with fewer features.  An empty table gives an
empty result, an empty target evens all shares.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import numbered
from .tables import id_and_text, kept

#: Words in a task's dictionary before it is begun anew.
KEPT = 200_000
#: Bytes of a word that goes into the dictionary.
LONGEST = 64
#: Bytes of the texts that are scanned together.
SLICE = 8 << 20

#: Lower case for A-Z, a space for ASCII that is neither letter nor digit.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
OVERLONG = re.compile(rb"[^ ]{%d,}" % (LONGEST + 1))


def doubled(step: np.ndarray) -> np.ndarray:
    """The operator that applies ``step`` twice; an operator is the images of the 32 single bits."""
    return applied(step, step)


def applied(step: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), step[bit], np.uint32(0))
    return out


def operators(count: int = 31) -> list[np.ndarray]:
    """Operators that lengthen a CRC by 1, 2, 4, 8 ... zero bytes, as tables for each of its four bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = np.where(bits & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0)) ^ (bits >> np.uint32(1))
    for _ in range(3):
        step = doubled(step)
    out = []
    for _ in range(count):
        out.append(np.stack([applied(step, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)]))
        step = doubled(step)
    return out


class Crc:
    """CRC-32 of byte strings put together from the CRCs of their parts."""

    def __init__(self):
        self.tables = operators()
        self.space = np.uint32(zlib.crc32(b" "))

    def lengthened(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``crc`` followed by ``length`` bytes that have yet to be added."""
        out = crc.astype(np.uint32)
        for k in range(int(length.max(initial=0)).bit_length()):
            at = np.flatnonzero((length >> k) & 1)
            value = out[at]
            t = self.tables[k]
            out[at] = t[0][value & 255] ^ t[1][(value >> 8) & 255] ^ t[2][(value >> 16) & 255] ^ t[3][value >> 24]
        return out

    def joined(self, crc: np.ndarray, more: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC of a string, a space and a second string with the CRC ``more``."""
        spaced = self.lengthened(crc, np.ones(len(crc), np.int64)) ^ self.space
        return self.lengthened(spaced, length) ^ more


class Dictionary:
    """Payloads (CRC and length) of the words of a text, in order, by automaton."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        import ahocorasick

        self.automaton, self.known = ahocorasick.Automaton(), set()

    def learn(self, words: set[bytes]) -> None:
        new = words - self.known
        if not new:
            return
        if len(self.known) + len(new) > KEPT and self.known:
            self.clear()
            new = words
        for word in new:
            self.automaton.add_word(" " + word.decode("latin-1") + " ", len(word) << 32 | zlib.crc32(word))
        self.known |= new
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place of the end, payload) of each word of a text that is delimited by single-byte spaces."""
        self.learn({word for word in set(text.split()) if len(word) <= LONGEST})
        found = np.zeros((0, 2), np.int64)
        if self.known:
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
        if OVERLONG.search(text):
            long = [(m.end(), m.end() - m.start() << 32 | zlib.crc32(m.group())) for m in OVERLONG.finditer(text)]
            found = np.concatenate([found, np.array(long, np.int64)])
            found = found[np.argsort(found[:, 0])]
        return found[:, 0], found[:, 1]


def portions(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of rows of about ``SLICE`` bytes."""
    texts = [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
    first, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > SLICE:
            yield first, texts[first:k]
            first, held = k, 0
        held += len(text)
    if first < len(texts):
        yield first, texts[first:]


class Features:
    """Buckets of all runs of 1 to ``width`` words of texts."""

    def __init__(self, width: int, buckets: int):
        self.width, self.buckets, self.words, self.crc = width, buckets, Dictionary(), Crc()

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each number of words: the text each feature belongs to, in order, and its bucket."""
        raw = (b" " + b" ".join(texts) + b" ").translate(PLAIN)
        end, payload = self.words.scan(raw)
        begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
        length, crc = payload >> 32, (payload & 0xFFFFFFFF).astype(np.uint32)
        owner = np.searchsorted(begin, end - length, "right") - 1
        run = crc
        for n in range(1, self.width + 1):
            if n > 1:
                whole = owner[n - 1 :] == owner[: max(0, len(owner) - n + 1)]
                run = self.crc.joined(run[: max(0, len(owner) - n + 1)], crc[n - 1 :], length[n - 1 :])
                yield owner[: len(run)][whole], run[whole].astype(np.int64) % self.buckets
            else:
                yield owner, crc.astype(np.int64) % self.buckets


def count_buckets(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(width, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in portions(batch.column(0)):
                for _, bucket in features.of(texts):
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, width: int, buckets: int) -> np.ndarray:
    """Features of all ``texts`` (text) in each bucket."""
    sent = texts.select("text").mapInArrow(count_buckets(width, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in sent.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed share in the target / smoothed share in the documents)) of each bucket."""
    b = len(own)
    share = (target + 1).astype(float) * float(own.sum() + b) / ((own + 1).astype(float) * float(target.sum() + b))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weigh(held: Broadcast, width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, gain = Features(width, buckets), held.value
        for batch in batches:
            for first, texts in portions(batch.column(1)):
                n_words, n_features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
                for n, (owner, bucket) in enumerate(features.of(texts)):
                    upto = np.searchsorted(owner, np.arange(len(texts) + 1))
                    many = np.diff(upto)
                    n_words += many if n == 0 else 0
                    n_features += many
                    weight += np.diff(np.concatenate([[0], np.cumsum(gain[bucket])])[upto])
                columns = [batch.column(0).slice(first, len(texts)), pa.array(n_words), pa.array(n_features), pa.array(weight)]
                yield pa.record_batch(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(seed: str):
    """floor(-1000 * ln(-ln u)), u from the first 32 bits of the SHA-256 of ``seed``:doc_id."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, seed: str = "2024", percent: int = 10, fewest: int = 20
) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_features, weight, score, and rank where it is drawn.

    Of the documents with at least ``fewest`` words floor(``percent`` * N / 100) are drawn.
    """
    texts = id_and_text(docs)
    wanted = target.select(F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(texts, width, buckets), bucket_counts(wanted, width, buckets))
    held = docs.sparkSession.sparkContext.broadcast(gain)
    weighed = texts.mapInArrow(weigh(held, width, buckets), "doc_id long, n_words long, n_features long, weight long")
    scored = kept(weighed.withColumn("score", (F.col("weight") + noise(seed)).cast("long")), "scores")
    able = scored.where(F.col("n_words") >= fewest)
    drawn = percent * able.count() // 100
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranked = numbered(able, order, "rank").withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.unionByName(scored.where(F.col("n_words") < fewest).withColumn("rank", F.lit(None).cast("long")))

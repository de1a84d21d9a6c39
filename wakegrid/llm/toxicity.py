"""Toxicity by a noisy channel: written forms are decoded to what was meant, then scored.

A hidden word passes through a channel that swaps letters for look-alikes (3 for
e, @ for a), repeats them (idiooot), or parts them (i.d.i.o.t, i d i o t).  For a
suspicious form a lattice is built: per written mark the letters it may stand
for, nothing, or a word break.  Viterbi decoding under a character language model
finds the likeliest reading, in one pass over forms of any length.  The model's
counts are taken from all letters of all texts.

The restored text is scored by logistic regression over words and word beginnings
that labelled rows show to matter; its rows are a bounded sample.  Null and empty
texts get the score of a text without such words.  Rows are scored one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import Adam, sample, sigmoid
from .tables import id_and_text
from .text import Hasher, lower_ascii, slices, word_bounds

#: Symbols of the language model: 0 outside words, 1..26 letters, 27 any other letter's bytes.
SYMBOLS = 28
SYMBOL = np.zeros(256, np.int64)
SYMBOL[65:91] = SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = 27

#: What a mark may stand for, and the channel's cost of writing it so (negative log, nats).
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l",
}
SWAP_COST, DROP_COST, KEEP_COST, REPEAT_COST = 1.5, 0.7, 0.05, 0.4
PARTING = ".-_*~'`^,/ "
#: After so many marks the part of a reading that all paths share is read out.
READ_OUT = 256
#: Longer forms are decoded each time, so that the known ones stay small.
LONGEST_KNOWN = 64

LOOKS, PARTS = re.escape("".join(LOOK_ALIKE)), re.escape(PARTING.replace(" ", ""))
#: A form with a mark inside, a mark before two letters, or a letter three times.
MIXED = re.compile(rf"[a-z][{LOOKS}{PARTS}]+[a-z]|^[{LOOKS}]+[a-z]{{2}}|([a-z])\1\1")
#: Single marks that are parted, four at least.
SPACED = re.compile(rf"(?<!\S)[a-z{LOOKS}](?:[ {PARTS}]+[a-z{LOOKS}]){{3,}}(?![^\s.,!?;:])")
#: Cheap test: a text without any match has no suspicious form.
SUSPECT = re.compile(rf"[a-z][{LOOKS}{PARTS}]+[a-z]|[{LOOKS}][a-z]{{2}}|([a-z])\1\1|{SPACED.pattern}")
#: Forms that may be mixed, found without a call for each of the others.
SUSPECT_FORM = re.compile(rf"(?<!\S)(?=\S*?(?:[a-z][{LOOKS}{PARTS}]+[a-z]|[{LOOKS}][a-z]{{2}}|([a-z])\1\1))\S+")


def count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all runs of three symbols, for the rows of a partition together."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for _, _, data, offsets in slices(batch):
            s = SYMBOL[data]
            if len(s) > 2:
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["run", "n"])


def letter_model(docs: DataFrame) -> np.ndarray:
    """Cost (negative log) of a symbol after the two before it, from all texts of ``docs``; 28**3 numbers."""
    rows = id_and_text(docs).mapInArrow(count_letters, "run int, n long").groupBy("run").agg(F.sum("n").alias("n")).collect()
    n = np.full(SYMBOLS**3, 0.05)
    for r in rows:
        n[r["run"]] += r["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pair = n.sum(0)
    smooth = (n + 2 * pair / pair.sum(1, keepdims=True)) / (n.sum(2, keepdims=True) + 2)
    return -np.log(smooth).astype(np.float32)


def lattice(form: str) -> list[tuple[str, list[tuple[str, float]], int]]:
    """(mark, readings with costs, repeats) of each run of equal marks; the reading '' drops the mark, ' ' is a word break."""
    out, at = [], 0
    while at < len(form):
        to = at
        while to < len(form) and form[to] == form[at]:
            to += 1
        mark, run = form[at], to - at
        readings = [(c * k, SWAP_COST * k) for c in LOOK_ALIKE.get(mark, "") for k in range(1, min(run, 2) + 1)]
        if mark.isalpha():
            readings = [(mark, KEEP_COST + (REPEAT_COST if run > 2 else REPEAT_COST * (run - 1)))]
            if run > 1:
                readings.append((mark * 2, KEEP_COST if run == 2 else REPEAT_COST))
        if mark in PARTING or not readings:
            readings += [("", DROP_COST), (" ", DROP_COST)]
        out.append((mark, readings, run))
        at = to
    return out


def decode(form: str, cost: np.ndarray) -> str:
    """The likeliest reading of a written form: Viterbi over pairs of letters, with what all paths agree on read out on the way."""
    # a path: (cost, (path before, letters))
    beams: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    out: list[str] = []
    for k, (_, readings, _) in enumerate(lattice(form), 1):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (spent, said) in beams.items():
            for letters, price in readings:
                x, y, total = a, b, spent + price
                for c in letters:
                    z = ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27
                    total += float(cost[x, y, z])
                    x, y = y, z
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, (said, letters))
        beams = new
        if k % READ_OUT == 0:
            beams, agreed = read_out(beams)
            out.append(agreed)
    _, best = min((spent + float(cost[x, y, 0]), spell(said)) for (x, y), (spent, said) in beams.items())
    return "".join([*out, best])


def spell(said: tuple | None) -> str:
    letters = []
    while said:
        said, last = said
        letters.append(last)
    return "".join(reversed(letters))


def read_out(beams: dict[tuple[int, int], tuple[float, tuple | None]]) -> tuple[dict, str]:
    """The paths after what is common to all of them, and the common part."""
    paths = {}
    for at, (_, said) in beams.items():
        steps = []
        while said:
            steps.append(said)
            said = said[0]
        paths[at] = steps[::-1]
    same, first = 0, next(iter(paths.values()))
    while all(len(p) > same and p[same] is first[same] for p in paths.values()):
        same += 1
    cut: dict[int, tuple] = {}
    ends: dict[tuple[int, int], tuple | None] = {}
    for at, steps in paths.items():
        said = None
        for step in steps[same:]:
            said = cut.setdefault(id(step), (said, step[1]))
        ends[at] = said
    return {at: (spent, ends[at]) for at, (spent, _) in beams.items()}, "".join(x for _, x in first[:same])


class Restorer:
    """Restores texts; forms are decoded once."""

    def __init__(self, cost: np.ndarray, most: int = 100_000):
        self.cost, self.most, self.known = cost, most, {}

    def word(self, form: str) -> str:
        if len(form) > LONGEST_KNOWN:
            return decode(form, self.cost)
        if form not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[form] = decode(form, self.cost)
        return self.known[form]

    def form(self, match: re.Match) -> str:
        form = match.group()
        body = form.rstrip("%&#*$!?.,;:~^\"')")
        return self.word(body) if len(body) >= 3 and MIXED.search(body) else form

    def spaced(self, match: re.Match) -> str:
        form = match.group()
        return self.word(form) if any("a" <= c <= "z" for c in form) else form

    def text(self, text: str) -> str:
        """``text`` in lower case with its suspicious forms replaced."""
        text = text.lower()
        if not SUSPECT.search(text):
            return text
        return SUSPECT_FORM.sub(self.form, SPACED.sub(self.spaced, text))


#: Marks between words of a restored text: all ASCII that is no letter.
BETWEEN = np.ones(256, bool)
BETWEEN[97:123] = False
BETWEEN[128:] = False
BEGINNINGS = (4, 5, 6)


class Words:
    """Words and word beginnings of restored texts as hashes."""

    def __init__(self, cost: np.ndarray):
        self.restorer, self.hasher = Restorer(cost), Hasher(11)

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(rows, text of each feature, feature), slice by slice; features of a text may repeat."""
        for _, n, data, offsets in slices(batch):
            raw = data.tobytes()
            restored = [self.restorer.text(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")).encode() for i in range(n)]
            data, offsets = np.frombuffer(b"".join(restored), np.uint8), np.cumsum([0, *map(len, restored)])
            data = lower_ascii(data)
            start, end, firsts = word_bounds(data, offsets, BETWEEN)
            self.hasher.load(data)
            text = np.repeat(np.arange(n), np.diff(firsts))
            found, owner = [self.hasher.ranges(start, end)], [text]
            for k in BEGINNINGS:
                longer = end - start >= k
                found.append(self.hasher.ranges(start[longer], start[longer] + k) ^ np.uint64(0xA5A5A5A5 * k))
                owner.append(text[longer])
            yield n, np.concatenate(owner), np.concatenate(found)


def count_features(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(held.value)
        for batch in batches:
            label = np.array(batch.column(batch.schema.get_field_index("label")).to_pylist())
            at = 0
            for n, owner, found in words.of(batch):
                # each text counts once for a feature
                order = np.lexsort((owner, found))
                f, o = found[order], owner[order]
                once = np.ones(len(f), bool)
                once[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
                f, y = f[once], label[at + o[once]]
                feature, inverse, many = np.unique(f, return_inverse=True, return_counts=True)
                toxic = np.bincount(inverse, weights=y, minlength=len(feature)).astype(np.int64)
                at += n
                yield pa.record_batch([pa.array(feature.view(np.int64)), pa.array(many), pa.array(toxic)], names=["feature", "n", "toxic"])

    return run


def presence(known: np.ndarray, n: int, owner: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, number of a known feature) pairs, each once."""
    if not len(known) or not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    hit = known[at] == found
    pairs = np.unique(owner[hit] * len(known) + at[hit])
    return pairs // len(known), pairs % len(known)


def send_presence(held_cost, held_known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(held_cost.value), held_known.value
        for batch in batches:
            out: list[list[int]] = []
            for n, owner, found in words.of(batch):
                text, feature = presence(known, n, owner, found)
                cuts = np.searchsorted(text, np.arange(n + 1))
                out += [feature[cuts[i] : cuts[i + 1]].tolist() for i in range(n)]
            yield pa.record_batch([batch.column(0), batch.column(batch.schema.get_field_index("label")), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "label", "features"])

    return run


def fit_weights(features: list[list[int]], label: np.ndarray, size: int, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression over present features; without labelled rows all texts score below one half."""
    if not len(label):
        return -1.0, np.zeros(size)
    row = np.repeat(np.arange(len(label)), [len(f) for f in features])
    column = np.array([x for f in features for x in f], np.int64)
    bias, weight = np.zeros(1), np.zeros(size)
    adam = Adam([(1,), (size,)], 0.1)
    for _ in range(rounds):
        raw = bias + np.bincount(row, weights=weight[column], minlength=len(label))
        error = (sigmoid(raw) - label) / len(label)
        adam.step([bias, weight], [error.sum(keepdims=True), np.bincount(column, weights=error[row], minlength=size) + 2e-5 * weight])
    return float(bias[0]), weight


class ToxicModel:
    """Letter costs, the features that matter and their weights."""

    def __init__(self, cost: np.ndarray, known: np.ndarray, bias: float, weight: np.ndarray):
        self.cost, self.known, self.bias, self.weight = cost, known, bias, weight


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = 20_000, features: int = 4000) -> ToxicModel:
    """Letter model from all of ``docs``; words and weights from at most ``most`` rows of ``labels`` (doc_id, label)."""
    spark = docs.sparkSession
    cost = letter_model(docs)
    held_cost = spark.sparkContext.broadcast(cost)
    rows = sample(docs, labels, most)
    counts = rows.mapInArrow(count_features(held_cost), "feature long, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    other = max(whole["n"] - whole["toxic"], 1)
    # seen in three toxic texts at least, and far more often in toxic texts than in others
    rate = (F.col("toxic") + 0.5) / (whole["toxic"] + 1) / ((F.col("n") - F.col("toxic") + 0.5) / (other + 1))
    strong = counts.where("toxic >= 3").withColumn("gain", F.log(rate) * F.col("toxic")).where(F.log(rate) > 1.0)
    picked = strong.orderBy(F.desc("gain"), "feature").limit(features).collect()
    known = np.sort(np.array([r["feature"] for r in picked], np.int64).view(np.uint64))
    held_known = spark.sparkContext.broadcast(known)
    got = rows.mapInArrow(send_presence(held_cost, held_known), "doc_id long, label int, features array<int>").orderBy("doc_id").collect()
    bias, weight = fit_weights([r["features"] for r in got], np.array([r["label"] for r in got], float), len(known))
    return ToxicModel(cost, known, bias, weight)


def score_rows(held, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, known, bias, weight = held.value
        words = Words(cost)
        for batch in batches:
            out = []
            for n, owner, found in words.of(batch):
                text, feature = presence(known, n, owner, found)
                out.append(sigmoid(bias + np.bincount(text, weights=weight[feature], minlength=n)))
            made = {"doc_id": batch.column(0), "score": pa.array(np.concatenate(out) if out else np.zeros(0))}
            made |= {c: batch.column(batch.schema.get_field_index(f"carried_{c}")) for c in carry}
            yield pa.record_batch(list(made.values()), names=list(made))

    return run


def score_toxicity(docs: DataFrame, model: ToxicModel, carry: list[str] | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, score (higher: toxic likelier) and the columns of ``carry``."""
    carry = list(carry or [])
    held = docs.sparkSession.sparkContext.broadcast((model.cost, model.known, model.bias, model.weight))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry]).where("doc_id is not null")
    return whole.mapInArrow(score_rows(held, carry), ", ".join(["doc_id long", "score double", *[f"`{c}` {kinds[c]}" for c in carry]]))

"""Quality classifier: a factorisation machine over hashed words, structure and size.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The pairwise part is taken from sums and sums of squares, so a text is scored in
time linear in its words.  Features are the words (hashed, each occurrence worth
its share of the text), structure statistics of the whole text, and its size.
The model is fitted on at most ``most`` labelled rows.

Null and empty texts have all features zero and get the score of that.  Rows are
scored one by one, so repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled import Adam, sample, sigmoid
from .tables import id_and_text
from .text import Hasher, slices, word_bounds

WORD_BITS = 14
#: Words weigh this much in sum, beside structure statistics of about one each.
WORD_SCALE = 4.0

MARK = np.zeros(256, bool)
MARK[[ord(c) for c in "%&#$*|~^<>{}[]\\=+@_"]] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:"]] = True
LOUD = np.zeros(256, bool)
LOUD[[ord(c) for c in "!?"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
N_STATS = 15


def share(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of flagged bytes of each text."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def structure(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, firsts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Statistics of each text's form, each of order one."""
    n_bytes, n_words = np.diff(offsets), np.diff(firsts)
    some = np.maximum(n_words, 1)
    text = np.repeat(np.arange(len(n_words)), n_words)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(text, weights=values, minlength=len(n_words)) / some

    length = (end - start).astype(float)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    n_lines = lines[offsets[1:]] - lines[offsets[:-1]] + 1
    # distinct words: sorted by text and hash, the first of each run counts
    order = np.lexsort((words, text))
    new = np.ones(len(words), bool)
    if len(words):
        new[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][new], minlength=len(n_words)) / some
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    out = np.column_stack(
        [
            share(LETTER[data], offsets),
            4 * share(MARK[data], offsets),
            4 * share(STOP[data], offsets),
            8 * share(LOUD[data], offsets),
            4 * share(DIGIT[data], offsets),
            2 * share(UPPER[data], offsets),
            mean(length) / 8,
            mean(length > 18) * 4,
            mean(length == 1) * 2,
            mean(MARK[last]) if len(words) else np.zeros(len(n_words)),
            mean(LOUD[last]) if len(words) else np.zeros(len(n_words)),
            distinct,
            mean(again) * 2,
            np.minimum(n_lines * 20 / some, 3),
            np.log1p(n_bytes) / 10,
        ]
    )
    out[n_bytes == 0] = 0
    return out


class Features:
    def __init__(self) -> None:
        self.hasher = Hasher(7)

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, statistics, word features, where each text's words begin), slice by slice."""
        for _, n, data, offsets in slices(batch):
            start, end, firsts = word_bounds(data, offsets)
            self.hasher.load(data)
            words = self.hasher.ranges(start, end)
            yield n, structure(data, offsets, start, end, firsts, words), (words >> np.uint64(64 - WORD_BITS)).astype(np.int64), firsts


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of each text's rows of ``values``."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[firsts[1:]] - total[firsts[:-1]]


class Machine:
    """The fitted machine: bias, weights and factors of the statistics and of the word features."""

    def __init__(self, factors: int, seed: int = 5):
        random = np.random.default_rng(seed)
        self.bias = np.zeros(1)
        self.stat_w, self.word_w = np.zeros(N_STATS), np.zeros((1 << WORD_BITS, 1))
        self.stat_v = random.normal(0, 0.1, (N_STATS, factors))
        self.word_v = random.normal(0, 0.1, (1 << WORD_BITS, factors))

    @classmethod
    def of(cls, parameters: list[np.ndarray]) -> Machine:
        m = cls.__new__(cls)
        m.bias, m.stat_w, m.stat_v, m.word_w, m.word_v = parameters
        return m

    def parameters(self) -> list[np.ndarray]:
        return [self.bias, self.stat_w, self.stat_v, self.word_w, self.word_v]

    def forward(self, stats: np.ndarray, words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score before the sigmoid, the factor sums, and the worth of an occurrence."""
        n = np.diff(firsts)
        x = WORD_SCALE / np.maximum(n, 1)
        both = sums(np.concatenate([self.word_w[words], self.word_v[words], (self.word_v[words] ** 2).sum(1, keepdims=True)], axis=1), firsts)
        linear = self.bias + stats @ self.stat_w + x * both[:, 0]
        total = stats @ self.stat_v + x[:, None] * both[:, 1:-1]
        squares = (stats**2) @ (self.stat_v**2).sum(1) + x**2 * both[:, -1]
        return linear + 0.5 * ((total**2).sum(1) - squares), total, x

    def scores(self, stats: np.ndarray, words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(stats, words, firsts)[0])


class Part:
    """Some training rows, their word occurrences also in the order of the words."""

    def __init__(self, stats: np.ndarray, words: list[np.ndarray], label: np.ndarray):
        self.stats, self.label = stats, label
        self.words, self.firsts = np.concatenate([np.zeros(0, np.int64), *words]), np.cumsum([0, *map(len, words)])
        order = np.argsort(self.words, kind="stable")
        self.text = np.repeat(np.arange(len(label)), np.diff(self.firsts))[order]
        self.used, self.cut = np.unique(self.words[order], return_index=True)

    def gradients(self, m: Machine, decay: float) -> list[np.ndarray]:
        """Of the mean log loss, with decay of what the rows use."""
        raw, total, x = m.forward(self.stats, self.words, self.firsts)
        error = (sigmoid(raw) - self.label) / len(self.label)
        stat_v = self.stats.T @ (error[:, None] * total) - m.stat_v * ((self.stats**2).T @ error)[:, None]
        word_w, word_v = np.zeros_like(m.word_w), np.zeros_like(m.word_v)
        if len(self.words):
            per_text = np.column_stack([error * x, error * x**2, (error * x)[:, None] * total])
            got = np.add.reduceat(per_text[self.text], self.cut, axis=0)
            word_w[self.used, 0] = got[:, 0] + decay * m.word_w[self.used, 0]
            word_v[self.used] = got[:, 2:] - m.word_v[self.used] * got[:, 1:2] + decay * m.word_v[self.used]
        return [error.sum(keepdims=True), self.stats.T @ error + 1e-4 * m.stat_w, stat_v + 1e-4 * m.stat_v, word_w, word_v]


def fit(stats: np.ndarray, words: list[np.ndarray], label: np.ndarray, factors: int, rounds: int, each: int = 1000, decay: float = 1e-4) -> Machine:
    """Log loss by gradient steps over parts of ``each`` rows."""
    m = Machine(factors)
    parts = [Part(stats[k : k + each], words[k : k + each], label[k : k + each]) for k in range(0, len(label), each)]
    adam = Adam([p.shape for p in m.parameters()], 0.03)
    for _ in range(rounds):
        for part in parts:
            adam.step(m.parameters(), part.gradients(m, decay))
    return m


def send_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        ids, label = batch.column(0), batch.column(batch.schema.get_field_index("label"))
        stats, words = [], []
        for n, s, w, firsts in features.of(batch):
            stats += [row.tobytes() for row in s]
            words += [w[firsts[i] : firsts[i + 1]].astype(np.uint16).tobytes() for i in range(n)]
        yield pa.record_batch([ids, label, pa.array(stats, pa.binary()), pa.array(words, pa.binary())], names=["doc_id", "label", "stats", "words"])


def train_quality(docs: DataFrame, labels: DataFrame, most: int = 6000, factors: int = 6, rounds: int = 20) -> Machine:
    """Fit on at most ``most`` rows of ``labels`` (doc_id, label); without any the machine stays as it begins."""
    rows = sample(docs, labels, most).mapInArrow(send_features, "doc_id long, label int, stats binary, words binary").orderBy("doc_id").collect()
    stats = np.array([np.frombuffer(r["stats"]) for r in rows]).reshape(len(rows), N_STATS)
    words = [np.frombuffer(r["words"], np.uint16).astype(np.int64) for r in rows]
    return fit(stats, words, np.array([r["label"] for r in rows], float), factors, rounds)


def score_rows(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, machine = Features(), Machine.of(held.value)
        for batch in batches:
            out = [machine.scores(s, w, firsts) for _, s, w, firsts in features.of(batch)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """A row per row of ``docs``: doc_id and score, higher for better text."""
    held = docs.sparkSession.sparkContext.broadcast(machine.parameters())
    return id_and_text(docs).mapInArrow(score_rows(held), "doc_id long, score double")

"""Training rows for the classifiers: a bounded sample of labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import id_and_text, kept


def fold(parts: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Written table (doc_id, text, label) of at most ``most`` labelled documents, chosen by a hash of the id.

    ``labels`` has doc_id and label; rows without a label or with another one
    than 0 or 1 are left out, and of rows that repeat an id one counts.  The ids
    that are sent to the tasks are bounded by ``most``.
    """
    chosen = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id")
    return kept(rows.select("doc_id", "text", "label"), "labelled")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Gradient steps with running moments, for a list of parameter arrays."""

    def __init__(self, shapes: list[tuple[int, ...]], rate: float):
        self.first, self.second, self.rate, self.t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], rate, 0

    def step(self, parameters: list[np.ndarray], gradients: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(parameters, gradients, self.first, self.second, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)

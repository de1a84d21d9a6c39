"""Small awkward tables for the text operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; tables may have their own.
CLASHING = "head long, region long, first long, starts string, component long, slot int, row int, size int, token string, name string, n long, h string"


def words(r: random.Random, n: int, vocabulary: int = 300) -> list[str]:
    return [f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"w{r.randrange(vocabulary)}" for _ in range(n)]


def documents(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty, blank, short, long and repetitive texts."""
    r = random.Random(seed)
    passage = " ".join(words(r, 70))
    base = words(r, 200)
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two three", "ONE two three", "x" * 5000, "a " * 400, "For " * 90]
    texts += [" ".join(base)] * 3
    for _ in range(8):
        near = list(base)
        for _ in range(r.randrange(1, 4)):
            near[r.randrange(len(near))] = "edited" + str(r.randrange(1000))
        texts.append(" ".join(near))
    for _ in range(12):
        own = words(r, r.randrange(5, 120))
        at = r.randrange(len(own))
        texts.append(" ".join(own[:at]) + ("\n" + passage + "\n" if r.random() < 0.5 else " ") + " ".join(own[at:]))
    texts.append(" ".join(words(r, 6000, 100_000)) + " " + passage)
    r.shuffle(texts)
    rows = [(3 * k + 1, t, "en", "src0", len(t) if t is not None else None) for k, t in enumerate(texts)]
    return [*rows, rows[4], rows[-1], (None, "no id " * 20, None, None, None)]


def frame(spark, rows: list[tuple], extra: bool = False):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for column in CLASHING.split(", "):
            name, kind = column.split()
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df

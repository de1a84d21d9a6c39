"""Empty tables, nulls, repeated rows, rows without an id and clashing columns where the other tests leave them out."""

from __future__ import annotations

import random

import pytest
from data import CLASHING, DOCS, documents, frame

import corpus_pipeline
from wakegrid.llm.licenses import license_scan
from wakegrid.llm.quality import score_quality, train_quality
from wakegrid.llm.toxicity import score_toxicity, train_toxicity

LABELS = "doc_id long, quality int, toxic int"


def label_rows(spark, rows):
    return spark.createDataFrame([(i, k % 2) for k, (i, *_) in enumerate(rows) if i is not None], "doc_id long, label int")


@pytest.mark.parametrize("train, score", [(train_toxicity, score_toxicity), (train_quality, score_quality)])
def test_classifiers(spark, train, score):
    rows = documents()
    docs, labels = frame(spark, rows, extra=True), label_rows(spark, rows)
    model = train(docs, labels)
    got = sorted((r["doc_id"], r["score"]) for r in score(docs, model).collect())
    assert [i for i, _ in got] == sorted(i for i, *_ in rows if i is not None)
    assert all(0 <= s <= 1 for _, s in got)
    by_text: dict = {}
    for i, t, *_ in rows:
        if i is not None:
            by_text.setdefault(t or "", set()).update(round(s, 9) for j, s in got if j == i)
    assert all(len(s) == 1 for s in by_text.values())  # equal texts, equal scores; null as empty
    assert score(frame(spark, []), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, label int")
    for unfitted in (train(frame(spark, []), none), train(docs, none)):
        assert all(0 <= r["score"] <= 1 for r in score(docs, unfitted).collect())


def test_license_scan(spark):
    assert license_scan(frame(spark, [])).count() == 0
    rows = [(1, None, None, None, None), (1, "", None, None, None), (2, "all rights reserved", None, None, None), (2, "all rights reserved", None, None, None), (None, "cc by", None, None, None)]
    got = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"] > 0) for r in license_scan(frame(spark, rows, extra=True)).collect())
    assert [g[:4] for g in got] == [(1, 0, 0, None), (1, 0, 0, None), (2, 3, 1, 0), (2, 3, 1, 0)]
    assert got[0][4:] == ("", False) and got[2] == got[3] and got[2][5]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents as they come: nulls, repeated rows, no ids, more columns; and a folder whose tables are all empty."""
    r = random.Random(3)
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    rows = documents(5)
    for k in range(60):
        own = [f"w{r.randrange(300)}" for _ in range(25)] + ["idiot"] * (k % 3 == 0)
        rows.append((4000 + k, " ".join(own), None, None, None))
    frame(spark, rows, extra=True).write.parquet(f"{full}/documents.parquet")
    spark.createDataFrame([(4000 + k, None, int(k % 3 == 0)) for k in range(60)] + [(None, 1, 1), (4000, None, None)], LABELS).write.parquet(f"{full}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "words without an item"), (2, " ".join(f"b{k}" for k in range(20))), (2, "")], "item_id long, text string").write.parquet(f"{full}/benchmark.parquet")
    spark.createDataFrame([], f"{DOCS}, {CLASHING}").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    return full, empty, rows


def test_stages_on_empty_tables(spark, tables):
    full, empty, _ = tables
    whole = spark.read.parquet(f"{full}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).count() == 0, name
        # no labels and no items: nothing is rejected for their sake
        if name in ("toxicity", "benchmark_decontamination"):
            assert stage(spark, whole, empty).count() == whole.where("doc_id is not null").count(), name
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_keep_awkward_rows(spark, tables):
    """Null and empty texts and repeated rows go through every stage and are packed; rows without an id drop out."""
    full, _, rows = tables
    docs = spark.read.parquet(f"{full}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, full)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        docs = docs.cache()
        held = [r["doc_id"] for r in docs.collect()]
        assert None not in held
        blank = [i for i, t, *_ in rows if i is not None and not (t or "").split()]
        assert sorted(i for i in held if i in blank) == sorted(blank), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, full).collect()
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == sorted(held)

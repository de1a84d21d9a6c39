"""The pipeline's stages against brute force, and the registration of the queries."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from data import DOCS, documents
from test_dedup import brute_components, brute_found, brute_substring

import __spark_entry__
import corpus_pipeline
from wakegrid.session import checkpoint_folder


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    path = str(tmp_path_factory.mktemp("tables"))
    item = " ".join(f"b{r.randrange(300)}" for _ in range(30))
    rows = [x for x in documents(7) if x[0] is not None and x[1] is not None]
    rows = list({x[0]: x for x in rows}.values())
    bad = ["idiot", "moron"]
    for k in range(150):
        own = [f"w{r.randrange(300)}" for _ in range(30)]
        if k % 3 == 0:
            own[r.randrange(30)] = bad[k % 2]
        if k == 7:
            own += item.split()
        t = " ".join(own)
        rows.append((2000 + k, t, "en", "s", len(t)))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(2000 + k, 1, int(k % 3 == 0)) for k in range(140)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, [(1, item)]


def test_stages(spark, folder, tmp_path):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {i for i, t, *_ in rows if set(t.split()) & {"idiot", "moron"}}
    left = [tuple(r) for r in seen[0].collect()]
    assert {r[0] for r in left} == {r[0] for r in rows} - toxic
    groups = {i: c for i, _, c in brute_components(left)}
    one = [tuple(r) for r in seen[1].collect()]
    assert sorted(r[0] for r in one) == sorted(i for i, c in groups.items() if i == c)
    texts = {r[0]: r[1] for r in one}
    cut = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    assert cut == {i: kept if gone else texts[i] for i, _, gone, kept in brute_substring(one)}
    leaks = {i for i, _ in brute_found(list(cut.items()), items)}
    stayed = {r["doc_id"] for r in seen[3].collect()}
    assert leaks and stayed == set(cut) - leaks
    assert {r["doc_id"] for r in seen[4].collect()} == stayed
    assert corpus_pipeline.run(spark, path).count() == seen[4].count()


def test_jaccard_stage_leaves_no_large_table(spark, folder):
    """Sets, lists and what pivots lack are deleted when read; what the result reads stays."""
    path, _, _ = folder
    kept = Path(checkpoint_folder(spark).removeprefix("file:")) / "tables"
    before = {p.name for p in kept.iterdir()} if kept.exists() else set()
    got = corpus_pipeline.jaccard_join(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    left = {p.name.rpartition("-")[0] for p in kept.iterdir() if p.name not in before and any(p.glob("*.parquet"))}
    assert "shingle-counts" in left
    assert not left & {"shingle-sets", "sets", "entries", "pivots", "close", "lists"}
    assert got.count()

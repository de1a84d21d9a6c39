"""Operators 1, 7, 9 and 10 against brute force."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from data import DOCS, documents, frame

from wakegrid.llm import jaccard, substring, suffixes
from wakegrid.llm.decontam import clean, contaminated
from wakegrid.llm.jaccard import jaccard_components
from wakegrid.llm.substring import dedup_substrings
from wakegrid.llm.suffixes import dedup_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def known(rows):
    return [(i, t or "") for i, t, *_ in rows if i is not None]


def brute_substring(rows, width=13):
    first = {}
    split = [(i, WORD.findall(t)) for i, t in known(rows)]
    for i, w in split:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = {s + j for s in range(len(w) - width + 1) if first[tuple(w[s : s + width])] < i for j in range(width)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("together", [4096, 1])
def test_substring(spark, monkeypatch, together):
    monkeypatch.setattr(substring, "TOGETHER", together)
    rows = documents()
    got = dedup_substrings(frame(spark, rows, extra=True), carry=["lang", "region"]).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute_substring(rows)
    assert {r["lang"] for r in got} == {"en"} and {r["region"] for r in got} == {None}


def brute_bytes(rows, width=200):
    raw = [(i, t.encode()) for i, t in known(rows)]
    seen = {}
    for _, b in raw:
        for s in range(len(b) - width + 1):
            seen[b[s : s + width]] = seen.get(b[s : s + width], 0) + 1
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                gone[s : s + width] = [True] * width
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("together", [4096, 1])
def test_suffixes(spark, monkeypatch, together):
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    rows = documents(2)
    got = dedup_bytes(frame(spark, rows, extra=True), batches=3).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == brute_bytes(rows)


def test_suffixes_long_text_in_parts(spark, monkeypatch):
    rows = documents(3)
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 1000)
    got = dedup_bytes(frame(spark, rows), batches=2).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(i, n) for i, _, n, _, _ in brute_bytes(rows)]


def shingles(text, width=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not w:
        return []
    return [tuple(w[s : s + width]) for s in range(len(w) - width + 1)] or [tuple(w)]


def brute_components(rows):
    docs = [(i, set(shingles(t))) for i, t in known(rows)]
    name = {i: i for i, _ in docs}
    moved = True
    links = [(i, j) for k, (i, a) in enumerate(docs) for j, b in docs[:k] if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    while moved:
        moved = False
        for i, j in links:
            low = min(name[i], name[j])
            if name[i] != low or name[j] != low:
                name[i] = name[j] = low
                moved = True
    return sorted((i, len(s), name[i]) for i, s in docs)


@pytest.mark.parametrize(("seed", "rounds"), [(1, 3), (4, 1)])
def test_jaccard(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    rows = documents(seed)
    got = jaccard_components(frame(spark, rows, extra=True)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_jaccard_variants_without_a_middle(spark):
    """Variants whose base is missing: links are found though no set links to all."""
    import random

    r = random.Random(9)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(40):
        near = list(base)
        for _ in range(r.randrange(1, 5)):
            near[r.randrange(120)] = f"e{r.randrange(30)}"
        rows.append((k, " ".join(near), None, None, None))
    got = jaccard_components(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def brute_found(rows, items):
    from collections import Counter

    out = {}
    for i, t in known(rows):
        own = shingles(t)
        n = len(WORD.findall(t))
        for item, text in items:
            theirs = Counter(shingles(text or ""))
            if item is None or not theirs or not own:
                continue
            size = min(len(WORD.findall(text)), n)
            m = max(size - 4, 1)
            for s in range(len(own) - m + 1):
                shared = sum((Counter(own[s : s + m]) & theirs).values())
                union = m + sum(theirs.values()) - shared
                if shared and 100 * shared >= 75 * union and shared / union > out.get((i, item), (0, 0))[1]:
                    out[i, item] = (s, shared / union)
    return out


def test_decontamination(spark):
    import random

    r = random.Random(5)
    texts = [" ".join(f"b{r.randrange(200)}" for _ in range(n)) for n in (3, 14, 30, 59)]
    items = [(k, t) for k, t in enumerate(texts)] + [(9, None), (8, ""), (None, "x y"), (2, texts[2])]
    rows = documents(6)
    for k, t in enumerate(texts):
        w = t.split()
        if len(w) > 20:
            w[len(w) // 2] = "changed"
        rows += [(1000 + k, "before it " + " ".join(w).upper() + " behind it", "en", "s", 1), (1100 + k, t, "en", "s", 1)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows, extra=True)
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in contaminated(docs, benchmark).collect()}
    assert got == brute_found(rows, items)
    assert len(got) >= 6
    stayed = {r["doc_id"] for r in clean(docs, benchmark).collect()}
    assert stayed == {i for i, *_ in rows if i is not None} - {i for i, _ in got}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert dedup_substrings(none).count() == 0
    assert dedup_bytes(none).count() == 0
    assert jaccard_components(none).count() == 0
    assert contaminated(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert DOCS.startswith("doc_id")


def test_jaccard_more_shingles_than_cells(spark, monkeypatch):
    """Sets without a partner are left out, however many cells the sketch has."""
    r = np.random.default_rng(3)
    texts = [" ".join(f"{x:x}" for x in r.integers(0, 1 << 20, 4000)) for _ in range(900)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5000, texts[7] + " more"), (5001, texts[7])]
    written = {}

    def spied(df, name, kept=jaccard.kept):
        written[name] = kept(df, name)
        if name == "sets":
            written["n"] = written[name].count()
        return written[name]

    monkeypatch.setattr(jaccard, "kept", spied)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bits=20).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k for k in range(900)} | {5000: 7, 5001: 7}
    assert written["n"] == 2


@pytest.mark.parametrize(("keys", "rows", "group"), [(300, 1 << 16, 1), (10**6, 3, 200)])
def test_jaccard_chunks(spark, monkeypatch, keys, rows, group):
    """Lone shingles are counted the same however sets are cut into chunks and slots into groups."""
    monkeypatch.setattr(jaccard, "CHUNK_KEYS", keys)
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", rows)
    monkeypatch.setattr(jaccard, "GROUP_KEYS", group)
    monkeypatch.setattr(jaccard, "SLOT_BITS", 5)
    docs = frame(spark, documents(2))
    got = jaccard.shingle_counts(jaccard.id_and_text(docs), 5).collect()
    table = pa.table({"doc_id": [i for i, *_ in documents(2) if i is not None], "text": [t for i, t, *_ in documents(2) if i is not None]})
    sets = [s for b in table.to_batches() for s in jaccard.shingle_sets(b, jaccard.Hasher(), 5)]
    n = Counter(int(x) for s in sets for x in s)
    want = [(i, len(s), jaccard.name_of(s), sum(x % 2 == 0 and n[int(x)] == 1 for x in s)) for i, s in zip(table["doc_id"].to_pylist(), sets, strict=True)]
    assert sorted((r["doc_id"], r["n_shingles"], bytes(r["name"]), r["lone"]) for r in got) == sorted(want)

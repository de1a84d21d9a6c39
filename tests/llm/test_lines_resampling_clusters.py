"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from data import documents, frame
from pyspark.sql import functions as F

from wakegrid.llm import importance
from wakegrid.llm.centroids import Rotation, cluster_vectors, nearest
from wakegrid.llm.importance import Crc, Dictionary, Features, resample
from wakegrid.llm.lineruns import LineRuns, dedup_lines, long_lines, texts_of

LOWER = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)


# ------------------------------------------------------------------ lines


def line_documents() -> list[tuple]:
    r = random.Random(4)
    shared = ["Shared line number %d that is long enough to count, Äé ÇA" % k for k in range(6)]
    rows = documents()
    for k in range(40):
        lines = [f"own line {k} {r.random()} with enough letters to be counted as long" for _ in range(r.randrange(4))]
        lines += [r.choice([" ", "\t", "", "\r\x0b"]) + (s.upper() if r.random() < 0.2 and s.isascii() else s) + r.choice(["", " \f"]) for s in shared if r.random() < 0.4]
        lines += [""] * r.randrange(3) + ["short"] * r.randrange(2)
        r.shuffle(lines)
        rows.append((1000 + k, "\n".join(lines), None, None, None))
    everywhere = "a line that stands in every one of these documents\n"
    rows += [(2000 + k, everywhere * (1 + k % 3) + f"and {k}", None, None, None) for k in range(60)]
    rows += [rows[-1], (2000, everywhere + "another text under one id", None, None, None)]
    return rows


def lines_by_hand(rows, shortest=40, least=5):
    key = lambda line: LOWER(line.strip(" \t\n\x0b\f\r"))
    holders: dict[str, set] = {}
    for i, t, *_ in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= shortest:
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t, *_ in rows:
        if i is not None:
            lines = (t or "").split("\n")
            kept = [x for x in lines if not (len(holders.get(key(x), ())) >= least and max(holders[key(x)]) != i)]
            out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_lines_equal_brute_force(spark, batches):
    rows = line_documents()
    got = dedup_lines(frame(spark, rows, extra=True), batches=batches).collect()
    want = lines_by_hand(rows)
    assert sorted(tuple(r) for r in got) == want
    assert sum(x[2] for x in want) > 100


def test_lines_of_an_empty_table_and_a_long_text(spark):
    assert dedup_lines(frame(spark, [])).count() == 0
    line = "this very line has more than forty code points in it"
    long = "\n".join([line, "x"] * 50_000)
    rows = [(k, line, None, None, None) for k in range(4)] + [(9, line, None, None, None), (5, long, None, None, None)]
    got = {r["doc_id"]: r for r in dedup_lines(frame(spark, rows)).collect()}
    assert got[5]["n_dropped"] == 50_000 and got[5]["kept_text"] == "\n".join(["x"] * 50_000)
    assert got[9]["n_dropped"] == 0 and got[0]["kept_text"] == ""


def test_settled_lines_are_not_recorded_again(spark):
    """A line that one run settles is anti-joined away from later batches; runs are merged pairwise."""
    rows = [(k, "one and the same line in all of these documents", None, None, None) for k in range(40)]
    lines = long_lines(texts_of(frame(spark, rows)), 40)
    runs = LineRuns(spark, 5)
    for a, b in ((30, 40), (20, 30), (10, 20)):
        runs.add(lines.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)))
    assert [name is not None for name in runs.levels] == [True, True]
    plan = runs.merged(*(n for n in runs.levels))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # bucketed and sorted runs are joined as they lie
    assert sum(r.agg(F.sum("docs")).first()[0] or 0 for r in runs.runs()) == 10
    assert [r["last"] for r in runs.common().collect()] == [39]


def test_lines_use_no_python_worker(spark):
    out = dedup_lines(frame(spark, line_documents()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------------- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def resampled_by_hand(rows, target, width=1, buckets=10_000, percent=10, fewest=20):
    def features(t):
        w = WORD.findall(LOWER(t or ""))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, width + 1) for i in range(len(w) - n + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for i, text, *_ in rows:
        if i is not None:
            np.add.at(s, features(text)[1], 1)
    for text in target:
        np.add.at(t, features(text)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, text, *_ in rows:
        if i is not None:
            w, f = features(text)
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            weight = sum(gain[b] for b in f)
            out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= fewest), key=lambda x: (-x[4], x[0]))
    drawn = able[: percent * len(able) // 100]
    return sorted(out), [(k + 1, x) for k, x in enumerate(drawn)]


@pytest.mark.parametrize("width", [1, 3])
def test_resampling_equals_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(importance, "KEPT", 500)
    monkeypatch.setattr(importance, "SLICE", 4000)
    r = random.Random(9)
    rows = documents()
    rows += [(3000 + k, " ".join(r.choice(["Ä", "b-c", "é9", "W" * 80, "x", "ünï", "the", "\x7f", "№"]) for _ in range(r.randrange(60))), None, None, None) for k in range(80)]
    target = ["the b c x the", None, "ünï É9 the", "", "w" * 80]
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample(frame(spark, rows, extra=True), wanted, width=width).collect()
    rows_want, drawn = resampled_by_hand(rows, target, width)
    assert sorted((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == rows_want
    assert sorted((r["rank"], (r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"])) for r in got if r["rank"] is not None) == drawn
    assert len(drawn) > 5


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample(frame(spark, []), none).count() == 0
    rows = documents()
    got = resample(frame(spark, rows), none).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == resampled_by_hand(rows, [])[0]


def test_crc_is_composed(monkeypatch):
    r = random.Random(3)
    parts = [bytes(r.randrange(33, 256) for _ in range(r.choice([1, 2, 5, 300, 70_000]))) for _ in range(40)]
    one, two = parts[::2], parts[1::2]
    crc = lambda x: np.array([zlib.crc32(p) for p in x], np.uint32)
    made = Crc().joined(crc(one), crc(two), np.array([len(p) for p in two]))
    assert made.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(one, two, strict=True)]
    monkeypatch.setattr(importance, "KEPT", 4)
    d = Dictionary()
    for text in (b" a bb a ", b" ccc bb dd e f ", b" " + b"z" * 100 + b" a  a ", b"  "):
        end, payload = d.scan(text)
        assert [(int(e), int(p) >> 32, int(p) & 0xFFFFFFFF) for e, p in zip(end, payload, strict=True)] == [(m.end(), len(m.group()), zlib.crc32(m.group())) for m in re.finditer(rb"[^ ]+", text)]
    assert [b.tolist() for _, b in Features(2, 1 << 32).of([b"A b", b"", b"C"])] == [[zlib.crc32(x) for x in (b"a", b"b", b"c")], [zlib.crc32(b"a b")]]


# ------------------------------------------------------------------ centroids


def clusters_by_hand(rows, dims, k, rounds, seed="2"):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(256 * x) for x in v)))
    cells = np.array([v for _, v in kept], np.int64).reshape(-1, dims)
    # equal hashes are ordered by the components as they are stored
    order = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"{seed}:{kept[j][0]}".encode()).hexdigest(), cells[j].astype("<i4").tobytes()))
    centroids = cells[order[:k]]
    if not len(centroids):
        return []

    def assign():
        d = ((cells[:, None] - centroids[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        c, _ = assign()
        centroids = np.array([cells[c == j].sum(0) // (c == j).sum() if (c == j).any() else centroids[j] for j in range(len(centroids))])
    c, d = assign()
    return sorted((i, int(a), int(b), int(d[c == a].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, centroids[a])).encode()).hexdigest()) for (i, _), a, b in zip(kept, c, d, strict=True))


def vector_rows(dims: int, n: int = 400):
    rng = np.random.default_rng(11)
    heart = rng.normal(size=(6, dims))
    rows = [(int(5 * k + 1), (heart[k % 6] + 0.2 * rng.normal(size=dims)).tolist()) for k in range(n)]
    odd = [[math.nan] * dims, [math.inf] + [0.0] * (dims - 1), [0.0] * (dims - 1), [0.0] * (dims + 1), [], None, [None] + [0.0] * (dims - 1)]
    rows += [(9000 + k, v) for k, v in enumerate(odd)] + [(None, [0.0] * dims)]
    rows += [(7000 + k, [0.5] * dims) for k in range(150)]  # one very common vector
    return [*rows, rows[0], rows[0], (rows[3][0], rows[4][1])]


VECTORS = "vec_id long, embedding array<double>, label int, cluster int, distance long, cells string"


@pytest.mark.parametrize("k, rounds", [(12, 4), (1, 2), (700, 1)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rows = vector_rows(8)
    df = spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], VECTORS).repartition(5)
    got = cluster_vectors(df, dims=8, k=k, rounds=rounds, leading=3).collect()
    assert sorted(tuple(r) for r in got) == clusters_by_hand(rows, 8, k, rounds)


def test_clusters_of_nothing_and_too_large_components(spark):
    none = spark.createDataFrame([], VECTORS)
    assert cluster_vectors(none, dims=8).count() == 0
    assert cluster_vectors(spark.createDataFrame([(1, [math.nan] * 8, 0, 0, 0, "")], VECTORS), dims=8).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        cluster_vectors(spark.createDataFrame([(1, [1e30] * 8, 0, 0, 0, "")], VECTORS), dims=8).count()


def test_bound_skips_most_distances_and_loses_none():
    rng = np.random.default_rng(2)
    heart = rng.normal(scale=400, size=(40, 4)) @ rng.normal(size=(4, 64))
    cells = np.floor(heart[rng.integers(0, 40, 3000)] + rng.normal(scale=20, size=(3000, 64))).astype(np.int32)
    one = np.column_stack([np.ones(len(cells)), cells])
    turned = Rotation(one.T @ one, 6)
    leads, rest = turned.of(cells)
    centroids = cells[:40].astype(np.int64)
    cluster, distance, measured = nearest(cells, leads, rest, centroids, turned)
    d = ((cells[:, None].astype(np.int64) - centroids[None]) ** 2).sum(2)
    assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert measured < 0.1 * d.size

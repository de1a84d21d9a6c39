import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wakegrid.operators import ftle as E
from wakegrid.operators import neighbours as N
from wakegrid.operators.binning import Axis


def cloud(seed, n=250, copies=40):
    rng = np.random.default_rng(seed)
    far = rng.uniform(-50, 50, (n // 3, 3))
    tight = rng.normal(scale=0.01, size=(n // 3, 3)) + 7
    grid = rng.integers(0, 4, (n - 2 * (n // 3), 3)).astype(float)
    pile = np.full((copies, 3), 2.5)
    return np.concatenate([far, tight, grid, pile])


def frame(points, g=0):
    return pd.DataFrame({"g": g, "id": np.arange(len(points)), **dict(zip("xyz", points.T))})


@pytest.mark.parametrize("k", [1, 6])
def test_knn_equals_brute_force_on_skewed_points(spark, k):
    clouds = {0: cloud(0), 1: cloud(1, 60, 0)}
    df = spark.createDataFrame(pd.concat([frame(p, g) for g, p in clouds.items()]))
    got = N.knn(df, ["g"], "id", ["x", "y", "z"], k).toPandas()
    for g, p in clouds.items():
        part = got[got["g"] == g].sort_values(["id", "rank"])
        assert len(part) == len(p) * k
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        for i in range(len(p)):
            order = np.lexsort((np.arange(len(p)), d[i].round(12)))[:k]
            rows = part[part["id"] == i]
            np.testing.assert_allclose(rows["dist"], d[i, order], atol=1e-9)
            if len(set(d[i, order].round(9))) == k or d[i, order].max() == 0:
                assert list(rows["n_id"]) == list(order)


@pytest.mark.parametrize("k", [1, 5])
def test_knn_over_many_cells(spark, monkeypatch, k):
    """Small cells: a far outlier, a dense heap, a pile of copies and a line, against brute force."""
    rng = np.random.default_rng(5)
    p = np.concatenate([
        rng.normal(scale=1e-6, size=(500, 3)), rng.uniform(-1, 1, (300, 3)), np.full((90, 3), 0.25), [[1e9, -1e9, 1e9], [1e9, -1e9, 2e9]],
        np.column_stack([np.linspace(0, 50, 200), np.zeros(200), np.zeros(200)]),
    ])
    p = p[rng.permutation(len(p))]
    df = spark.createDataFrame(frame(p)).withColumn("w", F.col("x") * 2).repartition(5)
    placed, cells, rounds = N.space_cells(df.where("x <> 0.25"), ["g"], ["x", "y", "z"], 24)
    assert placed.groupBy("g", "_cell").count().agg({"count": "max"}).first()[0] <= 24
    assert rounds <= 6  # 1,000 points, a far outlier and a heap: rounds follow the number of points
    monkeypatch.setattr(N, "BUNDLE", 100)
    got = N.knn(df, ["g"], "id", ["x", "y", "z"], k, ["w"], most=24).toPandas().sort_values(["id", "rank"])
    assert len(got) == len(p) * k and (got["n_w"].to_numpy() == 2 * p[got["n_id"], 0]).all()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :k]
    np.testing.assert_allclose(got["dist"].to_numpy().reshape(len(p), k), want, rtol=1e-12)
    same = d[got["id"], got["n_id"]]
    np.testing.assert_allclose(same, got["dist"], rtol=1e-12)


def test_knn_2d_and_too_few_points(spark):
    p = np.array([[0.0, 0], [1, 0], [5, 5]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(3), "x": p[:, 0], "y": p[:, 1]}))
    got = {r["id"]: r["n_id"] for r in N.knn(df, [], "id", ["x", "y"], 1).collect()}
    assert got == {0: 1, 1: 0, 2: 1}
    # fewer points than asked for: all there are
    few = N.knn(df, [], "id", ["x", "y"], 3).collect()
    assert sorted((r["id"], r["n_id"]) for r in few) == [(a, b) for a in range(3) for b in range(3) if a != b]


def test_radius_pairs(spark):
    p = cloud(3, 150, 5)
    df = spark.createDataFrame(frame(p))
    got = N.radius_neighbours(df, df.toDF(*df.columns), ["g"], ["x", "y", "z"], 1.0, "id", "id", include_self=False)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    want = {(i, j) for i, j in zip(*np.where(d <= 1.0)) if i != j}
    assert {(r["id"], r["n_id"]) for r in got.collect()} == want


@pytest.mark.parametrize("how", [{"k": 8}, {"radius": 0.6}])
def test_affine_flow_gives_its_matrix(spark, how):
    """x -> A x has the same gradient everywhere, so sigma is ln(smax(A))/|T|."""
    rng = np.random.default_rng(4)
    a = np.array([[1.2, 0.3, 0.0], [-0.1, 0.8, 0.2], [0.0, 0.1, 1.5]])
    p = rng.random((120, 3))
    q = p @ a.T + 3
    df = spark.createDataFrame(pd.DataFrame({"id": range(120), **dict(zip(["x", "y", "z"], p.T)), **dict(zip(["x1", "y1", "z1"], q.T))}))
    got = E.ftle(df, [], "id", -2.0, **{"k": None, **how}).toPandas()
    want = np.log(np.linalg.svd(a)[1][0]) / 2
    kept = got[got["valid"]]
    assert len(kept) > 100
    np.testing.assert_allclose(kept["sigma"], want, atol=1e-8)


def test_flat_neighbourhood_is_rejected(spark):
    rng = np.random.default_rng(5)
    p = np.c_[rng.random((40, 2)), np.zeros(40)]
    df = spark.createDataFrame(pd.DataFrame({"id": range(40), **dict(zip(["x", "y", "z"], p.T)), **dict(zip(["x1", "y1", "z1"], p.T))}))
    field = E.ftle(df, [], "id", 1.0, k=6)
    assert E.ftle_counts(field, []).first().asDict() == {"seeds": 40, "kept": 0, "rejected": 40}
    with pytest.raises(ValueError):
        E.ftle(df, [], "id", 0.0)


SHAPE = (6, 5, 4)


def nodes(values):
    idx = np.argwhere(np.isfinite(values))
    return pd.DataFrame({**dict(zip("ijk", idx.T)), "v": values[tuple(idx.T)]})


def dense(df):
    out = np.full(SHAPE, np.nan)
    for r in df.collect():
        out[r["i"], r["j"], r["k"]] = r["v"]
    return out


def test_erode_and_fill(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=SHAPE)
    v[rng.random(SHAPE) < 0.15] = np.nan
    field = spark.createDataFrame(nodes(v))
    ok = np.isfinite(v)
    want = ok.copy()
    for ax in range(3):
        for s in (-1, 1):
            want &= np.roll(ok, s, ax)
    want[[0, -1]] = want[:, [0, -1]] = False
    want[:, :, [0, -1]] = False
    got = {(r["i"], r["j"], r["k"]) for r in E.erode6(field, []).collect()}
    assert got == set(map(tuple, np.argwhere(want)))

    full = v.copy()
    for _ in range(8):
        pad = np.pad(full, 1, constant_values=np.nan)
        near = np.stack([np.roll(pad, s, ax)[1:-1, 1:-1, 1:-1] for ax in range(3) for s in (-1, 1)])
        with np.errstate(all="ignore"):
            count = np.isfinite(near).sum(0)
            mean = np.nansum(near, 0) / np.maximum(count, 1)
        full = np.where(np.isnan(full) & (count > 0), mean, full)
    np.testing.assert_allclose(dense(E.fill_gaps6(field, [], "v", SHAPE)), full)


def test_isolated_leftovers_get_the_global_mean(spark):
    field = spark.createDataFrame(pd.DataFrame({"i": [0], "j": [0], "k": [0], "v": [3.0]}))
    got = E.fill_gaps6(field, [], "v", (9, 1, 1), passes=2)
    assert sorted((r["i"], r["v"]) for r in got.collect()) == [(i, 3.0) for i in range(9)]


def test_smooth_and_derivatives_against_numpy(spark):
    v = np.random.default_rng(7).normal(size=SHAPE)
    field = spark.createDataFrame(nodes(v))
    kernel = np.array(E.gaussian_kernel(0.9, 2))
    want = v
    for ax in range(3):
        pad = np.pad(want, [(2, 2) if a == ax else (0, 0) for a in range(3)], mode="edge")
        want = np.apply_along_axis(lambda x: np.convolve(x, kernel, "valid"), ax, pad)
    np.testing.assert_allclose(dense(E.gaussian_smooth(field, [], "v", SHAPE, 0.9)), want)
    axes = (Axis("x", 0, 1, 6), Axis("y", 0, 2, 5), Axis("z", -1, 1, 4))
    steps = [(a.hi - a.lo) / (a.n - 1) for a in axes]
    got = E.grid_gradient_hessian(field, [], "v", axes).toPandas()
    g = np.gradient(v, *steps)
    h = {f"h{'xyz'[a]}{'xyz'[b]}": np.gradient(g[a], steps[b], axis=b) for a in range(3) for b in range(a, 3)}
    at = tuple(got[c].to_numpy() for c in "ijk")
    for q, c in enumerate("xyz"):
        np.testing.assert_allclose(got[f"g{c}"], g[q][at], atol=1e-9)
    for name, values in h.items():
        np.testing.assert_allclose(got[name], values[at], atol=1e-9)


def test_ridge_of_an_analytic_field(spark):
    """A Gaussian wall around x = 0 has its ridge on the plane x = 0."""
    axes = (Axis("x", -1, 1, 17), Axis("y", -1, 1, 7), Axis("z", -1, 1, 7))
    x = np.linspace(-1, 1, 17)[:, None, None] + np.zeros((17, 7, 7))
    v = np.exp(-(x / 0.4) ** 2)
    field = spark.createDataFrame(nodes(v))
    derivs = E.grid_gradient_hessian(field, [], "v", axes)
    got = E.ridge_points(derivs, E.erode6(field, []), [], "v", 50, 50, 0.2).toPandas()
    assert len(got) and set(got["i"]) == {8} and (got["lam"] < 0).all()


def test_scatter_needs_surrounding_points(spark):
    rng = np.random.default_rng(8)
    p = rng.uniform(0, 1, (400, 3))
    df = spark.createDataFrame(pd.DataFrame({**dict(zip("xyz", p.T)), "v": 2.0}))
    axes = tuple(Axis(c, -1, 2, 7) for c in "xyz")
    got = E.scatter_to_grid(df, [], "v", axes, 0.45).toPandas()
    assert (got["v"] - 2.0).abs().max() < 1e-12
    assert got[["i", "j", "k"]].isin([2, 3, 4]).all().all() and len(got) > 0

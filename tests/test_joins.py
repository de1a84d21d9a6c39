import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wakegrid.core import range_slots
from wakegrid.operators import joins as J
from wakegrid.operators import lagrangian as L


def pchip(xs, ys, x):
    """Dense model of the shape-preserving cubic with continued ends."""
    h, d = np.diff(xs), np.diff(ys) / np.diff(xs)
    n = len(xs)
    m = np.zeros(n)
    if n == 2:
        m[:] = d[0]
    else:
        for i in range(1, n - 1):
            if d[i - 1] * d[i] > 0:
                w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
                m[i] = (w1 + w2) / (w1 / d[i - 1] + w2 / d[i])

        def end(h0, h1, d0, d1):
            v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            if np.sign(v) != np.sign(d0):
                return 0.0
            if np.sign(d0) != np.sign(d1) and abs(v) > 3 * abs(d0):
                return 3 * d0
            return v

        m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    out = []
    for v in x:
        i = int(np.clip(np.searchsorted(xs, v, "right") - 1, 0, n - 2))
        s = v - xs[i]
        c2 = (3 * d[i] - 2 * m[i] - m[i + 1]) / h[i]
        c3 = (m[i] - 2 * d[i] + m[i + 1]) / h[i] ** 2
        out.append(ys[i] + s * (m[i] + s * (c2 + s * c3)))
    return np.array(out)


CURVES = {
    0: (np.array([0.0, 1, 2, 4, 7]), np.array([0.0, 1, 1, -2, 5])),
    1: (np.array([-3.0, 5.0]), np.array([1.0, 3.0])),
    2: (np.array([0.0, 0.001, 0.01, 0.1, 50]), np.array([3.0, 3, 3, 4, 4])),
}


@pytest.fixture(scope="module")
def curve_frames(spark):
    table = pd.concat([pd.DataFrame({"g": g, "t": x, "y": y}) for g, (x, y) in CURVES.items()])
    table = pd.concat([table, pd.DataFrame({"g": [0], "t": [3.0], "y": [np.nan]})])
    rng = np.random.default_rng(1)
    queries = pd.concat(
        [pd.DataFrame({"g": g, "x": np.r_[x, rng.uniform(x[0] - 2, x[-1] + 2, 40)]}) for g, (x, _) in CURVES.items()]
    )
    t = spark.createDataFrame(table).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    return t, spark.createDataFrame(queries), len(queries)


def test_pchip_matches_dense_model(curve_frames):
    table, queries, n = curve_frames
    got = J.interp_pchip(queries, "x", table, "t", ["y"], ["g"]).toPandas()
    assert len(got) == n
    for g, (xs, ys) in CURVES.items():
        part = got[got["g"] == g]
        np.testing.assert_allclose(part["y_at"], pchip(xs, ys, part["x"].to_numpy()), rtol=1e-9, atol=1e-9)


def linear(xs, ys, v):
    i = int(np.clip(np.searchsorted(xs, v, "right") - 1, 0, len(xs) - 2))
    return ys[i] + (v - xs[i]) * (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i])


def test_linear_interpolation_and_no_extrapolation(curve_frames):
    table, queries, n = curve_frames
    got = J.interp_linear(queries, "x", table, "t", ["y"], ["g"]).toPandas()
    cut = J.interp_linear(queries, "x", table, "t", ["y"], ["g"], extrapolate=False).toPandas()
    assert len(got) == n == len(cut)
    for g, (xs, ys) in CURVES.items():
        for r in got[got["g"] == g].itertuples():
            assert r.y_at == pytest.approx(linear(xs, ys, r.x))
        part = cut[cut["g"] == g]
        outside = (part["x"] < xs[0]) | (part["x"] > xs[-1])
        assert part["y_at"].isna().equals(outside)


@pytest.mark.parametrize("slots", [None, 7, 60])
def test_long_curve_interpolation(spark, slots):
    rng = np.random.default_rng(8)
    xs = np.sort(np.r_[rng.uniform(0, 1, 150), rng.uniform(90, 100, 50)])  # a wide empty stretch
    ys = rng.normal(size=200)
    q = np.r_[rng.uniform(-5, 105, 300), xs[::7], xs[0], xs[-1]]
    got = J.interp_long(
        spark.createDataFrame(pd.DataFrame({"g": 0, "i": np.arange(len(q)), "x": q})), "x",
        spark.createDataFrame(pd.DataFrame({"g": 0, "t": xs, "y": ys})), "t", ["y"], ["g"], "", slots,
    ).toPandas().sort_values("i")
    assert len(got) == len(q)
    np.testing.assert_allclose(got["y"], [linear(xs, ys, v) for v in q], rtol=1e-7, atol=1e-7)


def test_crowded_curve_is_dealt_in_equal_shares(spark):
    """Nearly all nodes, and many queries of one x, in a millionth of the range."""
    rng = np.random.default_rng(9)
    xs = np.sort(np.r_[rng.lognormal(sigma=9, size=3000), 1e12])
    ys = rng.normal(size=len(xs))
    q = np.r_[rng.choice(xs, 2000) * rng.uniform(0.9, 1.1, 2000), np.full(3000, xs[1500] * 1.0001)]
    curve = spark.createDataFrame(pd.DataFrame({"g": 0, "t": xs, "y": ys}))
    asked = spark.createDataFrame(pd.DataFrame({"g": 0, "i": np.arange(len(q)), "x": q}))
    got = J.interp_long(asked, "x", curve, "t", ["y"], ["g"], slots=16).toPandas().sort_values("i")
    np.testing.assert_allclose(got["y"], [linear(xs, ys, v) for v in q], rtol=1e-7, atol=1e-7)
    dealt = range_slots(asked, ["g", "x", "i"], 16).groupBy("_slot").count().toPandas()["count"]
    assert len(dealt) == 16 and dealt.max() < 3 * len(q) / 16


def test_align_repeats_puts_all_on_the_first_grid(spark):
    rows = [(0, r, float(k) + 0.1 * r, float(2 * (k + 0.1 * r))) for r in (1, 2, 3) for k in range(10)]
    got = J.align_repeats(spark.createDataFrame(rows, "g int, rep int, t double, v double"), ["g"], "rep", "t", ["v"]).toPandas()
    assert len(got) == 30
    np.testing.assert_allclose(got["v"], 2 * got["tc"], atol=1e-9)


def test_complete_frames_drop_duplicates_and_gaps(spark):
    full = [(f, c, i, 0.0) for f in range(4) for c in range(2) for i in range(2)]
    rows = [r for r in full if r[:3] != (1, 1, 0)] + [(2, 0, 1, 5.0)]
    obs = spark.createDataFrame(rows, "frame int, camera int, idx int, x double")
    assert sorted({r["frame"] for r in J.frames_seen_by_all(obs, 2).collect()}) == [0, 3]


def test_camera_pairs(spark):
    rows = [(0, 0, 1.0), (0, 2, 2.0), (0, 3, 4.0), (1, 1, 7.0)]
    got = J.camera_pairs(spark.createDataFrame(rows, "frame int, camera int, x double"), ["frame"], [0, 1, 2, 3], ["x"])
    assert {(r["c1"], r["c2"], r["x_1"], r["x_2"]) for r in got.collect()} == {(0, 2, 1.0, 2.0), (0, 3, 1.0, 4.0), (2, 3, 2.0, 4.0)}


def test_flow_map_span(spark):
    rows = [(t, f, float(f), 0.0, 0.0) for t, frames in enumerate([range(6), [0, 1, 3, 4], [0, 4], [1, 2]]) for f in frames]
    df = spark.createDataFrame(rows, "track int, frame int, x double, y double, z double")
    ends = J.flow_map(df, [], "track", "frame", [0], 4)
    assert sorted(r["track"] for r in ends.collect()) == [0, 1, 2]
    span = J.flow_map(df, [], "track", "frame", [0], 4, require_span=True)
    assert [r["track"] for r in span.collect()] == [0]
    back = J.flow_map(df, [], "track", "frame", [4], -4).collect()
    assert all(r["x"] == 4.0 and r["x1"] == 0.0 for r in back)
    with pytest.raises(ValueError):
        J.flow_map(df, [], "track", "frame", [0], 0)


# ------------------------------------------------------------------- lags


def lag_brute(pdf, keys, max_lag):
    out = {}
    for (g, _), p in pdf.groupby(["g", "track"]):
        s = p.set_index("frame")["v"]
        for lag in range(max_lag + 1):
            for f in s.index:
                if f + lag in s.index:
                    n, t = out.get((g, lag), (0, 0.0))
                    out[g, lag] = (n + 1, t + s[f] * s[f + lag])
    return out


@pytest.fixture(scope="module")
def lag_frames(spark):
    rng = np.random.default_rng(9)
    rows = [(t % 2, t, f, float(rng.normal())) for t, n in enumerate([1, 5, 60, 200]) for f in range(n) if rng.random() > 0.1]
    pdf = pd.DataFrame(rows, columns=["g", "track", "frame", "v"])
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("method", ["shift", "fft"])
@pytest.mark.parametrize("size", [13, 65536])
@pytest.mark.parametrize("batch", [5, 10000])
def test_lag_sums(spark, lag_frames, method, size, batch):
    pdf, df = lag_frames
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = L.lag_sums(df, ["g"], ["track"], "frame", ["v"], 12, size, method).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    want = lag_brute(pdf, ["g"], 12)
    assert {(r["g"], r["lag"]) for r in got} == set(want)
    for r in got:
        n, s = want[r["g"], r["lag"]]
        assert r["n"] == n and r["s_v"] == pytest.approx(s, abs=1e-9)


def test_known_time_scale(spark):
    """An AR(1) series with R = a^lag has a known integral scale up to 1/e."""
    rng = np.random.default_rng(10)
    a, dt, rows = 0.9, 0.1, []
    for t in range(60):
        v = rng.normal() / np.sqrt(1 - a * a)
        for f in range(500):
            rows.append((t, f, v))
            v = a * v + rng.normal()
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["track", "frame", "u"]))
    curve = L.lagrangian_autocorr(df, [], "track", "frame", ["u"], 40, dt)
    got = L.eddy_diffusivity(curve, [], ["u"]).first()
    r = a ** np.arange(41)
    stop = int(np.argmax(r < np.exp(-1)))
    want = ((r[1 : stop + 1] + r[:stop]) / 2 * dt).sum()
    assert got["tl_u"] == pytest.approx(want, rel=0.06)
    assert got["d_u"] == pytest.approx(got["tl_u"] / (1 - a * a), rel=0.08)


def test_banded_all_is_pooled(spark, lag_frames):
    _, df = lag_frames
    rows = df.withColumn("y", F.col("track") * 1.0)
    got = L.banded_autocorr(rows, [], "track", "frame", ["v"], [2.0, 99.0], 0.5, 3, 1.0).toPandas()
    assert sorted(got["band"].unique()) == [0, 1]
    assert got[(got["band"] == 0) & (got["lag"] == 0)]["n"].iloc[0] == df.count()


def test_survival_and_longest(spark):
    rows = [(t, f) for t, n in enumerate([3, 8, 8, 5]) for f in range(n)]
    df = spark.createDataFrame(rows, "track int, frame int")
    assert {r["m"]: r["n"] for r in L.survival_curve(df, [], "track", "frame", 1, [1, 3, 6]).collect()} == {1: 4, 3: 3, 6: 2}
    assert sorted({r["track"] for r in L.longest_tracks(df, [], "track", 1).collect()}) == [1]

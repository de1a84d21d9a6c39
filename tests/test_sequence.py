import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wakegrid.operators import quality as Q
from wakegrid.operators import sequence as W


def tracks(spark, seed=0, gaps=True):
    rng = np.random.default_rng(seed)
    rows = []
    for track, n in enumerate([1, 9, 10, 40, 300]):
        for f in range(n):
            if gaps and n > 10 and rng.random() < 0.03:
                continue
            rows.append((track, f + 5, float(rng.normal()), float(rng.normal())))
    pdf = pd.DataFrame(rows, columns=["track", "frame", "x", "y"])
    return pdf, spark.createDataFrame(pdf)


def first_run(frames):
    out = [frames[0]]
    for f in frames[1:]:
        if f != out[-1] + 1:
            break
        out.append(f)
    return out


@pytest.mark.parametrize("size", [4, 65536])
def test_first_segment_and_gradient(spark, size):
    pdf, df = tracks(spark)
    seg = W.first_contiguous_segment(df, ["track"], "frame", 3, size)
    got = seg.toPandas()
    want = [(t, f) for t, p in pdf.groupby("track") for f in first_run(sorted(p["frame"])) if len(first_run(sorted(p["frame"]))) >= 3]
    assert sorted(zip(got["track"], got["frame"])) == sorted(want)
    grad = W.central_gradient(seg, ["track"], "frame", ["x"], 0.5, size=size).toPandas()
    for _, p in grad.groupby("track"):
        p = p.sort_values("frame")
        np.testing.assert_allclose(p["d_x"], np.gradient(p["x"].to_numpy(), 0.5))


@pytest.mark.parametrize("size", [2, 65536])
def test_forward_velocity_skips_gaps(spark, size):
    pdf, df = tracks(spark, 1)
    got = W.forward_velocity(df, ["track"], "frame", ["x"], 10.0, size).toPandas().set_index(["track", "frame"])
    want = {}
    for t, p in pdf.groupby("track"):
        s = p.set_index("frame")["x"]
        for f in s.index:
            if f + 1 in s.index:
                want[t, f] = ((s[f] + s[f + 1]) / 2, (s[f + 1] - s[f]) * 10)
    assert set(got.index) == set(want)
    for k, (mid, v) in want.items():
        assert got.loc[k, "x_mid"] == pytest.approx(mid) and got.loc[k, "v_x"] == pytest.approx(v)


@pytest.mark.parametrize("k", [1, 4, 5])
def test_moving_mean(spark, k):
    x = np.random.default_rng(2).normal(size=50)
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "n": np.arange(50), "x": x}))
    got = W.moving_mean(df, ["g"], "n", ["x"], k, size=6).toPandas().sort_values("n")["mm_x"]
    b, a = k // 2, (k - 1) // 2
    np.testing.assert_allclose(got, [x[max(0, i - b) : i + a + 1].mean() for i in range(50)])


def test_peak_region_and_rms(spark):
    x = [0.0, 5, 0, 2, 9, 3, 0.1, 8, 0]
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "n": range(9), "x": x}))
    got = W.peak_region(df, ["g"], "n", "x", 0.15).toPandas().sort_values("n")["in_peak"]
    assert list(got) == [False, False, False, True, True, True, False, False, False]
    row = W.peak_rms(df, ["g"], "n", "x", 0.15).first()
    assert row["rms_peak"] == pytest.approx(np.sqrt(np.mean(np.square([2, 9, 3]))))


def test_trapezoids(spark):
    t = np.sort(np.random.default_rng(4).random(30))
    y = np.sin(t)
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "n": range(30), "t": t, "y": y, "upto": 12}))
    steps = (t[1:] - t[:-1]) * (y[1:] + y[:-1]) / 2
    cum = W.cumulative_trapezoid(df, ["g"], "n", "t", "y", size=5).toPandas().sort_values("n")["integral"]
    np.testing.assert_allclose(cum, np.r_[0, np.cumsum(steps)])
    assert W.trapezoid(df, ["g"], "n", "t", "y", "a", "upto", size=5).first()["a"] == pytest.approx(steps[:12].sum())


def test_even_subsample_and_first_below(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "n": range(23), "x": np.linspace(1, 0, 23)}))
    got = sorted(r["n"] for r in W.even_subsample(df, ["g"], "n", 6).collect())
    assert got == [int(np.floor(v + 0.5)) - 1 for v in np.linspace(1, 23, 6)]
    assert W.first_below(df, ["g"], "n", "x", 0.5).first()["first"] == 12
    assert W.first_below(df, ["g"], "n", "x", -1.0).first()["first"] == 22


def direct_filtfilt(x, order, fc, fs):
    """Sample-by-sample cascade with reflected ends and steady start, for comparison."""
    sections = W.butterworth_sections(order, fc, fs)
    pad = 3 * order
    ext = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]

    def once(v):
        out = v
        level = v[0]
        for b0, b1, b2, a1, a2 in sections:
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            s2 = level * (b2 - a2 * gain)
            s1 = level * (b1 - a1 * gain) + s2
            y = np.empty_like(out)
            for i, u in enumerate(out):
                y[i] = b0 * u + s1
                s1 = b1 * u - a1 * y[i] + s2
                s2 = b2 * u - a2 * y[i]
            out, level = y, level * gain
        return out

    return once(once(ext)[::-1])[::-1][pad : pad + len(x)]


@pytest.mark.parametrize("size", [37, 128, 4096])
def test_lowpass_blocks_equal_one_sequential_pass(spark, size):
    rng = np.random.default_rng(6)
    parts = [pd.DataFrame({"g": g, "n": np.arange(n), "x": rng.normal(size=n).cumsum()}) for g, n in enumerate([400, 1000])]
    df = spark.createDataFrame(pd.concat(parts))
    got = W.zero_phase_lowpass(df, ["g"], "n", "x", "s", fc=10, fs=500, size=size).toPandas()
    for part in parts:
        g = part["g"].iloc[0]
        have = got[got["g"] == g].sort_values("n")["s"].to_numpy()
        np.testing.assert_allclose(have, direct_filtfilt(part["x"].to_numpy(), 6, 10, 500), atol=1e-8)


def test_lowpass_passes_slow_and_removes_fast(spark):
    n = np.arange(2000)
    slow, fast = np.sin(2 * np.pi * n / 1000), np.sin(2 * np.pi * n / 8)
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "n": n, "x": slow + fast}))
    got = W.zero_phase_lowpass(df, ["g"], "n", "x", "s", fc=10, fs=1000).toPandas().sort_values("n")["s"].to_numpy()
    np.testing.assert_allclose(got[200:-200], slow[200:-200], atol=0.01)


# ------------------------------------------------------------------- gates


def walk(seed, n=150):
    rng = np.random.default_rng(seed)
    frames = np.flatnonzero(rng.random(n) < 0.8)
    p = rng.normal(scale=4, size=(len(frames), 4)).cumsum(axis=0)
    p[rng.random(len(frames)) < 0.2] += 200
    return pd.DataFrame({"camera": seed, "frame": frames, **dict(zip(("x0", "y0", "x1", "y1"), p.T))})


def sequential(pdf, limit, gap=5):
    last, out = None, {}
    for r in pdf.sort_values("frame").itertuples():
        ok = True
        if last is not None:
            reach = limit * min(r.frame - last.frame, gap)
            ok = np.hypot(r.x0 - last.x0, r.y0 - last.y0) <= reach and np.hypot(r.x1 - last.x1, r.y1 - last.y1) <= reach
        if ok:
            last = r
        out[r.frame] = ok
    return out


def test_jump_gate_takes_a_fixed_number_of_jobs(spark, monkeypatch):
    """A state that rejects block after block, and ordinary walks: the same number of written tables, the sequential result."""
    passes, cut = {}, Q.cut
    stuck = walk(1, 400)
    stuck.loc[stuck["frame"] > 30, ["x0", "y0", "x1", "y1"]] += 1e6  # the track never comes back
    back = walk(2, 400)
    back.loc[(back["frame"] > 30) & (back["frame"] < 330), ["x0", "x1"]] += 1e6
    for name, pdf in {"calm": walk(0, 400), "stuck": stuck, "both": pd.concat([stuck, back, walk(3, 60)])}.items():
        passes[name] = []
        monkeypatch.setattr(Q, "cut", lambda df, held=passes[name]: held.append(1) or cut(df))
        got = Q.jump_gate(spark.createDataFrame(pdf), ["camera"], 20.0, size=16).toPandas()
        for camera, part in got.groupby("camera"):
            assert part.set_index("frame")["accepted"].to_dict() == sequential(pdf[pdf["camera"] == camera], 20.0)
    assert max(map(len, passes.values())) <= 1 + 4 * (1 + Q.ROUNDS)



@pytest.mark.parametrize("size", [25, 65536])
@pytest.mark.parametrize("limit", [8.0, 30.0])
def test_jump_gate_equals_sequential_fold(spark, size, limit):
    parts = [walk(s) for s in range(2)]
    got = Q.jump_gate(spark.createDataFrame(pd.concat(parts)), ["camera"], limit, size=size).toPandas()
    for part in parts:
        have = got[got["camera"] == part["camera"].iloc[0]].set_index("frame")["accepted"].to_dict()
        assert have == sequential(part, limit)


def test_simple_gates(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.1), (0, 0.9), (0, 9.0), (1, 2.0), (1, 2.0)], "g int, v double")
    kept = Q.mad_outliers(df, "v", ["g"], 3.0, 0.0).filter("accepted").toPandas()
    assert sorted(kept["v"]) == [0.9, 1.0, 1.1, 2.0, 2.0]
    flags = {r["g"]: r["contaminated"] for r in Q.cv_flag(df, "v", ["g"]).collect()}
    assert flags == {0: True, 1: False}
    pairs = spark.createDataFrame([(0, 1.0, 0.0), (0, 2.0, 1.0), (0, 1.0, 0.9)], "camera int, bright double, dim double")
    gate = Q.brightness_ratio_gate(pairs, 1.5).toPandas()
    assert list(gate["accepted"]) == [False, True, False] and gate["ratio"].isna().sum() == 1
    bounds = Q.per_camera({0: 1.0})
    assert spark.range(2).select(F.col("id").alias("camera"), bounds.alias("b")).orderBy("camera").collect()[1]["b"] is None

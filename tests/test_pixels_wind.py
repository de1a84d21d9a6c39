import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wakegrid.functions import scalars as P
from wakegrid.operators import pixels as X
from wakegrid.operators import wind as M


def image(seed, h=40, w=50, levels=12):
    return np.random.default_rng(seed).integers(0, levels, (h, w))


def table(spark, frames):
    rows = []
    for (cam, f), img in frames.items():
        r, c = np.indices(img.shape)
        rows.append(pd.DataFrame({"cam": cam, "frame": f, "row": r.ravel(), "col": c.ravel(), "value": img.ravel()}))
    return spark.createDataFrame(pd.concat(rows))


def brute_maxima(img, half, thr):
    h, w = img.shape
    return {
        (r, c)
        for r in range(h)
        for c in range(w)
        if img[r, c] > thr and img[r, c] >= img[max(0, r - half) : r + half + 1, max(0, c - half) : c + half + 1].max()
    }


def greedy(img, peaks, radius):
    kept = []
    for r, c in sorted(peaks, key=lambda p: (-img[p], p[1], p[0])):
        if all((r - a) ** 2 + (c - b) ** 2 > radius**2 for a, b in kept):
            kept.append((r, c))
    return set(kept)


def test_maxima_and_greedy_suppression(spark):
    frames = {(0, 0): image(0), (0, 1): image(1), (1, 0): image(2, levels=4)}
    px = table(spark, frames)
    peaks = X.local_maxima(px, 3, 2).cache()
    kept = X.suppress_peaks(peaks, 4.0).toPandas()
    got = peaks.toPandas()
    for (cam, f), img in frames.items():
        mine = got[(got["cam"] == cam) & (got["frame"] == f)]
        want = brute_maxima(img, 1, 2)
        assert set(zip(mine["row"], mine["col"])) == want
        left = kept[(kept["cam"] == cam) & (kept["frame"] == f)]
        assert set(zip(left["row"], left["col"])) == greedy(img, want, 4.0)


@pytest.mark.parametrize("tile", [512, 9])
def test_suppression_over_tiles_takes_two_passes(spark, monkeypatch, tile):
    """A falling chain across the whole image, and random peaks, in squares that are smaller than the chain."""
    rng = np.random.default_rng(3)
    img = np.zeros((70, 90), int)
    img[20, :] = np.arange(200, 110, -1)
    img[40:, :] = rng.integers(0, 6, (30, 90))
    at = {(int(r), int(c)) for r, c in np.argwhere(img)}
    peaks = spark.createDataFrame([(0, 0, r, c, int(img[r, c])) for r, c in at], "cam int, frame int, row int, col int, value int")
    passes = []
    monkeypatch.setattr(X, "cut", lambda df, cut=X.cut: passes.append(1) or cut(df))
    got = X.suppress_peaks(peaks, 2.0, tile).collect()
    assert {(r["row"], r["col"]) for r in got} == greedy(img, at, 2.0)
    assert len(passes) == 1


def flood(mask):
    label = -np.ones(mask.shape, int)
    for r, c in np.argwhere(mask):
        if label[r, c] >= 0:
            continue
        ident, todo = r * mask.shape[1] + c, [(r, c)]
        label[r, c] = ident
        while todo:
            a, b = todo.pop()
            for da in (-1, 0, 1):
                for db in (-1, 0, 1):
                    x, y = a + da, b + db
                    if 0 <= x < mask.shape[0] and 0 <= y < mask.shape[1] and mask[x, y] and label[x, y] < 0:
                        label[x, y] = ident
                        todo.append((x, y))
    return label


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_blobs_across_tiles(spark, tile):
    spiral = np.zeros((40, 50), int)
    for k in range(0, 20, 4):
        spiral[k, k : 50 - k] = spiral[k : 40 - k, 49 - k] = spiral[39 - k, k : 50 - k] = 1
        spiral[k + 4 : 40 - k, k] = 1
        if k + 4 < 40:
            spiral[k + 4, max(k - 0, 0) : k + 5] = 1
    frames = {(0, 0): image(3) > 7, (0, 1): spiral > 0}
    px = table(spark, {k: v.astype(int) for k, v in frames.items()}).filter("value > 0")
    got = X.label_blobs(px, 50, tile).toPandas()
    for (cam, f), mask in frames.items():
        want = flood(mask)
        mine = got[(got["cam"] == cam) & (got["frame"] == f)]
        assert len(mine) == mask.sum()
        assert (want[mine["row"], mine["col"]] == mine["blob"]).all()
    if tile == 64:
        stats = X.blobs(px, 50, 3, 10**6, tile).toPandas()
        assert (stats["area"] >= 3).all()


def test_subpixel_recovers_a_gaussian(spark):
    r, c = np.indices((15, 15))
    img = 100 * np.exp(-((r - 7.3) ** 2 + (c - 6.8) ** 2) / (2 * 1.2**2))
    px = table(spark, {(0, 0): img})
    peaks = X.local_maxima(px, 3, 50)
    row = X.subpixel_gauss3(peaks, px, (15, 15)).first()
    assert (row["y"], row["x"]) == (pytest.approx(7.3), pytest.approx(6.8))
    # a border peak stays on its pixel
    edge = table(spark, {(0, 0): np.pad(np.zeros((4, 4)), ((1, 0), (0, 0)), constant_values=9.0)})
    for p in X.subpixel_gauss3(X.local_maxima(edge, 3, 1), edge, (5, 4)).collect():
        assert (p["x"], p["y"]) == (p["col"], p["row"])


def test_peak_sigma(spark):
    r, c = np.indices((41, 41))
    img = 50 * np.exp(-((r - 20) ** 2 + (c - 20) ** 2) / (2 * 2.0**2)) + 3
    px = table(spark, {(0, 0): img})
    got = X.peak_sigma(px, X.local_maxima(px, 3, 40), (41, 41), r=10).first()["sigma"]
    patch = img[10:31, 10:31] - img[10:31, 10:31].min()
    y, x = np.indices(patch.shape) - 10
    want = np.sqrt(((x**2 + y**2) * patch).sum() / patch.sum() / 2)
    assert got == pytest.approx(want)


def test_otsu(spark):
    rng = np.random.default_rng(4)
    img = np.clip(np.where(rng.random((30, 30)) < 0.3, rng.normal(60, 8, (30, 30)), rng.normal(180, 10, (30, 30))), 0, 255).astype(int)
    t = X.otsu_threshold(table(spark, {(0, 0): img}), ["cam"]).first()["threshold"]
    p = np.bincount(img.ravel(), minlength=256) / img.size
    w, mu = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(all="ignore"):
        s = np.where(w * (1 - w) > 1e-12, (mu[-1] * w - mu) ** 2 / (w * (1 - w)), -np.inf)
    assert t == int(np.argmax(s.round(9)))


def test_background_and_gain(spark):
    frames = {(0, f): np.full((2, 2), v) for f, v in enumerate([5, 7, 100])}
    px = table(spark, frames)
    back = X.temporal_background(px)
    assert {r["background"] for r in back.collect()} == {7.0}
    left = X.subtract_background(px, back).groupBy("frame").agg(F.max("value").alias("v"))
    assert {r["frame"]: r["v"] for r in left.collect()} == {0: 0.0, 1: 0.0, 2: 93.0}
    gain = spark.createDataFrame([(0, 2.0)], "cam long, gain double")
    noise = spark.createDataFrame([(0, 1.0)], "cam long, sigma double")
    out = X.equalise_gain(px, gain, noise, 1.0, 50)
    assert sorted({r["value"] for r in out.collect()}) == [8, 12, 50]


# ------------------------------------------------------------------- wind


def test_wrapping_rules(spark):
    values = [0.0, 180.0, -180.0, 540.0, -540.0, 190.0, -190.0, 360.0, 720.0, -360.0]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    rows = df.select(P.wrap180("a").alias("h"), P.wrap360("a").alias("f")).collect()
    assert [r["h"] for r in rows] == [0, 180, -180, 180, -180, -170, 170, 0, 0, 0]
    assert [r["f"] for r in rows] == [0, 180, 180, 180, 180, 190, 170, 360, 360, 0]


def test_border_direction_counts_in_both_sectors(spark):
    farm = spark.createDataFrame([(5.0, 1.0), (7.0, 3.0), (0.0, 10.0), (359.0, 20.0)], "mean_dir double, total double")
    got = {r["centre"]: (r["n"], r["mean_power"]) for r in M.power_by_direction(farm).collect()}
    assert got == {2.5: (2, 5.5), 7.5: (2, 2.0), 357.5: (2, 15.0)}
    worst = M.worst_direction(M.power_by_direction(farm), min_n=2).first()
    assert worst["centre"] == 7.5


def test_wake_row_flips_the_opposite_wind(spark):
    rows = []
    for ts, d, p in [(0, 300.0, (10.0, 8.0, 9.0)), (1, 120.0, (4.0, 6.0, 8.0)), (2, 10.0, (1.0, 1.0, 1.0))]:
        rows += [(ts, k, d, q) for k, q in zip((2, 3, 4), p)]
    scada = spark.createDataFrame(rows, "ts int, turbine int, wind_dir double, power double")
    got = {r["position"]: (r["n"], r["mean"]) for r in M.wake_row(scada, 300.0, 5.0, [2, 3, 4]).collect()}
    assert got == {1: (2, 1.0), 2: (2, pytest.approx((0.8 + 0.75) / 2)), 3: (2, pytest.approx((0.9 + 0.5) / 2))}


def test_roughness_from_a_log_profile(spark):
    z = np.array([3.0, 10, 30, 55, 80, 130])
    psi0, us, length = 0.0029, 0.4, -60.0
    x = (1 - 15 * z / length) ** 0.25
    psi = -2 * np.log((1 + x) / 2) - np.log(1 + x**2) + 2 * np.arctan(x) - np.pi / 2
    u = us / 0.4 * (np.log(z / psi0) + psi)
    u[2] += 3.0  # an outlier the weights have to ignore
    prof = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(z, u)], "r int, height double, speed double")
    stab = spark.createDataFrame([(0, us, length)], "r int, friction double, obukhov double")
    row = M.roughness_fit(prof, stab, ["r"], "height").first()
    assert row["z0"] == pytest.approx(psi0, rel=1e-6) and row["levels"] == 6


def test_datenum_and_pressure(spark):
    row = spark.range(1).select(
        P.datenum_to_ts(F.lit(719529.5)).cast("string").alias("t"),
        P.datenum_to_ts(F.lit(719529.5), "America/Denver").cast("string").alias("d"),
        P.pressure_at(F.lit(81100.0), F.lit(100.0), F.lit(290.0)).alias("p"),
        P.ratio_column(F.lit(1.0), F.lit(0.0)).alias("r"),
    ).first()
    assert row["t"] == "1970-01-01 12:00:00" and row["d"] == "1970-01-01 05:00:00"
    assert row["p"] < 81100 and row["r"] is None

"""Binning, spectra, fits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wakegrid.operators import binning as A
from wakegrid.operators import spectral as G
from wakegrid.operators import turbulence as B
from wakegrid.operators.binning import Axis


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.uniform(-1, 1, (3000, 6)), columns=list("xyzuvw"))
    pdf["run"] = np.where(rng.random(3000) < 0.8, 0, 1)
    return pdf, spark.createDataFrame(pdf).cache()


def test_bin_edges(spark):
    values = [-0.1, 0.0, 0.999, 1.0, 9.999, 10.0, 10.001, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["b"] for r in df.select(A.uniform_bins("v", 0, 10, 10).alias("b")).collect()]
    assert got == [None, 1, 1, 2, 10, 10, None, None]
    cosine = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 1.0, 1.1)], "v double")
    assert [r["b"] for r in cosine.select(A.cosine_bins("v", 4).alias("b")).collect()] == [1, 3, 4, None]
    with pytest.raises(ValueError):
        A.uniform_bins("v", 1, 1, 3)


GRID = (Axis("x", -1, 1, 4), Axis("y", -1, 1, 5), Axis("z", -0.9, 0.9, 3))


def test_one_pass_stress_equals_two_passes(samples):
    pdf, df = samples
    got = A.with_tke(A.reynolds_stress(df, GRID)).toPandas().set_index(["ix", "iy", "iz"])
    inside = pdf[pdf["z"].abs() <= 0.9].copy()
    for a in GRID:
        inside[a.name] = np.minimum(np.floor((inside[a.column] - a.lo) * a.n / (a.hi - a.lo)) + 1, a.n).astype(int)
    assert got["n"].sum() == len(inside)
    for key, part in inside.groupby(["ix", "iy", "iz"]):
        c = np.cov(part[["u", "v", "w"]].T, bias=True)
        row = got.loc[key]
        np.testing.assert_allclose(row[["uu", "vv", "ww", "uv", "uw", "vw"]].astype(float), [c[0, 0], c[1, 1], c[2, 2], c[0, 1], c[0, 2], c[1, 2]], atol=1e-12)
        assert row["tke"] == pytest.approx(np.trace(c) / 2)


def test_plane_average_is_not_weighted(spark):
    bins = spark.createDataFrame([(1, 1, 99, 1.0), (2, 1, 1, 3.0), (1, 2, 5, 7.0)], "ix int, iy int, n int, u double")
    got = {r["iy"]: r["u"] for r in A.plane_average(bins, ["iy"], ["u"]).collect()}
    assert got == {1: 2.0, 2: 7.0}


def test_resolution_sweep_is_consistent(samples):
    pdf, df = samples
    got = A.resolution_sweep(df, Axis("y", -1, 1, 4), [4, 8, 16]).toPandas()
    for n, part in got.groupby("bins"):
        assert part["n"].sum() == len(pdf) and len(part) == n


def test_poly_fit_recovers_a_polynomial(spark):
    rng = np.random.default_rng(1)
    e = rng.uniform(1, 3, (500, 2))
    pdf = pd.DataFrame({"g": np.arange(500) % 2, "e1": e[:, 0], "e2": e[:, 1]})
    df = spark.createDataFrame(pdf).withColumn("y", 2 + F.pow("e1", 5) - 3 * F.col("e1") * F.pow("e2", 3) + F.col("g") * F.col("e2"))
    fit = A.poly_calibration_fit(df, "e1", "e2", {"y": F.col("y")}, ["g"])
    both = df.join(fit.drop("target"), "g").withColumn("p", A.predict_poly("e1", "e2"))
    worst = both.agg(F.max(F.abs(F.col("p") - F.col("y")))).first()[0]
    assert worst < 1e-6
    errors = A.fit_errors(both, "p", "y", ["g"]).toPandas()
    assert (errors["absolute"] < 1e-6).all()


def test_singular_energy(spark):
    m = np.random.default_rng(2).normal(size=(200, 6)) * np.array([5, 3, 2, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i % 2, [float(v) for v in r]) for i, r in enumerate(m)], "g int, e array<double>")
    got = A.singular_energy(df, "e", 6, [1, 3, 6]).toPandas().set_index("k")
    s = np.linalg.svd(m, compute_uv=False)
    for k in (1, 3, 6):
        assert got.loc[k, "sigma"] == pytest.approx(s[k - 1], rel=1e-6)
        assert got.loc[k, "frobenius"] == pytest.approx(np.sqrt((s[k:] ** 2).sum()), abs=1e-6)
        assert got.loc[k, "energy"] == pytest.approx((s[:k] ** 2).sum() / (s**2).sum())
    by = A.singular_energy(df, "e", 6, [1], ["g"]).toPandas().set_index("g")
    assert by.loc[1, "sigma"] == pytest.approx(np.linalg.svd(m[1::2], compute_uv=False)[0])


def test_integration_rules(spark):
    x = np.linspace(0, 2, 9)
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "n": range(9), "x": x, "f": x**3}))
    row = A.simpson_trapezoid(df, ["g"], "x", "f", "n").first()
    assert row["simpson"] == pytest.approx(4.0) and row["trapezoid"] == pytest.approx(np.trapezoid(x**3, x))
    odd = A.simpson_trapezoid(df.filter("n < 8"), ["g"], "x", "f", "n").first()
    assert odd["simpson"] is None


# ------------------------------------------------------------------ spectra

SHAPE = (8, 6, 4)
AXES = tuple(Axis(c, 0, L, n) for c, L, n in zip("xyz", (2.0, 3.0, 1.0), SHAPE))


def field_frame(spark, **values):
    idx = np.argwhere(np.ones(SHAPE, bool))
    return spark.createDataFrame(pd.DataFrame({**dict(zip("ijk", idx.T)), **{n: v[tuple(idx.T)] for n, v in values.items()}}))


def to_array(df, c):
    out = np.full(SHAPE, np.nan)
    for r in df.collect():
        out[r["i"], r["j"], r["k"]] = r[c]
    return out


def test_grid_fft_and_back(spark):
    v = np.random.default_rng(3).normal(size=SHAPE)
    df = G.as_complex(field_frame(spark, v=v), ["v"])
    shape = dict(zip("ijk", SHAPE))
    hat = G.grid_fft(df, [], shape, ["v"])
    want = np.fft.fftn(v)
    np.testing.assert_allclose(to_array(hat, "v_re"), want.real, atol=1e-9)
    np.testing.assert_allclose(to_array(hat, "v_im"), want.imag, atol=1e-9)
    np.testing.assert_allclose(to_array(G.grid_fft(hat, [], shape, ["v"], True), "v_re"), v, atol=1e-12)


def test_incomplete_line_raises(spark):
    df = G.as_complex(field_frame(spark, v=np.ones(SHAPE)), ["v"]).filter("not (i = 3 and j = 2 and k = 1)")
    with pytest.raises(Exception, match="does not hold 8 nodes"):
        G.pencil_fft(df, ["j", "k"], "i", 8, ["v"]).collect()


def test_pressure_against_numpy(spark):
    rng = np.random.default_rng(4)
    t = {f"t{s}": rng.normal(size=SHAPE) for s in A.STRESSES}
    got = G.pressure_poisson(field_frame(spark, **t), [], AXES)
    k = [2 * np.pi / (a.hi - a.lo) * np.r_[0 : a.n // 2 + 1, -a.n // 2 + 1 : 0] for a in AXES]
    kx, ky, kz = np.meshgrid(*k, indexing="ij")
    w = dict(zip("uvw", (kx, ky, kz)))
    s = sum((1 if q[0] == q[1] else 2) * w[q[0]] * w[q[1]] * np.fft.fftn(t[f"t{q}"]) for q in A.STRESSES)
    k2 = kx**2 + ky**2 + kz**2
    p = np.where(k2 > 0, -s / np.where(k2 > 0, k2, 1), 0)
    np.testing.assert_allclose(to_array(got, "p"), np.fft.ifftn(p).real, atol=1e-10)
    np.testing.assert_allclose(to_array(got, "source"), np.fft.ifftn(s).real, atol=1e-8)
    with pytest.raises(ValueError):
        G.wavenumber("i", 5, 1.0)


@pytest.mark.parametrize("nseg, overlap", [(32, 16), (25, 5), (16, 0)])
def test_welch(spark, nseg, overlap):
    fs, parts = 50.0, {}
    rng = np.random.default_rng(5)
    for g, n in enumerate((200, 333)):
        parts[g] = rng.normal(size=n).cumsum() + 0.1 * np.arange(n)
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"g": g, "n": np.arange(len(x)), "x": x}) for g, x in parts.items()]))
    got = G.welch_psd(df, ["g"], "n", "x", nseg, overlap, fs).toPandas()
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(nseg) / (nseg - 1))
    for g, x in parts.items():
        n = np.arange(len(x))
        d = x - np.polyval(np.polyfit(n, x, 1), n)
        count = (len(x) - overlap) // (nseg - overlap)
        power = np.mean([np.abs(np.fft.rfft(d[s * (nseg - overlap) :][:nseg] * w)) ** 2 for s in range(count)], axis=0) / (fs * (w**2).sum())
        power[1 : -1 if nseg % 2 == 0 else None] *= 2
        part = got[got["g"] == g].sort_values("bin")
        np.testing.assert_allclose(part["psd"], power, rtol=1e-8)
        assert (part["segments"] == count).all()


def ring(spark, n, **f):
    x = np.arange(n) * 2 * np.pi / n
    return spark.createDataFrame(pd.DataFrame({"g": 0, "i": range(n), **{k: v(x) for k, v in f.items()}}))


def test_spectral_derivative_is_exact_for_a_sine(spark):
    got = G.spectral_derivative(ring(spark, 16, f=lambda x: np.sin(3 * x)), ["g"], "i", "f", 16, 2 * np.pi).toPandas().sort_values("i")
    x = np.arange(16) * 2 * np.pi / 16
    np.testing.assert_allclose(got["d_fft"], 3 * np.cos(3 * x), atol=1e-12)
    assert np.abs(got["d_central"] - 3 * np.cos(3 * x)).max() > 0.1


def test_amplitudes_and_dealiasing(spark):
    df = ring(spark, 16, a=lambda x: np.sin(6 * x), b=lambda x: np.sin(7 * x))
    amp = {r["wave"]: r["amplitude"] for r in G.fourier_amplitudes(df, ["g"], "i", "a", 16).collect()}
    assert amp == {6: pytest.approx(0.5), -6: pytest.approx(0.5)}
    # sin6 sin7 = (cos 1 - cos 13)/2; mode 13 folds onto mode 3 unless removed.
    got = G.dealiased_product(df, ["g"], "i", "a", "b", 16).toPandas().sort_values("mode")
    plain, clean = got["plain_re"].to_numpy(), got["clean_re"].to_numpy()
    assert plain[1] == pytest.approx(0.25) and plain[3] == pytest.approx(-0.25)
    assert clean[1] == pytest.approx(0.25) and abs(clean[3]) < 1e-12


def test_poisson_2d(spark):
    n = 16
    i, j = np.meshgrid(range(n), range(n), indexing="ij")
    x, y = 2 * np.pi * i / n, 2 * np.pi * j / n
    df = spark.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "f": (np.sin(2 * x) * np.cos(3 * y)).ravel()}))
    got = G.poisson2d_fft(df, [], "f", (n, n), (2 * np.pi, 2 * np.pi)).toPandas().sort_values(["i", "j"])["phi"]
    np.testing.assert_allclose(got, (-np.sin(2 * x) * np.cos(3 * y) / 13).ravel(), atol=1e-12)


def test_xcorr_and_scales(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=120), rng.normal(size=120)
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "n": range(120), "a": a, "b": b}))
    got = B.xcorr(df, ["g"], "n", "a", "b", 7, 0.1, size=11).toPandas().set_index("lag")["r"]
    z = np.sqrt((a * a).sum() * (b * b).sum())
    for m in range(-7, 8):
        want = sum(a[n + m] * b[n] for n in range(120) if 0 <= n + m < 120) / z
        assert got[m] == pytest.approx(want)
    lags = np.arange(-10, 11)
    curve = spark.createDataFrame(pd.DataFrame({"g": 0, "lag": lags, "tau": lags * 0.1, "r": 1 - (lags * 0.1) ** 2 / 8}))
    speeds = spark.createDataFrame([(0, 5.0)], "g long, s double")
    row = B.taylor_scale(curve, speeds, ["g"], "r", "s", 10).first()
    assert row["taylor_t"] == pytest.approx(2.0) and row["taylor_x"] == pytest.approx(10.0)
    g = B.isotropic_transverse(curve.withColumn("d", F.col("tau") * 5), ["g"], "r", "d").toPandas().set_index("lag")["g_iso"]
    assert g[3] == pytest.approx(1 - 2 * 0.09 / 8)


def lines(rng, n, groups=2):
    z = rng.normal(size=(groups, n)) + 1j * rng.normal(size=(groups, n))
    rows = [(g, i, float(z[g, i].real), float(z[g, i].imag)) for g in range(groups) for i in range(n)]
    return z, rows


@pytest.mark.parametrize("n", [512, 1200, 509, 2 * 257])
@pytest.mark.parametrize("inverse", [False, True])
def test_folded_transform_equals_the_whole_one(spark, monkeypatch, n, inverse):
    """Lines of at most 64 nodes: powers of two, mixed factors, primes, and a prime above the limit."""
    z, rows = lines(np.random.default_rng(n), n)
    df = spark.createDataFrame(rows, "g int, i long, v_re double, v_im double")
    held = []
    monkeypatch.setattr(G, "transform_lines", lambda df, keys, axis, m, *a, f=G.transform_lines, **b: held.append(m) or f(df, keys, axis, m, *a, **b))
    got = G.pencil_fft(df, ["g"], "i", n, ["v"], inverse, line=64).toPandas().sort_values(["g", "i"])
    want = (np.fft.ifft if inverse else np.fft.fft)(z, axis=1).ravel()
    np.testing.assert_allclose(got["v_re"] + 1j * got["v_im"], want, atol=1e-9)
    assert held and max(held) <= 64


def test_long_derivative_and_product(spark, monkeypatch):
    n, rng = 240, np.random.default_rng(1)
    f, h = rng.normal(size=n), rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "f": f, "h": h}))
    short = G.spectral_derivative(df, [], "i", "f", n, 3.0).toPandas().sort_values("i")
    product = G.dealiased_product(df, [], "i", "f", "h", n).toPandas().sort_values("mode")
    monkeypatch.setattr(G, "LINE", 32)
    long = G.spectral_derivative(df, [], "i", "f", n, 3.0).toPandas().sort_values("i")
    np.testing.assert_allclose(long[["f", "d_fft", "d_central"]], short[["f", "d_fft", "d_central"]], atol=1e-8)
    again = G.dealiased_product(df, [], "i", "f", "h", n).toPandas().sort_values("mode")
    np.testing.assert_allclose(again, product[again.columns], atol=1e-10)


def test_a_line_of_a_quarter_million_nodes(spark):
    n = 1 << 18
    df = spark.range(n).select(F.col("id").alias("i"), F.cos(F.col("id") * (2 * np.pi * 1000 / n)).alias("v_re"), F.lit(0.0).alias("v_im"))
    got = G.pencil_fft(df, [], "i", n, ["v"], line=1024).where("abs(v_re) + abs(v_im) > 1").collect()
    assert {(r["i"], round(r["v_re"] / n, 9)) for r in got} == {(1000, 0.5), (n - 1000, 0.5)}

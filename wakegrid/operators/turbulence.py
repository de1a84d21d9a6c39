"""Single-point turbulence statistics (B operators)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import BLOCK, attach
from .binning import group_stats, predict_poly
from .lagrangian import integral_timescale, lag_sums
from .spectral import welch_psd


def xcorr(
    df: DataFrame, by: Sequence[str], index: str, a: str, b: str, max_lag: int, dt: float,
    name: str = "r", size: int = BLOCK, method: str = "auto",
) -> DataFrame:
    """Correlation of a(i+lag) with b(i), biased sums over sqrt(Raa(0) Rbb(0)), lags -max..max.

    Positive and negative lags are two columns of one pass over the records.
    """
    by = list(by)
    rows = df.select(*by, index, F.col(a).alias("_a"), F.col(b).alias("_b")).withColumns(
        {"_a2": F.col("_a"), "_b2": F.col("_b")}
    )
    sums = lag_sums(
        rows, by, [], index, ["_b", "_a", "_a2", "_b2"], max_lag, size, method, ahead=["_a", "_b", "_a2", "_b2"]
    )
    w = Window.partitionBy(*by).orderBy("lag")
    scale = F.sqrt(F.first("s__a2").over(w) * F.first("s__b2").over(w))
    rated = sums.select(
        *by, "lag", (F.col("s__b") / scale).alias("_p"), (F.col("s__a") / scale).alias("_m")
    )
    both = F.array(
        F.struct(F.col("lag").alias("lag"), F.col("_p").alias("r")),
        F.when(F.col("lag") > 0, F.struct((-F.col("lag")).alias("lag"), F.col("_m").alias("r"))),
    )
    return rated.select(*by, F.explode(F.array_compact(both)).alias("_x")).select(
        *by, F.col("_x.lag").alias("lag"), (F.col("_x.lag") * dt).alias("tau"), F.col("_x.r").alias(name)
    )


def spatial_lags(curve: DataFrame, speeds: DataFrame, by: Sequence[str], speed: str) -> DataFrame:
    """Time lags as distances with each case's own mean speed."""
    return attach(curve, speeds.select(*by, speed), by).withColumn("dist", F.col("tau") * F.col(speed)).drop(speed)


def taylor_scale(
    curve: DataFrame, speeds: DataFrame, by: Sequence[str], r: str, speed: str, half: int = 10
) -> DataFrame:
    """Taylor time and length scale from a parabola through the lags within ±half."""
    t, y = F.col("tau"), F.col(r)
    near = curve.filter(F.abs(F.col("lag")) <= half)
    s = near.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(F.pow(t, p)).alias(f"t{p}") for p in (1, 2, 3, 4)],
        F.sum(y).alias("y0"), F.sum(t * y).alias("y1"), F.sum(t * t * y).alias("y2"),
    )
    n, t1, t2, t3, t4, y0, y1, y2 = (F.col(c) for c in ("n", "t1", "t2", "t3", "t4", "y0", "y1", "y2"))
    det = n * (t2 * t4 - t3 * t3) - t1 * (t1 * t4 - t2 * t3) + t2 * (t1 * t3 - t2 * t2)
    quad = (n * (t2 * y2 - t3 * y1) - t1 * (t1 * y2 - t2 * y1) + y0 * (t1 * t3 - t2 * t2)) / det
    scale = F.when(quad < 0, F.sqrt(-1 / (2 * quad)))
    out = s.select(*by, scale.alias("taylor_t"))
    return attach(out, speeds.select(*by, speed), by).withColumn("taylor_x", F.col("taylor_t") * F.col(speed)).drop(speed)


def integral_scale(curve: DataFrame, speeds: DataFrame, by: Sequence[str], r: str, speed: str) -> DataFrame:
    """Integral time (to the first lag where r <= 0) and length."""
    ahead = curve.filter(F.col("lag") >= 0)
    out = integral_timescale(ahead, by, {"integral_t": r}, threshold=0.0, inclusive=True)
    return attach(out, speeds.select(*by, speed), by).withColumn("integral_x", F.col("integral_t") * F.col(speed)).drop(speed)


def dissipation_kolmogorov(
    scales: DataFrame, variance: Column, speed: Column, viscosity: float, diameter: float
) -> DataFrame:
    """Isotropic dissipation 15 ν u'²/λ², Kolmogorov scales, Reynolds numbers; expects taylor_x."""
    lam = F.col("taylor_x")
    eps = 15 * viscosity * variance / (lam * lam)
    return scales.withColumns(
        {
            "dissipation": eps,
            "eta": F.pow(viscosity**3 / eps, 0.25),
            "tau_eta": F.sqrt(viscosity / eps),
            "re_macro": speed * diameter / viscosity,
            "re_turb": F.sqrt(variance) * lam / viscosity,
        }
    )


def isotropic_transverse(curve: DataFrame, by: Sequence[str], f: str, dist: str, name: str = "g_iso") -> DataFrame:
    """Transverse correlation g = f + r f'/2 that isotropy predicts from the longitudinal one.

    A curve has one row per lag, so the window over it is bounded.
    """
    w = Window.partitionBy(*by).orderBy("lag")

    def ends(c: str) -> Column:
        return F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))

    return curve.withColumn(name, F.col(f) + 0.5 * F.col(dist) * ends(f) / ends(dist))


def apply_calibration(volts: DataFrame, fits: DataFrame, by: Sequence[str], e1: str, e2: str, speed: float) -> DataFrame:
    """Velocities u, v in units of the tunnel speed from fitted polynomials (targets U and V)."""
    out = volts
    for target, name in (("U", "u"), ("V", "v")):
        fit = fits.filter(F.col("target") == target).drop("target")
        out = attach(out, fit, by).withColumn(name, predict_poly(e1, e2) / speed).drop("coeffs", "c1", "s1", "c2", "s2")
    return out


def velocity_from_volts(
    volts: DataFrame, fits: DataFrame, by: Sequence[str], index: str, e1: str, e2: str, speed: float,
    nseg: int, fs: float,
) -> tuple[DataFrame, DataFrame]:
    """Mean and spread of u per case, and the spectrum of u with half-overlapping segments."""
    vel = apply_calibration(volts, fits, by, e1, e2, speed)
    return group_stats(vel, by, "u"), welch_psd(vel, by, index, "u", nseg, nseg // 2, fs)

"""Binning samples into grids, profiles and moments (A operators)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import attach, col, exact_quantiles
from ..functions.scalars import POLY5_EXPONENTS, poly5_features


@dataclass(frozen=True)
class Axis:
    """``n`` equal bins of one coordinate between ``lo`` and ``hi``."""

    column: str
    lo: float
    hi: float
    n: int

    @property
    def width(self) -> float:
        return (self.hi - self.lo) / self.n

    @property
    def name(self) -> str:
        return f"i{self.column}"

    def centre(self, index: Column) -> Column:
        return self.lo + (index - 0.5) * self.width


def uniform_bins(
    value: str | Column, lo: float | Column, hi: float | Column, n: int | Column
) -> Column:
    """1-based bin number; the last bin is closed, values outside give NULL."""
    v = col(value)
    if not isinstance(lo, Column) and not isinstance(hi, Column) and hi <= lo:
        raise ValueError("hi must exceed lo")
    count = n if isinstance(n, Column) else F.lit(n)
    number = F.floor((v - lo) * n / (hi - lo)) + 1
    return F.when((v >= lo) & (v <= hi), F.least(number, count.cast("bigint")))


def cosine_edges(n: int) -> list[float]:
    return [-math.cos(math.pi * i / n) for i in range(n + 1)]


def cosine_bins(value: str | Column, n: int) -> Column:
    """1-based bin number on edges clustered towards -1 and 1; last bin closed."""
    v = col(value)
    edges = F.array(*[F.lit(e) for e in cosine_edges(n)])
    passed = F.size(F.filter(edges, lambda e: e <= v)).cast("bigint")
    return F.when((v >= -1) & (v <= 1), F.least(passed, F.lit(n).cast("bigint")))


def padded_bounds(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), frac: float = 0.05
) -> DataFrame:
    """lo_c and hi_c per column: the range widened by ``frac`` on either side."""
    aggs = []
    for c in columns:
        lo, hi = F.min(c), F.max(c)
        aggs += [(lo - frac * (hi - lo)).alias(f"lo_{c}"), (hi + frac * (hi - lo)).alias(f"hi_{c}")]
    return df.groupBy(*by).agg(*aggs)


def with_bins(df: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Add a bin number per axis and drop samples outside the grid."""
    binned = df.withColumns({a.name: uniform_bins(a.column, a.lo, a.hi, a.n) for a in axes})
    return binned.dropna(subset=[a.name for a in axes])


def bin_means(
    df: DataFrame, axes: Sequence[Axis], values: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Count and mean of each value per bin; empty bins have no row."""
    keys = [*by, *[a.name for a in axes]]
    return with_bins(df, axes).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values]
    )


STRESSES = ("uu", "vv", "ww", "uv", "uw", "vw")


def reynolds_stress(df: DataFrame, axes: Sequence[Axis], by: Sequence[str] = ()) -> DataFrame:
    """Bin means and the six stresses about them, divided by the count; one pass."""
    keys = [*by, *[a.name for a in axes]]
    return with_bins(df, axes).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(c) for c in "uvw"],
        *[F.covar_pop(s[0], s[1]).alias(s) for s in STRESSES],
    )


def with_tke(df: DataFrame) -> DataFrame:
    return df.withColumn("tke", 0.5 * (F.col("uu") + F.col("vv") + F.col("ww")))


def plane_average(bins: DataFrame, keep: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Unweighted mean of the bin values over the other axes."""
    return bins.groupBy(*keep).agg(*[F.avg(v).alias(v) for v in values])


def dispersive_flux(bins: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Plane mean of products of (bin mean - plane mean), six components.

    The mean of centred products is the population covariance of the bin means.
    """
    return bins.groupBy(*keep).agg(*[F.covar_pop(s[0], s[1]).alias(f"d_{s}") for s in STRESSES])


def sample_counts(bins: DataFrame, sets: Sequence[Sequence[str]], axes: Sequence[str]) -> DataFrame:
    """Marginal sample counts over several sets of axes in one pass, and the least bin."""
    return bins.groupingSets([list(s) for s in sets], *axes).agg(
        F.sum("n").alias("total"), F.min("n").alias("least")
    )


def nearest_slice(bins: DataFrame, axis: Axis, by: Sequence[str] = (), target: float | None = None) -> DataFrame:
    """Rows of the plane whose centre is nearest ``target`` (default: the mean centre)."""
    planes = bins.select(*by, axis.name).distinct().withColumn("_c", axis.centre(F.col(axis.name)))
    if target is None:
        planes = attach(planes, planes.groupBy(*by).agg(F.avg("_c").alias("_t")), by)
    else:
        planes = planes.withColumn("_t", F.lit(float(target)))
    distance = F.struct(F.abs(F.col("_c") - F.col("_t")), F.col(axis.name))
    chosen = planes.groupBy(*by).agg(F.min_by(axis.name, distance).alias("_slice"))
    return attach(bins, chosen, by).filter(F.col(axis.name) == F.col("_slice")).drop("_slice")


def resolution_sweep(
    df: DataFrame, axis: Axis, counts: Sequence[int], others: Sequence[Axis] = (), by: Sequence[str] = ()
) -> DataFrame:
    """Bin means and stresses for several bin counts of one axis, in one job.

    Every sample is copied once per resolution inside its own task and partial
    sums are formed there, so only bins are shuffled.
    """
    swept = with_bins(df, others).withColumn(
        "bins", F.explode(F.array(*[F.lit(int(n)) for n in counts]))
    )
    number = uniform_bins(axis.column, axis.lo, axis.hi, F.col("bins"))
    keys = [*by, "bins", *[a.name for a in others], axis.name]
    return swept.withColumn(axis.name, number).dropna(subset=[axis.name]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(c) for c in "uvw"],
        *[F.covar_pop(s[0], s[1]).alias(s) for s in STRESSES],
    )


def sweep_profiles(sweep: DataFrame, height: str, by: Sequence[str] = ()) -> DataFrame:
    """Per resolution and height of a sweep: plane means, mean energy and dispersive fluxes."""
    keys = [*by, "bins", height]
    planes = with_tke(sweep).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in (*"uvw", "tke")])
    return planes.join(dispersive_flux(sweep, keys), keys)


def sweep_errors(profiles: DataFrame, height: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Relative errors of every resolution's profile against the finest one's."""
    from .spectral import rel_errors

    finest = attach(profiles, profiles.groupBy(*by).agg(F.max("bins").alias("_most")), by).filter(F.col("bins") == F.col("_most"))
    reference = finest.select(*by, height, *[F.col(v).alias(f"_r_{v}") for v in values])
    return rel_errors(profiles.join(reference, [*by, height]), [*by, "bins"], {v: f"_r_{v}" for v in values})


def profile_moments(df: DataFrame, height: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean velocity, stresses and energy at every tabulated height."""
    return with_tke(
        df.groupBy(*by, height).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(c).alias(c) for c in "uvw"],
            F.var_pop("u").alias("uu"),
            F.var_pop("v").alias("vv"),
            F.var_pop("w").alias("ww"),
            F.covar_pop("u", "v").alias("uv"),
        )
    )


def group_stats(df: DataFrame, by: Sequence[str], value: str, valid: Column | None = None) -> DataFrame:
    """n, mean, sample std, min, max and percentage of valid rows per group."""
    good = F.lit(True) if valid is None else valid
    v = F.when(good, F.col(value))
    return df.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (100.0 * F.count(v) / F.count(F.lit(1))).alias("pct_valid"),
    )


def skewness_flatness(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Third and fourth standardised moments (population form)."""
    aggs = []
    for c in columns:
        aggs += [F.skewness(c).alias(f"skew_{c}"), (F.kurtosis(c) + 3).alias(f"flat_{c}")]
    return df.groupBy(*by).agg(*aggs)


def normalised_stress(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """uu, vv and uv over the squared mean speed of the group."""
    scale = F.pow(F.avg("u"), 2)
    return df.groupBy(*by).agg(
        (F.var_pop("u") / scale).alias("uu"),
        (F.var_pop("v") / scale).alias("vv"),
        (F.covar_pop("u", "v") / scale).alias("uv"),
    )


def histogram(df: DataFrame, value: str, lo: float, hi: float, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows per equal-width bin; the last bin is closed."""
    return (
        df.withColumn("bin", uniform_bins(value, lo, hi, n))
        .dropna(subset=["bin"])
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def intensity_stats(df: DataFrame, value: str, saturation: float, by: Sequence[str] = ()) -> DataFrame:
    """Statistics of the non-zero pixels, with exact median and 95th percentile."""
    lit_pixels = df.filter(F.col(value) > 0)
    moments = lit_pixels.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        (100.0 * F.avg(F.when(F.col(value) >= saturation, 1.0).otherwise(0.0))).alias("saturated"),
    )
    cuts = exact_quantiles(lit_pixels, by, value, {"median": 0.5, "p95": 0.95})
    return attach(moments, cuts, by)


# ---------------------------------------------------------------- calibration


def poly_calibration_fit(
    df: DataFrame, e1: str, e2: str, targets: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Least-squares 21-term fit of each target: (by, target, coeffs).

    One pass sums the normal equations (inputs are shifted and scaled to unit
    range first, which keeps the 21x21 system well conditioned); the tiny solves run in
    the tasks that own the groups.  Coefficients refer to the scaled inputs given in
    columns c1, s1, c2, s2.
    """
    by = list(by)
    names = list(targets)
    ranges = df.groupBy(*by).agg(
        *[
            x
            for e, c, s in ((e1, "c1", "s1"), (e2, "c2", "s2"))
            for x in (
                ((F.min(e) + F.max(e)) / 2).alias(c),
                F.greatest((F.max(e) - F.min(e)) / 2, F.lit(1e-12)).alias(s),
            )
        ]
    )
    base = df.select(*by, e1, e2, *[t.cast("double").alias(f"_y_{n}") for n, t in targets.items()])
    scaled = attach(base.dropna(), ranges, by)
    x1 = (F.col(e1) - F.col("c1")) / F.col("s1")
    x2 = (F.col(e2) - F.col("c2")) / F.col("s2")
    scaled = scaled.withColumn("_a", x1).withColumn("_b", x2)

    # Products of two monomials are again monomials, so 66 power sums replace 231 products.
    def mono(i: int, j: int) -> Column:
        out = F.lit(1.0)
        for c, n in (("_a", i), ("_b", j)):
            for _ in range(n):
                out = out * F.col(c)
        return out

    powers = sorted({(a[0] + b[0], a[1] + b[1]) for a in POLY5_EXPONENTS for b in POLY5_EXPONENTS})
    aggs = [F.array(*[F.sum(mono(i, j)) for i, j in powers]).alias("_m")]
    for n in names:
        aggs.append(
            F.array(*[F.sum(mono(i, j) * F.col(f"_y_{n}")) for i, j in POLY5_EXPONENTS]).alias(f"_r_{n}")
        )
    sums = scaled.groupBy(*by, "c1", "s1", "c2", "s2").agg(*aggs)
    where = {p: k for k, p in enumerate(powers)}
    layout = np.array(
        [[where[(a[0] + b[0], a[1] + b[1])] for b in POLY5_EXPONENTS] for a in POLY5_EXPONENTS]
    )

    def solve(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            normal = np.stack(pdf["_m"].to_numpy())[:, layout]
            inverse = np.linalg.pinv(normal, rcond=1e-13, hermitian=True)
            frames = []
            for n in names:
                rhs = np.stack(pdf[f"_r_{n}"].to_numpy())
                part = pdf[[*by, "c1", "s1", "c2", "s2"]].copy()
                part["target"] = n
                part["coeffs"] = list(np.einsum("nij,nj->ni", inverse, rhs))
                frames.append(part)
            for part in frames:
                yield part

    fields = [f for f in sums.schema.fields if f.name in {*by, "c1", "s1", "c2", "s2"}]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return sums.mapInPandas(solve, f"{schema}, target string, coeffs array<double>")


def predict_poly(e1: str, e2: str) -> Column:
    """Value of a fitted polynomial; expects columns coeffs, c1, s1, c2, s2."""
    x1 = (F.col(e1) - F.col("c1")) / F.col("s1")
    x2 = (F.col(e2) - F.col("c2")) / F.col("s2")
    products = F.zip_with(poly5_features(x1, x2), "coeffs", lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def fit_errors(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """Spread of the relative (percent) and absolute residuals."""
    residual = F.col(predicted) - F.col(actual)
    return df.groupBy(*by).agg(
        F.stddev_samp(F.when(F.col(actual) != 0, 100.0 * residual / F.col(actual))).alias("rel_pct"),
        F.stddev_samp(residual).alias("absolute"),
    )


def gramian(df: DataFrame, vector: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Upper triangle of the sum of v vᵀ over rows: (by, _i, _j, _g).

    Each Arrow batch is reduced to its own width x width product before the
    shuffle, so the exchange carries matrices and not rows.
    """
    by = list(by)
    kept = df.select(*by, F.col(vector).alias("_v"))
    upper_i, upper_j = np.triu_indices(width)
    fields = [f for f in kept.schema.fields if f.name in by]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)

    def partial(batches):
        for pdf in batches:
            groups = pdf.groupby(by, sort=False) if by else [((), pdf)]
            for key, part in groups:
                m = np.stack(part["_v"].to_numpy()).astype(float)
                out = {"_i": upper_i, "_j": upper_j, "_g": (m.T @ m)[upper_i, upper_j]}
                frame = {c: [k] * len(upper_i) for c, k in zip(by, key)}
                yield type(pdf)({**frame, **out})

    parts = kept.mapInPandas(partial, f"{schema}_i int, _j int, _g double")
    return parts.groupBy(*by, "_i", "_j").agg(F.sum("_g").alias("_g"))


def singular_energy(
    df: DataFrame, vector: str, width: int, ranks: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Singular values of a tall table of row vectors and errors of its rank-k versions.

    One row per rank k: sigma_k, Frobenius and spectral error, energy captured.
    The eigenvalues come from one width x width matrix per group.
    """
    by = list(by)
    g = gramian(df, vector, width, by)
    packed = g.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_j", "_g"))).alias("_g"))
    packed = packed.withColumn("_g", F.transform("_g", lambda s: s["_g"]))
    fields = [f for f in packed.schema.fields if f.name in by]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    iu = np.triu_indices(width)

    def spectra(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                m = np.zeros((width, width))
                m[iu] = rec["_g"]
                m = m + np.triu(m, 1).T
                eig = np.clip(np.linalg.eigvalsh(m)[::-1], 0, None)
                total = eig.sum()
                for k in ranks:
                    rest = eig[k:]
                    rows.append(
                        {
                            **{c: rec[c] for c in by},
                            "k": k,
                            "sigma": math.sqrt(eig[k - 1]),
                            "frobenius": math.sqrt(rest.sum()),
                            "spectral": math.sqrt(rest[0]) if len(rest) else 0.0,
                            "energy": eig[:k].sum() / total if total > 0 else float("nan"),
                        }
                    )
            if rows:
                yield type(pdf)(rows)

    return packed.mapInPandas(
        spectra, f"{schema}k int, sigma double, frobenius double, spectral double, energy double"
    )


def simpson_trapezoid(df: DataFrame, by: Sequence[str], x: str, f: str, index: str) -> DataFrame:
    """Composite trapezoid and Simpson sums of f on an evenly spaced, 0-based table.

    The rules are weighted sums, so they need positions but no neighbours.
    Simpson needs an even number of intervals and is NULL otherwise.
    """
    extent = df.groupBy(*by).agg(
        F.max(index).alias("_n"), F.min(x).alias("_a"), F.max(x).alias("_b")
    )
    i, n = F.col(index), F.col("_n")
    end = (i == 0) | (i == n)
    trapezoid = F.when(end, 0.5).otherwise(1.0)
    simpson = F.when(end, 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    h = F.max((F.col("_b") - F.col("_a")) / n)
    return attach(df, extent, by).groupBy(*by).agg(
        (h * F.sum(trapezoid * F.col(f))).alias("trapezoid"),
        F.when(F.max(n) % 2 == 0, h / 3.0 * F.sum(simpson * F.col(f))).alias("simpson"),
    )


def extreme_with_error(
    df: DataFrame, by: Sequence[str], t: str, mean: str, sd: str, repeats: int
) -> DataFrame:
    """Largest and smallest mean with the standard error at its first occurrence."""
    hit = F.struct(F.col(mean).alias("value"), (F.col(sd) / math.sqrt(repeats)).alias("se"))
    high = F.max_by(hit, F.struct(F.col(mean), -F.col(t)))
    low = F.min_by(hit, F.struct(F.col(mean), F.col(t)))
    return df.groupBy(*by).agg(high.alias("_h"), low.alias("_l")).select(
        *by,
        F.col("_h.value").alias("highest"),
        F.col("_h.se").alias("highest_se"),
        F.col("_l.value").alias("lowest"),
        F.col("_l.se").alias("lowest_se"),
    )

"""Tower and wind-farm statistics (M operators)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import BLOCK, attach
from ..functions.scalars import (
    GRAVITY, VON_KARMAN, angle_diff, businger_dyer_psi, pressure_at, shear, speed, virtual_potential_temperature,
)
from .ftle import key_schema
from .joins import conditional_rows
from .sequence import fluctuation, moving_mean, vertical_gradient


def profile_by_height(df: DataFrame, by: Sequence[str], height: str) -> DataFrame:
    """Mean and spread of horizontal speed and temperature per level."""
    s = speed("u", "v")
    return df.groupBy(*by, height).agg(
        F.count(s).alias("n"), F.avg(s).alias("speed"), F.stddev_samp(s).alias("speed_std"),
        F.avg("temp").alias("temp"), F.stddev_samp("temp").alias("temp_std"),
    )


def level_fluctuations(
    df: DataFrame, by: Sequence[str], height: str, index: str, columns: Sequence[str], window: int | None, size: int = BLOCK
) -> DataFrame:
    """Columns <c>_p: deviation from a moving mean of ``window`` rows, or from the level's mean."""
    keys = [*by, height]
    if window is None:
        return fluctuation(df, keys, columns)
    smooth = moving_mean(df, keys, index, columns, window, "_mm_", size)
    return smooth.withColumns({f"{c}_p": F.col(c) - F.col(f"_mm_{c}") for c in columns}).drop(*[f"_mm_{c}" for c in columns])


def turbulence_by_height(
    df: DataFrame, by: Sequence[str], height: str, index: str, window: int | None = None, size: int = BLOCK
) -> DataFrame:
    """Energy, momentum and heat flux and buoyancy flux per level, mean and spread."""
    f = level_fluctuations(df, by, height, index, ["u", "v", "w", "temp"], window, size)
    u, v, w, t = (F.col(f"{c}_p") for c in ("u", "v", "w", "temp"))
    e = 0.5 * (u * u + v * v + w * w)
    buoyancy = GRAVITY / F.avg("temp")
    return f.groupBy(*by, height).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("temp").alias("temp"),
        F.avg(speed("u", "v")).alias("speed"),
        F.avg(e).alias("tke"),
        F.stddev_samp(e).alias("tke_std"),
        F.avg(u * w).alias("uw"),
        F.stddev_samp(u * w).alias("uw_std"),
        F.avg(v * w).alias("vw"),
        F.avg(w * t).alias("wt"),
        (F.avg(w * t) * buoyancy).alias("buoyancy"),
        (F.stddev_samp(w * t) * buoyancy).alias("buoyancy_std"),
        F.avg(w * w).alias("ww"),
    )


def buoyancy_flux(df: DataFrame, by: Sequence[str], height: str, base_pressure: str) -> DataFrame:
    """g/θ w'θ' with the virtual potential temperature of each level, mean and spread."""
    keys = [*by, height]
    means = df.groupBy(*keys).agg(F.avg("temp").alias("_t"), F.avg(base_pressure).alias("_p"))
    p = pressure_at(F.col("_p"), height, F.col("_t"))
    theta = attach(df, means, keys).withColumn("theta", virtual_potential_temperature("temp", p))
    f = fluctuation(theta, keys, ["theta", "w"])
    flux = F.col("w_p") * F.col("theta_p")
    scale = GRAVITY / F.avg("theta")
    return f.groupBy(*keys).agg(
        F.avg("theta").alias("theta"), (scale * F.avg(flux)).alias("flux"), (scale * F.stddev_samp(flux)).alias("flux_std")
    )


def shear_production(df: DataFrame, by: Sequence[str], height: str) -> DataFrame:
    """dU/dz times the covariance of horizontal speed and w, per level."""
    s = speed("u", "v")
    levels = df.groupBy(*by, height).agg(F.avg(s).alias("speed"), F.covar_pop(s, F.col("w")).alias("sw"))
    graded = vertical_gradient(levels, by, height, "speed", "dudz")
    return graded.withColumn("production", F.col("dudz") * F.col("sw"))


def friction_velocity(uw: Column, vw: Column) -> Column:
    return F.pow(uw * uw + vw * vw, 0.25)


def obukhov_length(friction: Column, temp: Column, wt: Column) -> Column:
    return F.when(wt != 0, -F.pow(friction, 3) * temp / (VON_KARMAN * GRAVITY * wt))


def cube_root(c: Column) -> Column:
    return F.signum(c) * F.pow(F.abs(c), 1.0 / 3.0)


def stability(levels: DataFrame, by: Sequence[str], height: str) -> DataFrame:
    """Friction velocity, Obukhov length and flux Richardson number from the lowest level."""
    low = levels.groupBy(*by).agg(F.min_by(F.struct("uw", "vw", "temp", "wt", "buoyancy", height), height).alias("_l"))
    l = F.col("_l")
    us = friction_velocity(l["uw"], l["vw"])
    length = obukhov_length(us, l["temp"], l["wt"])
    out = low.withColumns({"friction": us, "obukhov": length})
    rif = l["buoyancy"] / (l["uw"] * shear(l[height], "obukhov", "friction"))
    return out.withColumn("richardson", F.when(F.col("obukhov") < 0, rif)).drop("_l")


def convective_scale(levels: DataFrame, height: str) -> DataFrame:
    """Velocity scale (B z)^(1/3) per level and its ratio to the rms of w."""
    scale = cube_root(F.col("buoyancy") * F.col(height))
    return levels.withColumn("w_scale", scale).withColumn(
        "w_ratio", F.when(F.col("ww") > 0, F.col("w_scale") / F.sqrt("ww"))
    )


def roughness_fit(
    profile: DataFrame, stability_table: DataFrame, by: Sequence[str], height: str, rounds: int = 20, tuning: float = 4.685
) -> DataFrame:
    """Roughness length z0 per record from U = (u*/κ)(ln(z/z0) + ψ), bisquare-weighted.

    With u* and L known, every level gives its own ln z0 and the fit is a
    weighted mean.  The levels of a record are few (they are heights of one
    tower), so the reweighting runs on one short array per record, batch-wise.
    """
    rows = attach(profile, stability_table.select(*by, "friction", "obukhov"), by)
    psi = F.when(F.col("obukhov") < 0, businger_dyer_psi(height, "obukhov")).otherwise(0.0)
    own = F.log(F.col(height).cast("double")) + psi - VON_KARMAN * F.col("speed") / F.col("friction")
    packed = rows.withColumn("_z", own).dropna(subset=["_z"]).groupBy(*by).agg(
        F.sort_array(F.collect_list("_z")).alias("_z")
    )

    def fit(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            width = max((len(z) for z in pdf["_z"]), default=0)
            z = np.full((len(pdf), width), np.nan)
            for q, values in enumerate(pdf["_z"]):
                z[q, : len(values)] = values
            centre = np.nanmean(z, axis=1)
            for _ in range(rounds):
                gap = np.abs(z - centre[:, None])
                reach = tuning * np.maximum(np.nanmedian(gap, axis=1) / 0.6745, 1e-12)[:, None]
                weight = np.where(gap < reach, (1 - (gap / reach) ** 2) ** 2, 0.0)
                centre = np.nansum(weight * z, axis=1) / weight.sum(axis=1)
            out = pdf[list(by)].copy()
            out["z0"], out["levels"] = np.exp(centre), np.isfinite(z).sum(axis=1)
            yield out

    return packed.mapInPandas(fit, key_schema(packed, by) + "z0 double, levels bigint")


# ----------------------------------------------------------------- wind farm


def farm_power(scada: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total power (missing counts 0) and mean direction of all turbines per time step."""
    return scada.groupBy(*by, "ts").agg(
        F.coalesce(F.sum("power"), F.lit(0.0)).alias("total"),
        F.avg("wind_dir").alias("mean_dir"),
        F.count(F.lit(1)).alias("turbines"),
    )


def mean_direction(scada: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Arithmetic and circular mean direction per time step."""
    rad = F.radians("wind_dir")
    circular = F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad))))
    return scada.groupBy(*by, "ts").agg(
        F.avg("wind_dir").alias("mean_dir"), F.pmod(circular, F.lit(360.0)).alias("circular_dir")
    )


def power_by_direction(farm: DataFrame, by: Sequence[str] = (), width: float = 5.0) -> DataFrame:
    """Mean total power and count per sector; a direction on a border is in both sectors.

    A row lists the sector it falls in and, on a border, the neighbour, so no
    join with the sector list is needed.
    """
    n = round(360 / width)
    i = F.floor(F.col("mean_dir") / width)
    candidates = F.array(i - 1, i, i + 1)
    listed = farm.dropna(subset=["mean_dir"]).withColumn("_i", F.explode(F.transform(candidates, lambda c: F.pmod(c, F.lit(n)))))
    listed = listed.withColumn("centre", (F.col("_i") + 0.5) * width)
    inside = F.abs(angle_diff(F.col("centre"), F.col("mean_dir"))) <= width / 2
    return listed.filter(inside).groupBy(*by, "centre").agg(
        F.avg("total").alias("mean_power"), F.count(F.lit(1)).alias("n")
    )


def worst_direction(sectors: DataFrame, by: Sequence[str] = (), min_n: int = 5) -> DataFrame:
    """Sector with the least mean power among those with enough samples."""
    return sectors.filter(F.col("n") >= min_n).groupBy(*by).agg(
        F.min_by(F.struct("centre", "mean_power", "n"), F.struct("mean_power", "centre")).alias("_s")
    ).select(*by, "_s.*")


def wake_row(
    scada: DataFrame, centre: float, half: float, row: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Power of a row of turbines relative to its first one, mean and spread per position."""
    farm = farm_power(scada, by).select(*by, "ts", "mean_dir")
    rows = conditional_rows(scada.join(farm, [*by, "ts"]), "wind_dir", centre, half, row)
    keys = [*by, "ts", "flipped"]
    lead = rows.filter(F.col("position") == 1).groupBy(*keys).agg(F.max("power").alias("_first"))
    ratio = F.when(F.col("_first") != 0, F.col("power") / F.col("_first"))
    return rows.join(lead, keys).groupBy(*by, "position").agg(
        F.count(ratio).alias("n"), F.avg(ratio).alias("mean"), F.stddev_samp(ratio).alias("std")
    )


def yaw_misalignment(scada: DataFrame) -> DataFrame:
    """Signed angle from yaw to wind direction."""
    return scada.withColumn("misalignment", angle_diff("yaw", "wind_dir"))


def mean_misalignment(scada: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return yaw_misalignment(scada).groupBy(*by).agg(
        F.avg(F.abs(F.col("misalignment"))).alias("mean_abs"), F.count("misalignment").alias("n")
    )

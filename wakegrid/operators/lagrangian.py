"""Statistics along trajectories (L operators)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import BLOCK
from .joins import interp_pchip, track_start_band
from .sequence import central_gradient, first_contiguous_segment

#: Up to this lag products are formed by shifting; beyond it by FFT per block.
SHIFT_LIMIT = 96


def velocity_fluctuation(
    tracks: DataFrame, profile: DataFrame, by: Sequence[str], track: str, index: str, dt: float,
    positions: Sequence[str] = ("x", "y", "z"), min_length: int = 10, size: int = BLOCK,
    velocities: Sequence[str] | None = None,
) -> DataFrame:
    """Velocity along the first contiguous run minus the local mean profile.

    ``profile`` tabulates u, v, w over y (and ``by``).  Adds u_p, v_p, w_p.  The
    velocity is the positions' gradient, or the tracked ``velocities`` if given.
    """
    keys = [*by, track]
    runs = first_contiguous_segment(tracks.dropna(subset=list(positions)), keys, index, min_length, size)
    if velocities is None:
        moving = central_gradient(runs, keys, index, positions, dt, "_g_", size)
    else:
        moving = runs.withColumns({f"_g_{p}": F.col(v) for p, v in zip(positions, velocities)})
    local = interp_pchip(moving, "y", profile, "y", ["u", "v", "w"], by, suffix="_mean")
    out = {f"{c}_p": F.col(f"_g_{p}") - F.col(f"{c}_mean") for c, p in zip("uvw", positions)}
    return local.withColumns(out).drop(*[f"_g_{p}" for p in positions], "u_mean", "v_mean", "w_mean")


def lag_sums(
    df: DataFrame, by: Sequence[str], track: Sequence[str], index: str, values: Sequence[str],
    max_lag: int, size: int = BLOCK, method: str = "auto", ahead: Sequence[str] | None = None,
) -> DataFrame:
    """Sum over pairs of v(i)*v(i+lag) pooled over tracks: (by, lag, n, s_<v>...).

    ``ahead`` names another column for the later factor of each value.

    Rows are partitioned by (track, block of frames), each block also holding the
    next ``max_lag`` frames, and sorted.  A task walks its rows in Arrow batches
    with all tracks of a batch at once and keeps only ``max_lag`` rows (or one
    block) between batches, so neither a track nor a partition has to fit in
    memory.  For long lags whole blocks are correlated by FFT.
    """
    by, track = list(by), list(track)
    ahead = list(ahead or values)
    size = max(size, max_lag + 1)
    i = F.col(index)
    keys = [*by, *track]
    needed = list(dict.fromkeys([*values, *ahead]))
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    key_schema = "".join(f"`{c}` {fields[c]}, " for c in by)
    schema = f"{key_schema}lag int, n bigint, " + ", ".join(f"s_{v} double" for v in values)
    first = F.greatest(F.floor((i - max_lag) / size), F.lit(0))
    rows = (
        df.dropna(subset=needed)
        .select(*keys, i, *needed, F.explode(F.sequence(first, F.floor(i / size))).alias("_block"))
        .withColumn("_own", F.floor(i / size) == F.col("_block"))
    )
    segment = [*keys, "_block"]
    if method == "auto":
        method = "shift" if max_lag <= SHIFT_LIMIT else "fft"

    def emit(pdf_type, group, lags, n, sums):
        out = {c: [g] * len(lags) for c, g in zip(by, group)}
        out |= {"lag": lags, "n": n}
        out |= {f"s_{v}": sums[:, k] for k, v in enumerate(values)}
        return pdf_type(out)

    def by_shift(batches):
        pending = None
        for pdf in batches:
            if pending is not None:
                pdf = type(pdf)({c: np.concatenate([pending[c].to_numpy(), pdf[c].to_numpy()]) for c in pdf})
            keep = min(max_lag, len(pdf))
            yield from shifted(pdf, len(pdf) - keep)
            pending = pdf.iloc[len(pdf) - keep :]
        if pending is not None:
            yield from shifted(pending, len(pending))

    def shifted(pdf, bases):
        if bases <= 0:
            return
        own = pdf["_own"].to_numpy(bool)[:bases]
        change = np.zeros(len(pdf), bool)
        for c in segment:
            v = pdf[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        seq, pos = np.cumsum(change), pdf[index].to_numpy()
        base, later = pdf[list(values)].to_numpy(float), pdf[ahead].to_numpy(float)
        if by:
            code = pdf.iloc[:bases].groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            heads = pdf.iloc[:bases].drop_duplicates(by)[by].itertuples(index=False, name=None)
            heads = list(heads)
        else:
            code, heads = np.zeros(bases, int), [()]
        lags = np.arange(max_lag + 1)
        where = seq * (1 << 42) + pos
        dense = bool(((np.diff(pos) == 1) | (np.diff(seq) > 0)).all())
        n = np.zeros((len(heads), max_lag + 1), np.int64)
        total = np.zeros((len(heads), max_lag + 1, len(values)))
        for lag in lags:
            if dense:  # the partner is lag rows further on
                m = max(min(bases, len(pdf) - lag), 0)
                at = np.flatnonzero(own[:m] & (seq[:m] == seq[lag : lag + m]))
                to = at + lag
            else:
                spot = np.minimum(np.searchsorted(where, where[:bases] + lag), len(pdf) - 1)
                at = np.flatnonzero(own & (where[spot] == where[:bases] + lag))
                to = spot[at]
            n[:, lag] = np.bincount(code[at], minlength=len(heads))
            for k in range(len(values)):
                total[:, lag, k] = np.bincount(
                    code[at], weights=base[at, k] * later[to, k], minlength=len(heads)
                )
        for g, head in enumerate(heads):
            yield emit(type(pdf), head, lags, n[g], total[g])

    def by_fft(batches):
        pending = None
        for pdf in batches:
            if pending is not None:
                pdf = type(pdf)({c: np.concatenate([pending[c].to_numpy(), pdf[c].to_numpy()]) for c in pdf})
            starts = segment_starts(pdf)
            yield from transformed(pdf, starts, len(starts) - 1)  # the last block may go on
            pending = pdf.iloc[starts[-1] :]
        if pending is not None and len(pending):
            yield from transformed(pending, np.array([0]), 1)

    def segment_starts(pdf):
        change = np.zeros(len(pdf), bool)
        change[0] = True
        for c in segment:
            v = pdf[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def transformed(pdf, starts, count):
        """Correlate whole blocks; those of one width and group share one inverse transform."""
        if not count:
            return
        stops = np.r_[starts, len(pdf)][1 : count + 1]
        starts = starts[:count]
        pos, own = pdf[index].to_numpy(), pdf["_own"].to_numpy(bool)
        cols = {c: pdf[c].to_numpy(float) for c in needed}
        cols[None] = np.ones(len(pdf))
        factors = [(None, None), *zip(ahead, values)]
        width = 1 << np.array([int(pos[b - 1] - pos[a] + 1 + max_lag).bit_length() for a, b in zip(starts, stops)])
        heads = list(pdf.iloc[starts][by].itertuples(index=False, name=None)) if by else [()] * count
        total = {}
        for a, b, w, head in zip(starts, stops, width.tolist(), heads):
            at, mine = pos[a:b] - pos[a], own[a:b]
            sums = total.setdefault((head, w), np.zeros((len(factors), w // 2 + 1), complex))
            for q, (later, base) in enumerate(factors):
                x, y = np.zeros(w), np.zeros(w)
                x[at], y[at[mine]] = cols[later][a:b], cols[base][a:b][mine]
                sums[q] += np.fft.rfft(x) * np.conj(np.fft.rfft(y))
        lags = np.arange(max_lag + 1)
        for (head, w), sums in total.items():
            curves = np.fft.irfft(sums, w, axis=1)[:, : max_lag + 1]
            n = np.rint(curves[0]).astype(np.int64)
            yield emit(type(pdf), head, lags, n, np.where(n > 0, curves[1:], 0.0).T)

    work = {"shift": by_shift, "fft": by_fft}.get(method)
    if work is None:
        raise ValueError("method is auto, shift or fft")
    ordered = rows.repartition(*segment).sortWithinPartitions(*segment, index)
    parts = ordered.mapInPandas(work, schema)
    return (
        parts.groupBy(*by, "lag")
        .agg(F.sum("n").alias("n"), *[F.sum(f"s_{v}").alias(f"s_{v}") for v in values])
        .filter(F.col("n") > 0)
    )


def correlations(sums: DataFrame, by: Sequence[str], values: Sequence[str], dt: float) -> DataFrame:
    """Raw (per pair) and normalised autocorrelation of every lag: tau, raw_<v>, r_<v>.

    A curve has one row per lag, so windows over it are bounded by the largest lag.
    """
    w = Window.partitionBy(*by).orderBy("lag")
    raw = sums.withColumns({f"raw_{v}": F.col(f"s_{v}") / F.col("n") for v in values})
    out = {"tau": F.col("lag") * dt}
    for v in values:
        zero = F.first(f"raw_{v}").over(w)
        out[f"r_{v}"] = F.when(zero != 0, F.col(f"raw_{v}") / zero)
    return raw.withColumns(out).drop(*[f"s_{v}" for v in values])


def lagrangian_autocorr(
    df: DataFrame, by: Sequence[str], track: str, index: str, values: Sequence[str],
    max_lag: int, dt: float, size: int = BLOCK, method: str = "auto",
) -> DataFrame:
    sums = lag_sums(df, by, [track], index, values, max_lag, size, method)
    return correlations(sums, by, values, dt)


def banded_autocorr(
    df: DataFrame, by: Sequence[str], track: str, index: str, values: Sequence[str],
    centres: Sequence[float], half: float, max_lag: int, dt: float, start: str = "y", size: int = BLOCK,
) -> DataFrame:
    """Autocorrelation per initial band (1..) and over all tracks (band 0).

    All tracks are the sum of the bands and the unbanded rest, so no row is copied.
    """
    banded = track_start_band(df, [*by, track], index, start, centres, half)
    banded = banded.withColumn("band", F.coalesce("band", F.lit(-1)))
    sums = lag_sums(banded, [*by, "band"], [track], index, values, max_lag, size)
    every = sums.groupBy(*by, "lag").agg(
        F.sum("n").alias("n"), *[F.sum(f"s_{v}").alias(f"s_{v}") for v in values]
    )
    both = sums.filter(F.col("band") > 0).unionByName(every.withColumn("band", F.lit(0)))
    return correlations(both, [*by, "band"], values, dt)


def _panels(by: Sequence[str], r: str, threshold: float, inclusive: bool):
    """Trapezoid panel ending at a lag, NULL beyond the first lag below the threshold."""
    ordered = Window.partitionBy(*by).orderBy("lag")
    whole = Window.partitionBy(*by)
    low = F.col(r) <= threshold if inclusive else F.col(r) < threshold
    stop = F.coalesce(F.min(F.when(low, F.col("lag"))).over(whole), F.max("lag").over(whole))
    area = (F.col("tau") - F.lag("tau").over(ordered)) * (F.col(r) + F.lag(r).over(ordered)) / 2
    return F.when(F.col("lag") <= stop, area)


def integral_timescale(
    curve: DataFrame, by: Sequence[str], scales: Mapping[str, str],
    threshold: float = math.exp(-1), inclusive: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """Trapezoid of lag curves up to the first lag below the threshold, else all of them.

    ``scales`` maps a result name to a curve column; ``keep`` names columns whose
    lag-0 value is wanted beside the scales.
    """
    panels = curve.withColumns({f"_a_{n}": _panels(by, r, threshold, inclusive) for n, r in scales.items()})
    return panels.groupBy(*by).agg(
        *[F.coalesce(F.sum(f"_a_{n}"), F.lit(0.0)).alias(n) for n in scales],
        *[F.max(F.when(F.col("lag") == 0, F.col(c))).alias(c) for c in keep],
    )


def eddy_diffusivity(curve: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Time scale tl_<v> and diffusivity d_<v> = raw(0) * time scale."""
    zero = [f"raw_{v}" for v in values]
    out = integral_timescale(curve, by, {f"tl_{v}": f"r_{v}" for v in values}, keep=zero)
    return out.withColumns({f"d_{v}": F.col(f"raw_{v}") * F.col(f"tl_{v}") for v in values}).drop(*zero)


def exp_model(curve: DataFrame, by: Sequence[str], r: str) -> DataFrame:
    """exp(-tau/T) below two time scales, beside the curve and its log magnitude."""
    whole = Window.partitionBy(*by)
    rows = curve.withColumn("_a", _panels(by, r, math.exp(-1), False))
    rows = rows.withColumn("_tl", F.coalesce(F.sum("_a").over(whole), F.lit(0.0)))
    model = F.when(F.col("tau") < 2 * F.col("_tl"), F.exp(-F.col("tau") / F.col("_tl")))
    magnitude = F.when(F.col(r) != 0, F.log(F.abs(F.col(r))))
    return rows.withColumns({"model": model, "log_r": magnitude}).drop("_tl", "_a")


def survival_curve(
    tracks: DataFrame, by: Sequence[str], track: str, index: str, i0: int, steps: Sequence[int]
) -> DataFrame:
    """Tracks present at both i0 and i0+m, for every m: (by, m, n)."""
    ahead = [int(s) for s in steps]
    there = tracks.filter(F.col(index).isin(ahead_frames(i0, ahead)))
    alive = there.filter(F.col(index) == i0).select(*by, track)
    seen = there.join(alive, [*by, track], "left_semi")
    return (
        seen.select(*by, (F.col(index) - i0).alias("m"))
        .filter(F.col("m").isin(ahead))
        .groupBy(*by, "m")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ahead_frames(i0: int, steps: Sequence[int]) -> list[int]:
    return sorted({i0, *[i0 + int(s) for s in steps]})


def longest_tracks(tracks: DataFrame, by: Sequence[str], track: str, n: int) -> DataFrame:
    """Rows of the n longest tracks (of each ``by`` group); ties go to the lower id."""
    lengths = tracks.groupBy(*by, track).agg(F.count(F.lit(1)).alias("_len"))
    order = [F.desc("_len"), F.asc(track)]
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        top = lengths.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    else:
        top = lengths.orderBy(*order).limit(n)
    return tracks.join(top.select(*by, track), [*by, track], "left_semi")


def track_summary(tracks: DataFrame, by: Sequence[str], track: str) -> DataFrame:
    """Samples, tracks, longest and mean track length."""
    lengths = tracks.groupBy(*by, track).agg(F.count(F.lit(1)).alias("_len"))
    return lengths.groupBy(*by).agg(
        F.sum("_len").alias("samples"),
        F.count(F.lit(1)).alias("tracks"),
        F.max("_len").alias("longest"),
        F.avg("_len").alias("mean_length"),
    )

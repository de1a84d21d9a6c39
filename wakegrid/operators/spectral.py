"""Fourier operators on gridded fields and long signals (G operators).

A transform needs a whole line of nodes or a whole segment, whose length is a
parameter.  Lines are packed into arrays by Spark and transformed batch-wise; a
line of more than ``LINE`` nodes is folded into a matrix, whose columns and rows are
transformed as short lines of their own, so no task holds the line.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import attach
from ..session import cut
from .binning import STRESSES, Axis, nearest_slice
from .ftle import key_schema
from .sequence import detrend_linear

INDEX = ("i", "j", "k")
#: Nodes of a line that is transformed in one piece.
LINE = 1 << 16


def _field(name: str) -> Callable[[Column], Column]:
    return lambda s: s[name].cast("double")


def transform_lines(
    df: DataFrame, keys: Sequence[str], axis: str, n: int, inputs: Sequence[str], outputs: Sequence[str],
    work: Callable[[np.ndarray], np.ndarray], m: int | None = None, out_axis: str | None = None,
) -> DataFrame:
    """Apply ``work`` to complete lines of ``n`` nodes numbered 0..n-1 along ``axis``.

    ``work`` maps (lines, inputs, n) to (lines, outputs, m).  A line with missing
    or surplus nodes raises.
    """
    keys, m, out_axis = list(keys), m or n, out_axis or axis
    lines = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(axis).alias("_a"), *inputs))).alias("_l")
    )
    complete = (F.size("_l") == n) & (F.element_at("_l", 1)["_a"] == 0) & (F.element_at("_l", -1)["_a"] == n - 1)
    checked = F.when(complete, F.col("_l")).otherwise(
        F.raise_error(F.lit(f"a line along {axis} does not hold {n} nodes"))
    )
    packed = lines.withColumn("_l", checked).select(
        *keys, *[F.transform("_l", _field(c)).alias(c) for c in inputs]
    )

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            data = np.stack([np.stack(pdf[c].to_numpy()) for c in inputs], axis=1).astype(float)
            result = work(data)
            out = pdf[keys].copy()
            for q, name in enumerate(outputs):
                out[name] = list(result[:, q])
            yield out

    schema = key_schema(packed, keys) + ", ".join(f"`{c}` array<double>" for c in outputs)
    done = packed.mapInPandas(run, schema)
    rows = done.select(*keys, F.posexplode(F.arrays_zip(*outputs)).alias(out_axis, "_v"))
    return rows.select(
        *keys, F.col(out_axis).cast("bigint").alias(out_axis), *[F.col("_v")[c].alias(c) for c in outputs]
    )


def pencil_fft(
    df: DataFrame, keys: Sequence[str], axis: str, n: int, values: Sequence[str], inverse: bool = False, line: int | None = None
) -> DataFrame:
    """Complex transform along one axis of columns <v>_re, <v>_im.

    Lines of more than ``line`` nodes are transformed in pieces (``_folded_fft``).
    """
    columns = [f"{v}_{p}" for v in values for p in ("re", "im")]
    if n > (line or LINE):
        return _folded_fft(df.select(*keys, F.col(axis).cast("bigint").alias(axis), *columns), list(keys), axis, n, list(values), inverse, line or LINE)
    fft = np.fft.ifft if inverse else np.fft.fft

    def work(data):
        z = fft(data[:, 0::2] + 1j * data[:, 1::2], axis=2)
        out = np.empty_like(data)
        out[:, 0::2], out[:, 1::2] = z.real, z.imag
        return out

    return transform_lines(df, keys, axis, n, columns, columns, work)


def _turned(df: DataFrame, values: Sequence[str], angle: Column, scale: float | Column = 1.0) -> DataFrame:
    """Values times scale * exp(i * angle)."""
    c, s = F.cos(angle) * scale, F.sin(angle) * scale
    out = {}
    for v in values:
        re, im = F.col(f"{v}_re"), F.col(f"{v}_im")
        out |= {f"{v}_re": re * c - im * s, f"{v}_im": re * s + im * c}
    return df.withColumns(out)


def _folded_fft(df: DataFrame, keys: list[str], axis: str, n: int, values: list[str], inverse: bool, line: int) -> DataFrame:
    """Transform of a long line in pieces of bounded length.

    With n = p * q a line is a matrix of p rows and q columns.  Its columns are
    transformed, every node is turned by its share of a revolution, and its rows are
    transformed; the result is read column by column.  Each step regroups the nodes
    into lines of p or q nodes, which may be folded again.  A length with a prime
    factor above ``line`` is transformed as a convolution of a power of two.
    """
    p = max(d for d in range(1, math.isqrt(n) + 1) if n % d == 0)
    q = n // p
    if p == 1 or q > line and max(d for d in range(1, math.isqrt(q) + 1) if q % d == 0) == 1:
        return _chirp_fft(df, keys, axis, n, values, inverse, line)
    i, sign = F.col(axis), 1.0 if inverse else -1.0
    down = df.withColumns({"_b": i % q, "_a": F.floor(i / q).cast("bigint")}).drop(axis)
    down = pencil_fft(down, [*keys, "_b"], "_a", p, values, inverse, line)
    share = (F.col("_a") * F.col("_b")) % n  # whole turns are taken off before the angle is made
    down = _turned(down, values, sign * 2 * math.pi / n * share)
    across = pencil_fft(down, [*keys, "_a"], "_b", q, values, inverse, line)
    return across.withColumn(axis, F.col("_a") + p * F.col("_b")).drop("_a", "_b")


def _chirp_fft(df: DataFrame, keys: list[str], axis: str, n: int, values: list[str], inverse: bool, line: int) -> DataFrame:
    """Transform of a line of any length as a circular convolution with a chirp, whose length is a power of two."""
    m = 1 << (2 * n - 2).bit_length()
    i, sign = F.col(axis), 1.0 if inverse else -1.0

    def quarter(j: Column) -> Column:
        """j*j half turns by n, whole turns taken off; exact for n below 2**31."""
        return sign * math.pi / n * ((j * j) % (2 * n))

    nodes = df.sparkSession.range(m).select(F.col("id").alias(axis))
    off = F.least(i, m - i)
    chirp = nodes.select(axis, F.when(off < n, F.cos(quarter(off))).otherwise(0.0).alias("_w_re"), F.when(off < n, -F.sin(quarter(off))).otherwise(0.0).alias("_w_im"))
    chirp = cut(pencil_fft(chirp, [], axis, m, ["_w"], False, line))
    turned = _turned(df, values, quarter(i))
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).drop("id")
    rest = groups.withColumn(axis, F.explode(F.sequence(F.lit(n).cast("bigint"), F.lit(m - 1).cast("bigint"))))
    rest = rest.withColumns({f"{v}_{c}": F.lit(0.0) for v in values for c in ("re", "im")})
    hat = pencil_fft(turned.unionByName(rest), keys, axis, m, values, False, line).join(chirp, axis)
    product = {}
    for v in values:
        re, im = F.col(f"{v}_re"), F.col(f"{v}_im")
        product |= {f"{v}_re": re * F.col("_w_re") - im * F.col("_w_im"), f"{v}_im": re * F.col("_w_im") + im * F.col("_w_re")}
    back = pencil_fft(hat.withColumns(product).drop("_w_re", "_w_im"), keys, axis, m, values, True, line).where(i < n)
    return _turned(back, values, quarter(i), 1.0 / n if inverse else 1.0)


def grid_fft(
    df: DataFrame, by: Sequence[str], shape: Mapping[str, int], values: Sequence[str], inverse: bool = False
) -> DataFrame:
    """Transform along every axis in turn; each turn regroups the nodes into lines."""
    out = df
    for axis, n in shape.items():
        others = [a for a in shape if a != axis]
        out = pencil_fft(out, [*by, *others], axis, n, values, inverse)
    return out


def wavenumber(index: str, n: int, length: float, zero_nyquist: bool = False) -> Column:
    """2π/L times 0..n/2, -n/2+1..-1."""
    if n % 2:
        raise ValueError("the transform needs an even number of nodes")
    i = F.col(index)
    k = F.when(i <= n // 2, i).otherwise(i - n)
    if zero_nyquist:
        k = F.when(i == n // 2, 0).otherwise(k)
    return k * (2 * math.pi / length)


def as_complex(df: DataFrame, values: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {f"{v}_re": F.col(v).cast("double") for v in values} | {f"{v}_im": F.lit(0.0) for v in values}
    ).drop(*values)


# ------------------------------------------------------------------- pressure


def densify(bins: DataFrame, by: Sequence[str], axes: Sequence[Axis], values: Sequence[str]) -> DataFrame:
    """Every bin of the grid with 0-based numbers i, j, k; empty bins hold 0."""
    base = bins.select(*by).distinct() if by else bins.sparkSession.range(1).drop("id")
    for a, n in zip(axes, INDEX):
        base = base.withColumn(n, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(a.n - 1).cast("bigint"))))
    have = bins.select(
        *by, *[(F.col(a.name) - 1).cast("bigint").alias(n) for a, n in zip(axes, INDEX)], *values
    )
    return base.join(have, [*by, *INDEX], "left").na.fill(0.0, list(values))


def second_moment_tensor(bins: DataFrame, by: Sequence[str], axes: Sequence[Axis]) -> DataFrame:
    """T_ij = mean_i mean_j + stress_ij on the full grid; empty bins are 0."""
    t = bins.withColumns({f"t{s}": F.col(s[0]) * F.col(s[1]) + F.col(s) for s in STRESSES})
    return densify(t, by, axes, [f"t{s}" for s in STRESSES])


def _waves(axes: Sequence[Axis]) -> list[Column]:
    return [wavenumber(n, a.n, a.hi - a.lo) for a, n in zip(axes, INDEX)]


def source_spectrum(tensor: DataFrame, by: Sequence[str], axes: Sequence[Axis]) -> DataFrame:
    """Transformed source s and pressure p of the Poisson equation; the mean mode of p is 0."""
    names = [f"t{s}" for s in STRESSES]
    shape = {n: a.n for a, n in zip(axes, INDEX)}
    hat = grid_fft(as_complex(tensor, names), by, shape, names)
    k = dict(zip("uvw", _waves(axes)))
    k2 = sum((c * c for c in k.values()), F.lit(0.0))
    out = {}
    for part in ("re", "im"):
        s = sum(
            ((1.0 if q[0] == q[1] else 2.0) * k[q[0]] * k[q[1]] * F.col(f"t{q}_{part}") for q in STRESSES),
            F.lit(0.0),
        )
        out[f"s_{part}"] = s
        out[f"p_{part}"] = F.when(k2 < 1e-16, 0.0).otherwise(-s / k2)
    return hat.select(*by, *INDEX, *[c.alias(n) for n, c in out.items()])


def pressure_poisson(tensor: DataFrame, by: Sequence[str], axes: Sequence[Axis]) -> DataFrame:
    """Mean pressure (and source) on the grid of the second-moment tensor, periodic in all axes."""
    hat = source_spectrum(tensor, by, axes)
    shape = {n: a.n for a, n in zip(axes, INDEX)}
    field = grid_fft(hat, by, shape, ["s", "p"], inverse=True)
    return field.select(*by, *INDEX, F.col("p_re").alias("p"), F.col("s_re").alias("source"))


def axis_spectrum(hat: DataFrame, by: Sequence[str], axis: str, n: int, length: float) -> DataFrame:
    """Power of s and p per wavenumber of one axis, relative to the largest, and their ratio.

    The table has n rows per group, so the window maximum is over a bounded set.
    """
    sums = hat.groupBy(*by, axis).agg(
        *[F.sum(F.col(f"{v}_re") * F.col(f"{v}_re") + F.col(f"{v}_im") * F.col(f"{v}_im")).alias(f"{v}_power") for v in "sp"]
    )
    w = Window.partitionBy(*by)
    return sums.withColumns(
        {"wave": F.abs(wavenumber(axis, n, length)), "amplification": F.col("p_power") / (F.col("s_power") + 1e-30)}
        | {f"{v}_rel": F.col(f"{v}_power") / F.max(f"{v}_power").over(w) for v in "sp"}
    )


def plane_profiles(field: DataFrame, by: Sequence[str], axis: int = 1) -> DataFrame:
    """Plane averages of pressure and source along one axis."""
    return field.groupBy(*by, INDEX[axis]).agg(F.avg("p").alias("p"), F.avg("source").alias("source"))


def solver_diagnostics(field: DataFrame, by: Sequence[str], axes: Sequence[Axis], axis: int = 1) -> DataFrame:
    """Condition number and largest amplification of one axis, RMS of the source and pressure profiles."""
    a = axes[axis]
    profile = plane_profiles(field, by, axis)
    base = 2 * math.pi / (a.hi - a.lo)
    rms = {v: F.sqrt(F.avg(F.col(v) * F.col(v))) for v in ("source", "p")}
    return profile.groupBy(*by).agg(
        F.lit((a.n // 2) ** 2 * 1.0).alias("condition"),
        F.lit(1 / base**2).alias("max_amplification"),
        rms["source"].alias("source_rms"),
        rms["p"].alias("pressure_rms"),
        (rms["p"] / rms["source"]).alias("ratio"),
    )


def rel_errors(df: DataFrame, by: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """L2 and largest relative error of each value column against its reference column."""
    aggs = []
    for v, ref in values.items():
        d, r = F.col(v) - F.col(ref), F.col(ref)
        aggs += [
            F.sqrt(F.sum(d * d) / F.sum(r * r)).alias(f"l2_{v}"),
            (F.max(F.abs(d)) / F.max(F.abs(r))).alias(f"linf_{v}"),
        ]
    return df.groupBy(*by).agg(*aggs)


def reference_to_centre(
    profile: DataFrame, by: Sequence[str], axis: Axis, value: str, known: float = 0.0
) -> DataFrame:
    """Shift a profile so that the bin nearest the centre has the known value."""
    middle = nearest_slice(profile, axis, by, (axis.lo + axis.hi) / 2)
    shift = middle.groupBy(*by).agg(F.avg(value).alias("_c"))
    return attach(profile, shift, by).withColumn(value, F.col(value) - F.col("_c") + known).drop("_c")


# -------------------------------------------------------------------- signals


def welch_psd(
    df: DataFrame, by: Sequence[str], index: str, value: str, nseg: int, overlap: int, fs: float,
    detrend: bool = True,
) -> DataFrame:
    """One-sided power spectral density: Hamming windows, full segments only, tail dropped.

    Every sample lists the segments it belongs to; segments are packed and
    transformed batch-wise, and each batch sends one partial sum per frequency.
    Needs a dense 0-based index.
    """
    if not 0 <= overlap < nseg:
        raise ValueError("overlap must be smaller than the segment")
    by = list(by)
    step = nseg - overlap
    rows = df.select(*by, index, F.col(value).alias("_v"))
    if detrend:
        rows = detrend_linear(rows, by, index, ["_v"], "").select(*by, index, "_v")
    counts = rows.groupBy(*by).agg(F.floor((F.max(index) + 1 - overlap) / step).alias("_segments"))
    n = F.col(index)
    first = F.greatest(F.ceil((n - (nseg - 1)) / step), F.lit(0))
    last = F.least(F.floor(n / step), F.col("_segments") - 1)
    placed = (
        attach(rows, counts, by)
        .filter(first <= last)
        .withColumn("_seg", F.explode(F.sequence(first, last)))
    )
    packed = placed.groupBy(*by, "_seg").agg(
        F.sort_array(F.collect_list(F.struct(F.col(index).alias("n"), "_v"))).alias("_l")
    )
    packed = packed.filter(F.size("_l") == nseg).select(*by, F.transform("_l", lambda s: s["_v"]).alias("_l"))
    taper = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(nseg) / (nseg - 1))
    half = nseg // 2 + 1
    fold = np.full(half, 2.0)
    fold[0] = 1.0
    if nseg % 2 == 0:
        fold[-1] = 1.0
    scale = fold / (fs * (taper**2).sum())

    def spectra(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            power = np.abs(np.fft.rfft(np.stack(pdf["_l"].to_numpy()) * taper, axis=1)) ** 2 * scale
            groups = pdf.groupby(by, sort=False, dropna=False).indices.items() if by else [((), slice(None))]
            for key, at in groups:
                part = power[at]
                key = key if isinstance(key, tuple) else (key,)
                frame = {c: [v] * half for c, v in zip(by, key)}
                yield pd.DataFrame({**frame, "bin": np.arange(half), "_s": part.sum(0), "_c": len(part)})

    parts = packed.mapInPandas(spectra, key_schema(packed, by) + "bin int, _s double, _c bigint")
    return parts.groupBy(*by, "bin").agg(
        (F.sum("_s") / F.sum("_c")).alias("psd"), F.sum("_c").alias("segments")
    ).withColumn("freq", F.col("bin") * (fs / nseg))


def wavenumber_spectrum(
    psd: DataFrame, velocity: Column, dissipation: Column, viscosity: float, length: float
) -> DataFrame:
    """Spectrum over wavenumber by the frozen-flow rule, with inner- and outer-scaled copies."""
    eta = F.pow(viscosity**3 / dissipation, 0.25)
    wave, energy = 2 * math.pi * F.col("freq") / velocity, velocity * F.col("psd")
    return psd.withColumns(
        {
            "wave": wave,
            "energy": energy,
            "wave_inner": wave * eta,
            "energy_inner": energy / F.pow(dissipation * viscosity**5, 0.25),
            "wave_outer": wave * length,
            "energy_outer": energy / (velocity * length),
        }
    )


def spectral_derivative(
    df: DataFrame, by: Sequence[str], index: str, value: str, n: int, length: float
) -> DataFrame:
    """Derivative of a periodic series of n nodes by FFT (Nyquist mode 0) and by central differences."""
    if n % 2:
        raise ValueError("the transform needs an even number of nodes")
    if n > LINE:
        return _long_derivative(df, list(by), index, value, n, length)
    modes = np.fft.fftfreq(n, 1 / n) * (2 * np.pi / length)
    modes[n // 2] = 0.0

    def work(data):
        f = data[:, 0]
        exact = np.fft.ifft(1j * modes * np.fft.fft(f, axis=1), axis=1).real
        central = (np.roll(f, -1, 1) - np.roll(f, 1, 1)) / (2 * length / n)
        return np.stack([f, exact, central], axis=1)

    return transform_lines(df, by, index, n, [value], [value, "d_fft", "d_central"], work)


def _long_derivative(df: DataFrame, by: list[str], index: str, value: str, n: int, length: float) -> DataFrame:
    """``spectral_derivative`` of lines that are transformed in pieces; neighbours meet by their places."""
    rows = df.select(*by, F.col(index).cast("bigint").alias(index), F.col(value).cast("double").alias(value))
    hat = pencil_fft(as_complex(rows, [value]), by, index, n, [value])
    k = wavenumber(index, n, length, zero_nyquist=True)
    hat = hat.select(*by, index, (-k * F.col(f"{value}_im")).alias("_d_re"), (k * F.col(f"{value}_re")).alias("_d_im"))
    exact = pencil_fft(hat, by, index, n, ["_d"], True).select(*by, index, F.col("_d_re").alias("d_fft"))
    steps = F.array(*[F.lit(o) for o in (-1, 0, 1)])
    sent = rows.withColumn("_o", F.explode(steps)).withColumn(index, F.pmod(F.col(index) + F.col("_o"), F.lit(n)))
    at = lambda o: F.max(F.when(F.col("_o") == o, F.col(value)))
    near = sent.groupBy(*by, index).agg(at(0).alias(value), ((at(-1) - at(1)) / (2 * length / n)).alias("d_central"))
    return near.join(exact, [*by, index]).select(*by, index, value, "d_fft", "d_central")


def _long_product(df: DataFrame, by: list[str], index: str, a: str, b: str, n: int) -> DataFrame:
    """``dealiased_product`` of lines that are transformed in pieces."""
    m, h, i = 3 * n // 2, n // 2, F.col(index)
    rows = df.select(*by, i.cast("bigint").alias(index), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    plain = pencil_fft(as_complex(rows.select(*by, index, (F.col("_a") * F.col("_b")).alias("_p")), ["_p"]), by, index, n, ["_p"])
    hat = pencil_fft(as_complex(rows, ["_a", "_b"]), by, index, n, ["_a", "_b"])
    parts = [f"{v}_{c}" for v in ("_a", "_b") for c in ("re", "im")]
    wide = hat.withColumn(index, F.when(i < h, i).otherwise(i + (m - n))).withColumns({c: F.col(c) * (m / n) for c in parts})
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).drop("id")
    gap = groups.withColumn(index, F.explode(F.sequence(F.lit(h).cast("bigint"), F.lit(m - h - 1).cast("bigint")))).withColumns({c: F.lit(0.0) for c in parts})
    fine = pencil_fft(wide.unionByName(gap), by, index, m, ["_a", "_b"], True)
    re = F.col("_a_re") * F.col("_b_re") - F.col("_a_im") * F.col("_b_im")
    im = F.col("_a_re") * F.col("_b_im") + F.col("_a_im") * F.col("_b_re")
    clean = pencil_fft(fine.select(*by, index, re.alias("_c_re"), im.alias("_c_im")), by, index, m, ["_c"])
    clean = clean.where((i < h) | (i >= m - h)).withColumn(index, F.when(i < h, i).otherwise(i - (m - n)))
    out = plain.join(clean, [*by, index])
    return out.select(
        *by, i.alias("mode"), (F.col("_p_re") / n).alias("plain_re"), (F.col("_p_im") / n).alias("plain_im"),
        (F.col("_c_re") / m).alias("clean_re"), (F.col("_c_im") / m).alias("clean_im"),
    )


def fourier_amplitudes(
    df: DataFrame, by: Sequence[str], index: str, value: str, n: int, tol: float = 1e-10
) -> DataFrame:
    """Amplitude and phase parts of every mode above the tolerance: (by, wave, re, im, amplitude)."""
    rows = pencil_fft(as_complex(df.select(*by, index, value), [value]), by, index, n, [value])
    i = F.col(index)
    re, im = F.col(f"{value}_re") / n, F.col(f"{value}_im") / n
    out = rows.select(
        *by, F.when(i < n // 2, i).otherwise(i - n).alias("wave"), re.alias("re"), im.alias("im"),
        F.sqrt(re * re + im * im).alias("amplitude"),
    )
    return out.filter(F.col("amplitude") > tol)


def dealiased_product(
    df: DataFrame, by: Sequence[str], index: str, a: str, b: str, n: int
) -> DataFrame:
    """Spectra of a*b on n modes, plain and with the 3/2 rule: (by, mode, plain and clean re/im)."""
    if n % 2:
        raise ValueError("the transform needs an even number of nodes")
    if 3 * n // 2 > LINE:
        return _long_product(df, list(by), index, a, b, n)
    m, h = 3 * n // 2, n // 2

    def work(data):
        def widen(f):
            z = np.fft.fft(f, axis=1) / n
            wide = np.zeros((len(f), m), complex)
            wide[:, :h], wide[:, m - h :] = z[:, :h], z[:, h:]
            return np.fft.ifft(wide, axis=1) * m

        plain = np.fft.fft(data[:, 0] * data[:, 1], axis=1) / n
        fine = np.fft.fft(widen(data[:, 0]) * widen(data[:, 1]), axis=1) / m
        clean = np.concatenate([fine[:, :h], fine[:, m - h :]], axis=1)
        return np.stack([plain.real, plain.imag, clean.real, clean.imag], axis=1)

    names = ["plain_re", "plain_im", "clean_re", "clean_im"]
    return transform_lines(df, by, index, n, [a, b], names, work, out_axis="mode")


def poisson2d_fft(
    df: DataFrame, by: Sequence[str], value: str, shape: tuple[int, int], lengths: tuple[float, float]
) -> DataFrame:
    """Solution of the periodic Poisson equation for a tabulated source on nodes (i, j)."""
    nodes = dict(zip(("i", "j"), shape))
    hat = grid_fft(as_complex(df.select(*by, "i", "j", value), [value]), by, nodes, [value])
    k2 = sum(
        (F.pow(wavenumber(n, size, length, True), 2) for (n, size), length in zip(nodes.items(), lengths)), F.lit(0.0)
    )
    solved = hat.select(
        *by, "i", "j",
        *[F.when(k2 > 0, -F.col(f"{value}_{p}") / k2).otherwise(0.0).alias(f"phi_{p}") for p in ("re", "im")],
    )
    return grid_fft(solved, by, nodes, ["phi"], inverse=True).select(*by, "i", "j", F.col("phi_re").alias("phi"))

"""Queries over spectra, single-point turbulence, towers, wind farms and pixels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as P
from ..operators import binning as A
from ..operators import joins as J
from ..operators import pixels as X
from ..operators import spectral as G
from ..operators import turbulence as B
from ..operators import wind as M
from ..operators.binning import Axis
from ..operators.cameras import seeding_report
from ..operators.neighbours import knn
from ..sources import tables as ST
from .eulerian import HOT_WIRE, VOLTS, hot_wire_targets, hot_wire_volts, midpoint_quantile_sql
from .registry import query
from .views import FS, PIXELS, SAMPLES, SCADA, SIGNAL, TOWER, TWO_PI, grid_sql, num

# ------------------------------------------------------------ periodic fields

GRID = (Axis("x", 0.0, 50.0, 8), Axis("y", -0.005, 0.105, 8), Axis("z", -0.005, 0.085, 4))
PLACE = {a.name: n for a, n in zip(GRID, "ijk")}
_STRESS = ", ".join(f"avg({p}) * avg({q}) + covar_pop({p}, {q}) as t{p}{q}" for p, q in ("uu", "vv", "ww", "uv", "uw", "vw"))
TENSOR = f"""(select ix - 1 as i, iy - 1 as j, iz - 1 as k, tuu, tvv, tww, tuv, tuw, tvw from
    (select ix, iy, iz, {_STRESS} from {grid_sql(GRID)} g group by ix, iy, iz) t)"""
TENSOR = f"""(select n.i, n.j, n.k, {', '.join(f'coalesce(t{c}, 0) as t{c}' for c in ('uu', 'vv', 'ww', 'uv', 'uw', 'vw'))}
    from (select i, j, k from (select unnest(range(8)) as i) a, (select unnest(range(8)) as j) b, (select unnest(range(4)) as k) c) n
    left join {TENSOR} t on n.i = t.i and n.j = t.j and n.k = t.k)"""


def tensor(t):
    return G.second_moment_tensor(A.reynolds_stress(t.samples, GRID), [], GRID)


@query("g1_second_moment_tensor", ints="i j k", reals="tuu tvv tww tuv tuw tvw", sql=f"select * from {TENSOR} t")
def _(t):
    return tensor(t)


def _dft_sql(source: str, axis: str, n: int, others: str, re: str, im: str, sign: int = -1, scale: float = 1.0) -> str:
    """Transform along one axis as an explicit sum over the other nodes of the line."""
    angle = f"({num(sign * 2 * math.pi / n)} * ((q.{axis} * m) % {n}))"
    return f"""(select {others}, m as {axis}, {num(scale)} * sum({re} * cos{angle} - {im} * sin{angle}) as re,
        {num(scale)} * sum({re} * sin{angle} + {im} * cos{angle}) as im
        from {source} q, (select unnest(range({n})) as m) modes group by {others}, m)"""


@query("g2_pencil_fft", ints="i j k", reals="tuu_re tuu_im",
       sql=f"select i, j, k, re as tuu_re, im as tuu_im from {_dft_sql(TENSOR, 'j', 8, 'i, k', 'tuu', '0e0')} f")
def _(t):
    rows = G.as_complex(tensor(t).select("i", "j", "k", "tuu"), ["tuu"])
    return G.pencil_fft(rows, ["i", "k"], "j", 8, ["tuu"])


def _wave_sql(c: str, a: Axis) -> str:
    return f"(case when {c} <= {a.n // 2} then {c} else {c} - {a.n} end * {num(2 * math.pi / (a.hi - a.lo))})"


KX, KY, KZ = (_wave_sql(c, a) for c, a in zip("ijk", GRID))


def _source_sql() -> str:
    """Transformed source: wavenumbers times the three-axis transform of each tensor component."""
    hats = []
    for c in ("uu", "vv", "ww", "uv", "uw", "vw"):
        one = _dft_sql(f"(select i, j, k, t{c} as re, 0e0 as im from t)", "i", 8, "j, k", "re", "im")
        two = _dft_sql(one, "j", 8, "i, k", "re", "im")
        three = _dft_sql(two, "k", 4, "i, j", "re", "im")
        hats.append(f"{c} as materialized (select * from {three} x)")
    joins = " ".join(f"join {c} using (i, j, k)" for c in ("vv", "ww", "uv", "uw", "vw"))
    parts = []
    for p in ("re", "im"):
        parts.append(
            f"{KX}*{KX}*uu.{p} + {KY}*{KY}*vv.{p} + {KZ}*{KZ}*ww.{p} + 2*{KX}*{KY}*uv.{p} + 2*{KX}*{KZ}*uw.{p} + 2*{KY}*{KZ}*vw.{p} as s_{p}"
        )
    return f"""(with t as materialized (select * from {TENSOR} x), {', '.join(hats)},
        s as (select i, j, k, {', '.join(parts)}, {KX}*{KX} + {KY}*{KY} + {KZ}*{KZ} as k2 from uu {joins})
        select *, case when k2 < 1e-16 then 0 else -s_re / k2 end as p_re, case when k2 < 1e-16 then 0 else -s_im / k2 end as p_im from s)"""


SOURCE = _source_sql()


def _back_sql(v: str) -> str:
    out = f"(select i, j, k, {v}_re as re, {v}_im as im from {SOURCE} h)"
    for c, n, others in (("i", 8, "j, k"), ("j", 8, "i, k"), ("k", 4, "i, j")):
        out = _dft_sql(out, c, n, others, "re", "im", 1, 1 / n)
    return out


PRESSURE = f"(select a.i, a.j, a.k, a.re as p, b.re as source from {_back_sql('p')} a join {_back_sql('s')} b using (i, j, k))"


def pressure(t):
    return G.pressure_poisson(tensor(t), [], GRID)


@query("g3_pressure_poisson", ints="i j k", reals="p", sql=f"select * from {PRESSURE} p")
def _(t):
    return pressure(t)


@query(
    "g4_axis_spectrum", ints="j", reals="wave s_rel p_rel", digits=6,
    sql=f"""with h as (select j, sum(s_re*s_re + s_im*s_im) as s, sum(p_re*p_re + p_im*p_im) as p from {SOURCE} x group by j)
        select j, abs({KY}) as wave, s / max(s) over () as s_rel, p / max(p) over () as p_rel from h""",
)
def _(t):
    hat = G.source_spectrum(tensor(t), [], GRID)
    return G.axis_spectrum(hat, [], "j", 8, GRID[1].hi - GRID[1].lo)


@query(
    "g5_solver_diagnostics", reals="condition max_amplification source_rms pressure_rms ratio", digits=6,
    sql=f"""with a as (select j, avg(p) as p, avg(source) as s from {PRESSURE} f group by j)
        select 16e0 as condition, 1 / power({num(2 * math.pi / (GRID[1].hi - GRID[1].lo))}, 2) as max_amplification,
          sqrt(avg(s * s)) as source_rms, sqrt(avg(p * p)) as pressure_rms, sqrt(avg(p * p)) / sqrt(avg(s * s)) as ratio from a""",
)
def _(t):
    return G.solver_diagnostics(pressure(t), [], GRID)


@query("g5b_plane_profiles", ints="j", reals="p source", sql=f"select j, avg(p) as p, avg(source) as source from {PRESSURE} f group by j")
def _(t):
    return G.plane_profiles(pressure(t), [])


@query(
    "g6_rel_errors", ints="run", reals="l2_u linf_u l2_v linf_v",
    sql=f"""with b as (select run, iy, avg(u) as u, avg(v) as v from {grid_sql((GRID[1],))} g group by run, iy),
        r as (select iy, avg(u) as ru, avg(v) as rv from {grid_sql((GRID[1],))} g group by iy)
        select run, sqrt(sum(power(u-ru,2)) / sum(ru*ru)) as l2_u, max(abs(u-ru)) / max(abs(ru)) as linf_u,
          sqrt(sum(power(v-rv,2)) / sum(rv*rv)) as l2_v, max(abs(v-rv)) / max(abs(rv)) as linf_v from b join r using (iy) group by run""",
)
def _(t):
    bins = A.bin_means(t.samples, (GRID[1],), ["u", "v"], ["run"])
    ref = A.bin_means(t.samples, (GRID[1],), ["u", "v"]).select("iy", F.col("u").alias("ru"), F.col("v").alias("rv"))
    return G.rel_errors(bins.join(ref, "iy"), ["run"], {"u": "ru", "v": "rv"})


@query(
    "g7_reference_to_centre", ints="run iy", reals="u",
    sql=f"""with b as (select run, iy, avg(u) as u from {grid_sql((GRID[1],))} g group by run, iy),
        c as (select run, u as c from (select *, row_number() over (partition by run order by abs(iy - 4.5e0), iy) as r from b) x where r = 1)
        select run, iy, u - c + 2 as u from b join c using (run)""",
)
def _(t):
    return G.reference_to_centre(A.bin_means(t.samples, (GRID[1],), ["u"], ["run"]), ["run"], GRID[1], "u", 2.0)


NSEG = 32
_TAPER = f"(0.54e0 - 0.46e0 * cos({TWO_PI} * p / {NSEG - 1}))"
WELCH = f"""(with f as (select case_id, regr_slope(u, n) as s, regr_intercept(u, n) as i, count(*) as c from {SIGNAL} x group by case_id),
    d as (select case_id, n, u - (s * n + i) as u, c from {SIGNAL} x join f using (case_id)),
    g as (select case_id, seg, n - seg * 16 as p, u * (0.54e0 - 0.46e0 * cos({TWO_PI} * (n - seg * 16) / {NSEG - 1})) as x
          from d, (select unnest(range(20000)) as seg) r where seg < (c - 16) // 16 and n >= seg * 16 and n < seg * 16 + 32),
    h as (select case_id, seg, bin, power(sum(x * cos({TWO_PI} * ((p * bin) % 32) / 32)), 2) + power(sum(x * sin({TWO_PI} * ((p * bin) % 32) / 32)), 2) as e
          from g, (select unnest(range(17)) as bin) b group by case_id, seg, bin),
    w as (select sum(power(0.54e0 - 0.46e0 * cos({TWO_PI} * m / {NSEG - 1}), 2)) as w from (select unnest(range(32)) as m) q)
    select case_id, bin, count(*) as segments, bin * {num(FS / NSEG)} as freq,
      avg(e) * case when bin = 0 or bin = 16 then 1 else 2 end / ({num(FS)} * max(w)) as psd from h, w group by case_id, bin)"""


def psd(t):
    return G.welch_psd(t.signal, ["case_id"], "n", "u", NSEG, NSEG // 2, FS)


@query("g8_welch_psd", texts="case_id", ints="bin segments", reals="freq psd", sql=f"select * from {WELCH} w")
def _(t):
    return psd(t)


NU, DIAMETER = 1.48e-5, 0.01


@query(
    "g9_wavenumber_spectrum", texts="case_id", ints="bin", reals="wave energy wave_outer energy_outer", digits=3,
    sql=f"""select case_id, bin, {TWO_PI} * freq / su as wave, su * psd as energy, {TWO_PI} * freq / su * 0.01e0 as wave_outer,
        su * psd / (su * 0.01e0) as energy_outer from {WELCH} w join (select case_id, avg(u) as su from {SIGNAL} s group by case_id) m using (case_id)""",
)
def _(t):
    speeds = t.signal.groupBy("case_id").agg(F.avg("u").alias("su"))
    rows = psd(t).join(speeds, "case_id")
    return G.wavenumber_spectrum(rows, F.col("su"), F.lit(2.0), NU, DIAMETER)


RING = f"(select case_id, n % 16 as i, avg(u) as u, avg(v) as v from {SIGNAL} s group by case_id, n % 16)"


def ring(t):
    """Phase average of the signal: a periodic series of 16 nodes per case."""
    return t.signal.groupBy("case_id", (F.col("n") % 16).alias("i")).agg(F.avg("u").alias("u"), F.avg("v").alias("v"))


@query(
    "g10_spectral_derivative", texts="case_id", ints="i", reals="d_fft d_central",
    sql=f"""with h as (select case_id, m, sum(u * cos({TWO_PI} * ((i * m) % 16) / 16)) / 16 as re, -sum(u * sin({TWO_PI} * ((i * m) % 16) / 16)) / 16 as im
          from {RING} r, (select unnest(range(16)) as m) q group by case_id, m),
        d as (select case_id, x as i, sum(case when m = 8 then 0 when m < 8 then m else m - 16 end *
          -(re * sin({TWO_PI} * ((x * m) % 16) / 16) + im * cos({TWO_PI} * ((x * m) % 16) / 16))) as d_fft
          from h, (select unnest(range(16)) as x) q group by case_id, x)
        select a.case_id, a.i, d_fft, (b.u - c.u) / (2 * {TWO_PI} / 16) as d_central from d a
        join {RING} b on a.case_id = b.case_id and b.i = (a.i + 1) % 16 join {RING} c on a.case_id = c.case_id and c.i = (a.i + 15) % 16""",
)
def _(t):
    return G.spectral_derivative(ring(t), ["case_id"], "i", "u", 16, 2 * math.pi)


@query(
    "g11_fourier_amplitudes", texts="case_id", ints="wave", reals="re im amplitude",
    sql=f"""select case_id, case when m < 8 then m else m - 16 end as wave, re, im, sqrt(re*re + im*im) as amplitude from (
        select case_id, m, sum(u * cos({TWO_PI} * ((i * m) % 16) / 16)) / 16 as re, -sum(u * sin({TWO_PI} * ((i * m) % 16) / 16)) / 16 as im
        from {RING} r, (select unnest(range(16)) as m) q group by case_id, m) h where sqrt(re*re + im*im) > 1e-3""",
)
def _(t):
    return G.fourier_amplitudes(ring(t), ["case_id"], "i", "u", 16, 1e-3)


_SPECTRA = f"""(select case_id, case when m < 8 then m else m - 16 end as m,
    sum(u * cos({TWO_PI} * ((i * m) % 16) / 16)) / 16 as ar, -sum(u * sin({TWO_PI} * ((i * m) % 16) / 16)) / 16 as ai,
    sum(v * cos({TWO_PI} * ((i * m) % 16) / 16)) / 16 as br, -sum(v * sin({TWO_PI} * ((i * m) % 16) / 16)) / 16 as bi,
    sum(u * v * cos({TWO_PI} * ((i * m) % 16) / 16)) / 16 as pr, -sum(u * v * sin({TWO_PI} * ((i * m) % 16) / 16)) / 16 as pi
    from {RING} r, (select unnest(range(16)) as m) q group by case_id, q.m)"""


@query(
    "g11b_dealiased_product", texts="case_id", ints="mode", reals="plain_re plain_im clean_re clean_im",
    sql=f"""with s as materialized (select * from {_SPECTRA} x),
        c as (select a.case_id, a.m + b.m as m, sum(a.ar * b.br - a.ai * b.bi) as re, sum(a.ar * b.bi + a.ai * b.br) as im
          from s a join s b on a.case_id = b.case_id where a.m + b.m between -8 and 7 group by 1, 2)
        select s.case_id, (s.m + 16) % 16 as mode, pr as plain_re, pi as plain_im, re as clean_re, im as clean_im
        from s join c on s.case_id = c.case_id and s.m = c.m""",
)
def _(t):
    return G.dealiased_product(ring(t), ["case_id"], "i", "u", "v", 16)


PLANE = f"""(select cast(x as bigint) % 8 as i, l_partkey % 8 as j, avg(u) as f from {SAMPLES} s group by 1, 2)"""
_M = "(case when {0} = 4 then 0 when {0} < 4 then {0} else {0} - 8 end)"


@query(
    "g12_poisson2d_fft", ints="i j", reals="phi",
    sql=f"""with a as materialized (select * from {_dft_sql(f'(select i, j, f as re, 0e0 as im from {PLANE} p)', 'i', 8, 'j', 're', 'im')} x),
        b as materialized (select * from {_dft_sql('a', 'j', 8, 'i', 're', 'im')} y),
        c as (select i, j, power({_M.format('i')}, 2) + power({_M.format('j')}, 2) as k2, re, im from b),
        d as materialized (select i, j, case when k2 > 0 then -re / k2 else 0 end as re, case when k2 > 0 then -im / k2 else 0 end as im from c),
        e as materialized (select * from {_dft_sql('d', 'i', 8, 'j', 're', 'im', 1, 1 / 8)} z)
        select i, j, re as phi from {_dft_sql('e', 'j', 8, 'i', 're', 'im', 1, 1 / 8)} w""",
)
def _(t):
    plane = t.samples.groupBy((F.col("x").cast("bigint") % 8).alias("i"), (F.col("l_partkey") % 8).alias("j")).agg(F.avg("u").alias("f"))
    return G.poisson2d_fft(plane, [], "f", (8, 8), (2 * math.pi, 2 * math.pi))


# ------------------------------------------------------ single-point statistics

XLAG = 24
FLUCT = f"(select case_id, n, u - avg(u) over (partition by case_id) as a, v - avg(v) over (partition by case_id) as b from {SIGNAL} s)"


def _xcorr_sql(a: str, b: str) -> str:
    return f"""(with f as materialized (select * from {FLUCT} f),
      z as (select case_id, sqrt(sum({a}*{a}) * sum({b}*{b})) as z from f group by case_id)
      select p.case_id, lag, lag * {num(1 / FS)} as tau, sum(p.{b} * q.{a}) / max(z) as r from f p
      cross join (select unnest(range(-{XLAG}, {XLAG + 1})) as lag) l
      join f q on p.case_id = q.case_id and q.n = p.n + lag join z on z.case_id = p.case_id group by p.case_id, lag)"""


def fluct(t):
    from ..operators.sequence import fluctuation

    f = fluctuation(t.signal, ["case_id"], ["u", "v"])
    return f.select("case_id", "n", F.col("u_p").alias("a"), F.col("v_p").alias("b"))


def curve(t, a="a", b="a"):
    return B.xcorr(fluct(t), ["case_id"], "n", a, b, XLAG, 1 / FS, size=1024)


def speeds(t):
    return t.signal.groupBy("case_id").agg(F.avg("u").alias("su"), F.var_pop("u").alias("uu"))


SPEEDS = f"(select case_id, avg(u) as su, var_pop(u) as uu from {SIGNAL} s group by case_id)"


@query("b1_xcorr", texts="case_id", ints="lag", reals="tau r", digits=6, sql=f"select * from {_xcorr_sql('a', 'b')} x")
def _(t):
    return curve(t, "a", "b")


@query("b2_spatial_lags", texts="case_id", ints="lag", reals="dist r", digits=6,
       sql=f"select case_id, lag, tau * su as dist, r from {_xcorr_sql('a', 'a')} x join {SPEEDS} s using (case_id)")
def _(t):
    return B.spatial_lags(curve(t), speeds(t), ["case_id"], "su")


TAYLOR = f"""(with c as (select * from {_xcorr_sql('a', 'a')} x where abs(lag) <= 10),
    s as (select case_id, count(*) as n, sum(tau*tau) as t2, sum(power(tau,4)) as t4, sum(r) as y0, sum(tau*tau*r) as y2 from c group by case_id)
    select case_id, sqrt(-1 / (2 * ((n * y2 - t2 * y0) / (n * t4 - t2 * t2)))) as taylor_t from s)"""


@query("b3_taylor_scale", texts="case_id", reals="taylor_t taylor_x", digits=5,
       sql=f"select case_id, taylor_t, taylor_t * su as taylor_x from {TAYLOR} t join {SPEEDS} s using (case_id)")
def _(t):
    return B.taylor_scale(curve(t), speeds(t), ["case_id"], "r", "su")


@query(
    "b4_integral_scale", texts="case_id", reals="integral_t integral_x", digits=6,
    sql=f"""with c as (select *, lag(tau) over o as pt, lag(r) over o as pr, coalesce(min(case when r <= 0 then lag end) over (partition by case_id),
          {XLAG}) as stop from {_xcorr_sql('a', 'a')} x where lag >= 0 window o as (partition by case_id order by lag))
        select case_id, sum(case when lag <= stop then (tau - pt) * (r + pr) / 2 end) as integral_t,
          sum(case when lag <= stop then (tau - pt) * (r + pr) / 2 end) * max(su) as integral_x from c join {SPEEDS} s using (case_id) group by case_id""",
)
def _(t):
    return B.integral_scale(curve(t), speeds(t), ["case_id"], "r", "su")


@query(
    "b5_dissipation_kolmogorov", texts="case_id", reals="dissipation eta tau_eta re_macro re_turb", digits=3,
    sql=f"""with x as (select case_id, taylor_t * su as lam, su, uu from {TAYLOR} t join {SPEEDS} s using (case_id)),
        e as (select *, 15 * {num(NU)} * uu / (lam * lam) as dissipation from x)
        select case_id, dissipation, power(power({num(NU)}, 3) / dissipation, 0.25e0) as eta, sqrt({num(NU)} / dissipation) as tau_eta,
          su * 0.01e0 / {num(NU)} as re_macro, sqrt(uu) * lam / {num(NU)} as re_turb from e""",
)
def _(t):
    s = speeds(t)
    scales = B.taylor_scale(curve(t), s, ["case_id"], "r", "su").join(s, "case_id")
    return B.dissipation_kolmogorov(scales, F.col("uu"), F.col("su"), NU, DIAMETER)


@query(
    "b6_isotropic_transverse", texts="case_id", ints="lag", reals="g_iso", digits=5,
    sql=f"""with c as (select case_id, lag, tau * su as d, r from {_xcorr_sql('a', 'a')} x join {SPEEDS} s using (case_id))
        select case_id, lag, r + 0.5e0 * d * (coalesce(lead(r) over o, r) - coalesce(lag(r) over o, r)) /
          (coalesce(lead(d) over o, d) - coalesce(lag(d) over o, d)) as g_iso from c window o as (partition by case_id order by lag)""",
)
def _(t):
    c = B.spatial_lags(curve(t), speeds(t), ["case_id"], "su")
    return B.isotropic_transverse(c, ["case_id"], "r", "dist")


def calibration(t):
    known = hot_wire_targets()
    targets = {"U": known["speed"], "V": known["angle"]}
    return A.poly_calibration_fit(hot_wire_volts(t), "e1", "e2", targets, ["case_id"])


CALIBRATED = f"(select case_id, n, ({HOT_WIRE['speed'].format('e1', 'e2')}) / 10 as u, ({HOT_WIRE['angle'].format('e1', 'e2')}) / 10 as v from {VOLTS} vo)"


@query("j12_apply_calibration", texts="case_id", ints="n", reals="u v", digits=3, sql=f"select * from {CALIBRATED} c")
def _(t):
    return B.apply_calibration(hot_wire_volts(t).drop("u", "v"), calibration(t), ["case_id"], "e1", "e2", 10.0)


@query("b7_velocity_from_volts", texts="case_id", ints="n", reals="mean std", digits=3,
       sql=f"select case_id, count(*) as n, avg(u) as mean, stddev_samp(u) as std from {CALIBRATED} c group by case_id")
def _(t):
    volts = hot_wire_volts(t).drop("u", "v")
    stats, _ = B.velocity_from_volts(volts, calibration(t), ["case_id"], "n", "e1", "e2", 10.0, NSEG, FS)
    return stats


@query("b7b_velocity_spectrum", texts="case_id", ints="bin segments", reals="freq psd", digits=3,
       sql=f"select * from {WELCH.replace(SIGNAL, CALIBRATED)} w")
def _(t):
    volts = hot_wire_volts(t).drop("u", "v")
    _, spectrum = B.velocity_from_volts(volts, calibration(t), ["case_id"], "n", "e1", "e2", 10.0, NSEG, FS)
    return spectrum


# ----------------------------------------------------------------------- tower


@query(
    "s11_melt_channels", texts="signal", ints="height_m n", reals="value",
    sql="""select signal, height_m, count(*) as n, avg(value) as value from (
        select 'Cup_WS' as signal, 30 as height_m, l_quantity as value from lineitem union all
        select 'Cup_WS', 130, l_discount from lineitem union all select 'Air_Temp', 87, l_tax from lineitem) x group by 1, 2""",
)
def _(t):
    wide = t.lineitem.select(
        F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("Cup_WS_30m"), F.col("l_discount").alias("Cup_WS_130m"),
        F.col("l_tax").alias("Air_Temp_87m"),
    )
    return ST.melt_channels(wide, "ts").groupBy("signal", "height_m").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))


@query(
    "s12_record_at", ints="l_orderkey l_linenumber", reals="u",
    sql=f"select l_orderkey, l_linenumber, u from {SAMPLES} s where l_shipdate = timestamp '1998-03-05 00:00:00'",
)
def _(t):
    return ST.record_at(t.samples, "l_shipdate", F.lit("1998-03-05 00:00:00").cast("timestamp_ntz"))


@query(
    "p16_virtual_potential_temperature", ints="record height n", reals="p theta",
    sql=f"""select record, height, n, p, temp * power(81100e0 / p, {num(287.0 / 1004.0)}) as theta from (
        select *, 81100e0 - height * 9.81e0 * 81100e0 / (287.05e0 * temp) as p from {TOWER} t) x""",
)
def _(t):
    p = P.pressure_at(F.lit(81100.0), "height", "temp")
    return t.tower.withColumn("p", p).withColumn("theta", P.virtual_potential_temperature("temp", "p"))


@query(
    "p18_businger_dyer", ints="record height n", reals="psi shear",
    sql=f"""with x as (select record, height, n, power(1 + 15e0 * height / (40 + 100 * temp / 300), 0.25e0) as x, power(1 + 15e0 * height / (40 + 100 * temp / 300), -0.25e0) as y
          from {TOWER} t)
        select record, height, n, -2 * ln((1 + x) / 2) - ln(1 + x * x) + 2 * atan(x) - {num(math.pi / 2)} as psi, 0.3e0 / (0.4e0 * height) * y as shear from x""",
)
def _(t):
    rows = t.tower.withColumn("l", -(40 + 100 * F.col("temp") / 300))
    return rows.withColumns({"psi": P.businger_dyer_psi("height", "l"), "shear": P.shear("height", "l", F.lit(0.3))})


@query(
    "m1_profile_by_height", ints="record height n", reals="speed speed_std temp temp_std",
    sql=f"""select record, height, count(*) as n, avg(sqrt(u*u+v*v)) as speed, stddev_samp(sqrt(u*u+v*v)) as speed_std, avg(temp) as temp,
        stddev_samp(temp) as temp_std from {TOWER} t group by record, height""",
)
def _(t):
    return M.profile_by_height(t.tower, ["record"], "height")


def _turbulence_sql(window: str) -> str:
    return f"""(select record, height, count(*) as n, avg(temp) as temp, avg(sp) as speed, avg(e) as tke, stddev_samp(e) as tke_std, avg(a*c) as uw,
      stddev_samp(a*c) as uw_std, avg(b*c) as vw, avg(c*d) as wt, avg(c*d) * 9.81e0 / avg(temp) as buoyancy,
      stddev_samp(c*d) * 9.81e0 / avg(temp) as buoyancy_std, avg(c*c) as ww
      from (select *, 0.5e0 * (a*a + b*b + c*c) as e from (select record, height, temp, sqrt(u*u+v*v) as sp, u - avg(u) over o as a,
        v - avg(v) over o as b, w - avg(w) over o as c, temp - avg(temp) over o as d from {TOWER} t
        window o as (partition by record, height {window})) f) g group by record, height)"""


TURB_REALS = "tke tke_std uw uw_std vw wt buoyancy buoyancy_std"


@query("m2_turbulence_by_height", ints="record height n", reals=TURB_REALS, sql=f"select * from {_turbulence_sql('')} t")
def _(t):
    return M.turbulence_by_height(t.tower, ["record"], "height", "n")


@query("m2b_turbulence_moving_mean", ints="record height n", reals=TURB_REALS,
       sql=f"select * from {_turbulence_sql('order by n rows between 15 preceding and 14 following')} t")
def _(t):
    return M.turbulence_by_height(t.tower, ["record"], "height", "n", 30)


@query(
    "m3_buoyancy_flux", ints="record height", reals="theta flux flux_std",
    sql=f"""with p as (select *, 81100e0 - height * 9.81e0 * 81100e0 / (287.05e0 * avg(temp) over (partition by record, height)) as p from {TOWER} t),
        h as (select record, height, w, temp * power(81100e0 / p, {num(287.0 / 1004.0)}) as th from p),
        f as (select record, height, th, (w - avg(w) over o) * (th - avg(th) over o) as x from h window o as (partition by record, height))
        select record, height, avg(th) as theta, avg(x) * 9.81e0 / avg(th) as flux, stddev_samp(x) * 9.81e0 / avg(th) as flux_std from f group by record, height""",
)
def _(t):
    return M.buoyancy_flux(t.tower.withColumn("baro", F.lit(81100.0)), ["record"], "height", "baro")


@query(
    "m4_shear_production", ints="record height", reals="dudz sw production", digits=6,
    sql=f"""with l as (select record, height, avg(sqrt(u*u+v*v)) as speed, covar_pop(sqrt(u*u+v*v), w) as sw from {TOWER} t group by record, height),
        d as (select *, (coalesce(lead(speed) over o, speed) - coalesce(lag(speed) over o, speed)) /
          (coalesce(lead(height) over o, height) - coalesce(lag(height) over o, height)) as dudz from l window o as (partition by record order by height))
        select record, height, dudz, sw, dudz * sw as production from d""",
)
def _(t):
    return M.shear_production(t.tower, ["record"], "height")


STABLE = f"""(with l as (select * from {_turbulence_sql('')} t where height = 15),
    s as (select *, power(uw*uw + vw*vw, 0.25e0) as friction from l),
    q as (select *, -power(friction, 3) * temp / (0.4e0 * 9.81e0 * wt) as obukhov from s)
    select record, friction, obukhov, case when obukhov < 0 then buoyancy / (uw * friction / (0.4e0 * height) * power(1 - 15e0 * height / obukhov, -0.25e0)) end as richardson from q)"""


@query("m5_stability", ints="record", reals="friction obukhov richardson", sql=f"select * from {STABLE} s")
def _(t):
    return M.stability(M.turbulence_by_height(t.tower, ["record"], "height", "n"), ["record"], "height")


@query(
    "m5b_convective_scale", ints="record height", reals="w_scale w_ratio",
    sql=f"""select record, height, sign(buoyancy * height) * power(abs(buoyancy * height), {num(1.0 / 3.0)}) as w_scale,
        sign(buoyancy * height) * power(abs(buoyancy * height), {num(1.0 / 3.0)}) / sqrt(ww) as w_ratio from {_turbulence_sql('')} t""",
)
def _(t):
    return M.convective_scale(M.turbulence_by_height(t.tower, ["record"], "height", "n"), "height")


_BISQUARE = "case when abs(x - c) < h then power(1 - power((x - c) / h, 2), 2) else 0 end"


@query(
    "m6_roughness_fit", ints="record levels", reals="ln_z0",
    sql=f"""with recursive l as (select record, ln(height) - 0.4e0 * speed / s.friction + case when s.obukhov < 0 then -2 * ln((1 + x) / 2) - ln(1 + x * x)
            + 2 * atan(x) - {num(math.pi / 2)} else 0 end as z
          from (select t.*, s.friction, s.obukhov, case when s.obukhov < 0 then power(1 - 15e0 * t.height / s.obukhov, 0.25e0) end as x
            from {_turbulence_sql('')} t join {STABLE} s using (record)) s),
        g as materialized (select record, list(z order by z) as z from l where z is not null group by record),
        r as (select record, z, list_avg(z) as c, 0 as k from g union all
          select record, z, list_sum([{_BISQUARE} * x for x in z]) / list_sum([{_BISQUARE} for x in z]), k + 1
          from (select *, 4.685e0 * greatest(list_median([abs(x - c) for x in z]) / 0.6745e0, 1e-12) as h from r where k < 20) q)
        select record, len(z) as levels, c as ln_z0 from r where k = 20""",
)
def _(t):
    levels = M.turbulence_by_height(t.tower, ["record"], "height", "n")
    fit = M.roughness_fit(levels, M.stability(levels, ["record"], "height"), ["record"], "height")
    return fit.withColumn("ln_z0", F.log("z0"))


# ------------------------------------------------------------------- wind farm

TURBINES, CHANNELS = tuple(f"{k:02d}" for k in range(1, 16)), ("wind_dir", "wind_speed", "rpm", "power", "yaw")


@query(
    "s9_melt_scada", texts="turbine", ints="n", reals="wind_dir wind_speed rpm power yaw",
    sql=f"""with w as (select ts, turbine, wind_dir, wind_speed, rpm, power, yaw from {SCADA} s)
        select lpad(cast(turbine + 1 as varchar), 2, '0') as turbine, count(*) as n, avg(wind_dir) as wind_dir, avg(wind_speed) as wind_speed, avg(rpm) as rpm,
          avg(power) as power, avg(yaw) as yaw from w group by w.turbine""",
)
def _(t):
    wide = t.scada.groupBy("ts").agg(
        *[
            F.max(F.when(F.col("turbine") == k, F.col(c))).alias(f"{c}_{k}")
            for k in range(len(TURBINES))
            for c in CHANNELS
        ]
    )
    long = ST.melt_scada(wide, "ts", TURBINES, CHANNELS).dropna(subset=list(CHANNELS))
    return long.groupBy("turbine").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in CHANNELS])


SITES = "(select s_suppkey as turbine, 45e0 + s_suppkey * 1e-3 as lat, -51e0 + (s_suppkey % 7) * 2e-3 as lon from supplier)"


def sites(t):
    """Turbine positions derived from the supplier keys, written and read back as a site file."""
    from ..session import scratch_path

    path = scratch_path(t.spark, "sites")
    t.supplier.select(
        F.concat(F.lit("WTG"), F.col("s_suppkey").cast("string")).alias("Name"),
        (45 + F.col("s_suppkey") * 1e-3).alias("Latitude"), (-51 + (F.col("s_suppkey") % 7) * 2e-3).alias("Longitude"),
    ).write.option("header", True).csv(path)
    return ST.read_sites(t.spark, path).withColumn("turbine", F.col("name").cast("bigint"))


@query("s10_read_sites", texts="name", reals="lat lon", sql=f"select cast(turbine as varchar) as name, lat, lon from {SITES} s")
def _(t):
    return sites(t)


@query(
    "p11_local_km", ints="turbine", reals="x_km y_km",
    sql=f"""select turbine, (lat - (select arg_min(lat, turbine) from {SITES} a)) * 111 as x_km,
        (lon - (select arg_min(lon, turbine) from {SITES} b)) * 111 as y_km from {SITES} s""",
)
def _(t):
    return ST.local_km(sites(t), "turbine")


@query(
    "m13_snapshot", ints="turbine", reals="power lat lon",
    sql=f"""select turbine, power, lat, lon from {SCADA} s join {SITES} p using (turbine) where ts = (select max(ts) from {SCADA} q)""",
)
def _(t):
    last = t.scada.agg(F.max("ts").alias("m")).scalar()
    return ST.snapshot(t.scada, sites(t), last)


@query(
    "p8_angle_diff", ints="turbine n", reals="d w",
    sql=f"""select turbine, epoch_us(ts) // 1000000 as n, case when abs(b - a) <= 180 then b - a when b - a > 180 then b - a - 360 else b - a + 360 end as d,
        case when a > 0 and a * 3 - 360 * floor(a * 3 / 360) = 0 then 360 else a * 3 - 360 * floor(a * 3 / 360) end as w
        from (select *, floor(yaw + 1e-6) as a, floor(wind_dir + 1e-6) as b from {SCADA} s) x""",
)
def _(t):
    # Whole degrees, so that differences of exactly 180 occur and are exact.
    rows = t.scada.withColumns(
        {c: F.floor(F.col(c) + 1e-6).cast("double") for c in ("yaw", "wind_dir")}
    )
    stamp = F.unix_seconds(F.col("ts").cast("timestamp"))
    return rows.withColumns({"n": stamp, "d": P.angle_diff("yaw", "wind_dir"), "w": P.wrap360(F.col("yaw") * 3)})


@query(
    "p9_wind_components", ints="turbine n", reals="wu wv",
    sql=f"""select turbine, epoch_us(ts) // 1000000 as n, -wind_speed * cos(radians(wind_dir)) as wu, -wind_speed * sin(radians(wind_dir)) as wv from {SCADA} s""",
)
def _(t):
    wu, wv = P.wind_components("wind_speed", "wind_dir")
    return t.scada.withColumns({"n": F.unix_seconds(F.col("ts").cast("timestamp")), "wu": wu, "wv": wv})


@query(
    "p12_power_coefficient", ints="turbine n", reals="cp tsr",
    sql=f"""select turbine, epoch_us(ts) // 1000000 as n, case when power >= 0 then 1000 * power / (0.5e0 * 1.225e0 * {num(math.pi * 63 * 63)} * power(wind_speed, 3)) end as cp,
        rpm * 63 / wind_speed as tsr from {SCADA} s""",
)
def _(t):
    n = F.unix_seconds(F.col("ts").cast("timestamp"))
    cp = P.power_coefficient(F.col("power") * 1000, "wind_speed", 1.225, 63.0)
    return t.scada.withColumns({"n": n, "cp": cp, "tsr": P.tip_speed_ratio("rpm", "wind_speed", 63.0)})


FARM = f"(select ts, coalesce(sum(power), 0) as total, avg(wind_dir) as mean_dir, count(*) as turbines from {SCADA} s group by ts)"


@query("m7_farm_power", ints="n turbines", reals="total",
       sql=f"select epoch_us(ts) // 1000000 as n, turbines, total from {FARM} f")
def _(t):
    return M.farm_power(t.scada).withColumn("n", F.unix_seconds(F.col("ts").cast("timestamp")))


@query(
    "m8_mean_direction", ints="n", reals="mean_dir circular_dir", digits=3,
    sql=f"""select epoch_us(ts) // 1000000 as n, avg(wind_dir) as mean_dir,
        (degrees(atan2(avg(sin(radians(wind_dir))), avg(cos(radians(wind_dir))))) + 360) % 360 as circular_dir from {SCADA} s group by ts""",
)
def _(t):
    return M.mean_direction(t.scada).withColumn("n", F.unix_seconds(F.col("ts").cast("timestamp")))


SECTORS = f"""(select centre, avg(total) as mean_power, count(*) as n from {FARM} f, (select unnest(range(72)) * 5 + 2.5e0 as centre) c
    where least(abs(mean_dir - centre), 360 - abs(mean_dir - centre)) <= 2.5e0 group by centre)"""


@query("m9_power_by_direction", ints="n", reals="centre mean_power", sql=f"select * from {SECTORS} s")
def _(t):
    return M.power_by_direction(M.farm_power(t.scada))


@query("m10_worst_direction", ints="n", reals="centre mean_power",
       sql=f"select * from {SECTORS} s where n >= 5 order by mean_power, centre limit 1")
def _(t):
    return M.worst_direction(M.power_by_direction(M.farm_power(t.scada)))


ROW = (2, 3, 4)
_NEAR = "least(abs(mean_dir - {0}), 360 - abs(mean_dir - {0})) <= 40"
CONDITIONAL = f"""(with j as (select s.*, mean_dir from {SCADA} s join (select ts, mean_dir from {FARM} f) g using (ts) where turbine in (2, 3, 4))
    select *, turbine - 1 as position, 0 as flipped from j where {_NEAR.format('292.5e0')}
    union all select *, 5 - turbine as position, 1 as flipped from j where {_NEAR.format('112.5e0')})"""


@query("j13_conditional_rows", ints="n turbine position flipped", reals="power",
       sql=f"select epoch_us(ts) // 1000000 as n, * from {CONDITIONAL} c")
def _(t):
    both = t.scada.join(M.farm_power(t.scada).select("ts", "mean_dir"), "ts")
    rows = J.conditional_rows(both, "wind_dir", 292.5, 40.0, ROW)
    return rows.withColumn("n", F.unix_seconds(F.col("ts").cast("timestamp")))


@query(
    "m11_wake_row", ints="position n", reals="mean std",
    sql=f"""with c as materialized (select * from {CONDITIONAL} c), l as (select ts, flipped, power as f from c where position = 1),
        r as (select position, power / nullif(f, 0) as q from c join l using (ts, flipped))
        select position, count(q) as n, avg(q) as mean, stddev_samp(q) as std from r group by position""",
)
def _(t):
    return M.wake_row(t.scada, 292.5, 40.0, ROW)


@query(
    "m12_yaw_misalignment", ints="turbine n", reals="mean_abs",
    sql=f"""select turbine, count(*) as n, avg(abs(case when abs(wind_dir - yaw) <= 180 then wind_dir - yaw when wind_dir - yaw > 180 then wind_dir - yaw - 360
        else wind_dir - yaw + 360 end)) as mean_abs from {SCADA} s group by turbine""",
)
def _(t):
    return M.mean_misalignment(t.scada, ["turbine"])


# ---------------------------------------------------------------------- pixels

SHAPE = (16, 16)
BACK = f"(select cam, row, col, median(value) as background from {PIXELS} p group by cam, row, col)"


@query("x1_temporal_background", ints="cam row col", reals="background", sql=f"select * from {BACK} b")
def _(t):
    return X.temporal_background(t.pixels)


@query(
    "x1b_subtract_background", ints="cam frame row col", reals="value",
    sql=f"""select cam, frame, row, col, greatest(value - background, 0) as value from {PIXELS} p
        join (select cam, row, col, avg(value) as background from {PIXELS} q group by cam, row, col) b using (cam, row, col)""",
)
def _(t):
    return X.subtract_background(t.pixels, X.temporal_background(t.pixels, "mean"))


DENSE = f"""(select cam, frame, row, col, coalesce(value, 0) as value from (select * from (select distinct cam, frame from {PIXELS} p) f,
    (select unnest(range(16)) as row) r, (select unnest(range(16)) as col) c) every left join {PIXELS} v using (cam, frame, row, col))"""


def dense(t):
    return X.dense_frames(t.pixels, *SHAPE)


def _blur_sql(source: str, sigma: float) -> str:
    from ..operators.ftle import gaussian_kernel

    half = math.ceil(2 * sigma)
    weights = ", ".join(f"({o - half}, {num(w)})" for o, w in enumerate(gaussian_kernel(sigma, half)))
    one = f"""(select a.cam, a.frame, a.row, a.col, sum(w * b.value) as value from {source} a, (values {weights}) as g(o, w), {source} b
        where b.cam = a.cam and b.frame = a.frame and b.col = a.col and b.row = least(greatest(a.row + o, 0), 15) group by a.cam, a.frame, a.row, a.col)"""
    return one, f"""(select a.cam, a.frame, a.row, a.col, sum(w * b.value) as value from {{0}} a, (values {weights}) as g(o, w), {{0}} b
        where b.cam = a.cam and b.frame = a.frame and b.row = a.row and b.col = least(greatest(a.col + o, 0), 15) group by a.cam, a.frame, a.row, a.col)"""


_F1, _F2 = _blur_sql("d", 0.7)
_C1, _C2 = _blur_sql("d", 2.0)
BAND = f"""(with d as materialized (select * from {DENSE} x), f1 as materialized (select * from {_F1} x), c1 as materialized (select * from {_C1} x),
    f as (select * from {_F2.format('f1')} x), c as (select * from {_C2.format('c1')} x)
    select cam, frame, row, col, f.value - c.value as value from f join c using (cam, frame, row, col))"""


def band(t):
    return X.bandpass(dense(t), SHAPE, 2.0, 0.7)


@query("x2_bandpass", ints="cam frame row col", reals="value", sql=f"select * from {BAND} b")
def _(t):
    return band(t)


_GAPS = f"(select cam, abs(value - m) as d from {PIXELS} s join (select cam, median(value) as m from {PIXELS} s group by cam) q using (cam))"


@query(
    "x3_robust_threshold", ints="cam", reals="sigma threshold",
    sql=f"select cam, 1.4826e0 * median(d) as sigma, greatest(4 * 1.4826e0 * median(d), 50) as threshold from {_GAPS} g group by cam",
)
def _(t):
    return X.robust_threshold(t.pixels, 4.0, 50.0)


PEAKS = f"""(select * from (select p.cam, p.frame, p.row, p.col, p.value, max(q.value) as most from {DENSE} p join {DENSE} q
    on p.cam = q.cam and p.frame = q.frame and abs(p.row - q.row) <= 1 and abs(p.col - q.col) <= 1 where p.value > 220
    group by p.cam, p.frame, p.row, p.col, p.value) m where value >= most)"""


def peaks(t):
    return X.local_maxima(dense(t), 3, 220)


@query("x4_local_maxima", ints="cam frame row col value", sql=f"select * from {PEAKS} p")
def _(t):
    return peaks(t)


def suppressed_sql(source: str, radius2: float, ctes: str = "") -> str:
    """Greedy suppression, peak after peak: the twin of the tiles."""
    return f"""with recursive {ctes} p as materialized (select *, row_number() over (partition by cam, frame order by value desc, col, row) as i from {source} k),
        r as (select distinct cam, frame, cast(0 as bigint) as i, cast([] as struct(y bigint, x bigint)[]) as kept from p union all
          select r.cam, r.frame, p.i, case when len([k for k in kept if power(k.y - p.row, 2) + power(k.x - p.col, 2) <= {radius2}]) = 0
            then list_append(kept, {{'y': cast(p.row as bigint), 'x': cast(p.col as bigint)}}) else kept end
          from r join p on p.cam = r.cam and p.frame = r.frame and p.i = r.i + 1),
        l as (select cam, frame, unnest(arg_max(kept, i)) as k from r group by cam, frame)
        select p.cam, p.frame, p.row, p.col, p.value from l join p on l.cam = p.cam and l.frame = p.frame and l.k.y = p.row and l.k.x = p.col"""


@query("x5_suppress_peaks", ints="cam frame row col value", sql=suppressed_sql(PEAKS, 9))
def _(t):
    return X.suppress_peaks(peaks(t), 3.0)


def _log3(a: str, b: str) -> str:
    bend = f"(ln({a}) - 2 * ln(p.value) + ln({b}))"
    return f"case when {a} > 0 and {b} > 0 and {bend} <> 0 then greatest(least(0.5e0 * (ln({a}) - ln({b})) / {bend}, 0.5e0), -0.5e0) else 0 end"


def _at(name: str, dr: int, dc: int) -> str:
    return f"left join d {name} on p.cam = {name}.cam and p.frame = {name}.frame and {name}.row = p.row + {dr} and {name}.col = p.col + {dc}"


@query(
    "x6_subpixel_gauss3", ints="cam frame row col value", reals="x y",
    sql=f"""with d as materialized (select cam, frame, row, col, nullif(value, 0) as value from {DENSE} x)
        select p.cam, p.frame, p.row, p.col, p.value,
        p.col + case when p.row between 1 and 14 and p.col between 1 and 14 then {_log3('l.value', 'r.value')} else 0 end as x,
        p.row + case when p.row between 1 and 14 and p.col between 1 and 14 then {_log3('u.value', 'b.value')} else 0 end as y
        from {PEAKS} p {_at('l', 0, -1)} {_at('r', 0, 1)} {_at('u', -1, 0)} {_at('b', 1, 0)}""",
)
def _(t):
    return X.subpixel_gauss3(peaks(t), dense(t), SHAPE)


BRIGHT = f"""(select cam, max(case when r = greatest(floor(0.9e0 * c + 0.5e0), 1) then value end) as bright from (
    select cam, value, row_number() over (partition by cam order by value) as r, count(*) over (partition by cam) as c from {PEAKS} p) x group by cam)"""


@query(
    "x7_equalise_gain", ints="cam frame row col value",
    sql=f"""select cam, frame, row, col, floor(least(greatest(value - 0.5e0 * sigma, 0) * 200 / bright, 255) + 0.5e0) as value from {PIXELS} p
        join {BRIGHT} b using (cam) join (select cam, 1.4826e0 * median(d) as sigma from {_GAPS} g group by cam) s using (cam)""",
)
def _(t):
    gain = X.camera_gain(peaks(t), 200.0)
    return X.equalise_gain(t.pixels, gain, X.robust_threshold(t.pixels, 4.0, 50.0), 0.5, 255)


SIGMAS = f"""(with d as materialized (select * from {DENSE} x),
        b as (select * from {PEAKS} p),
        w as (select b.cam, b.frame, b.row, b.col, d.row - b.row as y, d.col - b.col as x, d.value - min(d.value) over (partition by b.cam, b.frame, b.row, b.col) as v
          from b join d on b.cam = d.cam and b.frame = d.frame and abs(d.row - b.row) <= 3 and abs(d.col - b.col) <= 3
          where b.row between 3 and 12 and b.col between 3 and 12),
        c as (select cam, frame, row, col, sum(x * v) / sum(v) as cx, sum(y * v) / sum(v) as cy from w group by 1, 2, 3, 4 having sum(v) > 0)
        select cam, frame, row, col, sqrt(sum((power(x - cx, 2) + power(y - cy, 2)) * v) / sum(v) / 2) as sigma from w join c using (cam, frame, row, col)
        group by cam, frame, row, col)"""


@query("x8_peak_sigma", ints="cam frame row col", reals="sigma", sql=f"select * from {SIGMAS} s")
def _(t):
    return X.peak_sigma(dense(t), peaks(t), SHAPE, 3)


@query(
    "c11b_seeding_crosscheck", texts="track_check nn_check", ints="cam contaminated",
    reals="mean_n std_n cv spacing_vox nn_px nn_vox sigma_px fwhm_px",
    sql=f"""with pk as materialized (select * from {PEAKS} p), c as (select cam, frame, count(*) as n from pk group by cam, frame),
        first as (select cam, min(frame) as frame from pk group by cam),
        near as (select a.cam, a.row, a.col, min(sqrt(power(a.row - b.row, 2) + power(a.col - b.col, 2))) as d from pk a join first using (cam, frame)
          join pk b on a.cam = b.cam and a.frame = b.frame and (a.row <> b.row or a.col <> b.col) group by a.cam, a.row, a.col),
        nn as (select cam, median(d) as nn_px from near group by cam),
        sg as (select cam, median(sigma) as sigma_px from {SIGMAS} s join first using (cam, frame) group by cam),
        b as (select cam, avg(n) as mean_n, stddev_samp(n) as std_n, stddev_samp(n) / avg(n) as cv from c group by cam),
        r as (select *, power(6000e0 / mean_n, 1e0 / 3) / 0.5e0 as spacing_vox, 0.1e0 * nn_px as nn_vox, 2.3548e0 * sigma_px as fwhm_px
          from b left join nn using (cam) left join sg using (cam))
        select *, case when cv > 0.15e0 then 1 else 0 end as contaminated, case when 1.6e0 / spacing_vox < 0.33e0 then 'OK' else 'WARN' end as track_check,
          case when nn_vox <= spacing_vox then 'OK' when nn_vox > spacing_vox then 'WARN' end as nn_check from r""",
)
def _(t):
    found = peaks(t)
    first = found.groupBy("cam").agg(F.min("frame").alias("frame"))
    sample = found.join(first, ["cam", "frame"], "left_semi")
    spots = sample.withColumn("pid", F.col("row") * SHAPE[1] + F.col("col")).select("cam", "frame", "pid", "row", "col")
    near = knn(spots, ["cam", "frame"], "pid", ["row", "col"], 1)
    widths = X.peak_sigma(dense(t), sample, SHAPE, 3)
    counts = found.groupBy("cam", "frame").agg(F.count(F.lit(1)).alias("n"))
    return seeding_report(
        counts, ["cam"], "n", box_mm=(20.0, 20.0, 15.0), voxel_mm=0.5, px_mm=0.05, fps=500.0, velocity=0.4, worst_rms_px=0.4,
        neighbours=near, widths=widths,
    ).withColumn("contaminated", F.col("contaminated").cast("int"))


def _chain_sql(k: float, floor: float, radius2: float, target: float) -> str:
    """The steps from raw frames to tracers one after the other."""
    fine1, fine2 = _blur_sql("r0", 0.7)
    coarse1, coarse2 = _blur_sql("r0", 2.0)
    maxima = """(select * from (select p.cam, p.frame, p.row, p.col, p.value, max(q.value) as most from {0} p join {0} q
        on p.cam = q.cam and p.frame = q.frame and abs(p.row - q.row) <= 1 and abs(p.col - q.col) <= 1 group by p.cam, p.frame, p.row, p.col, p.value) m where value >= most)"""
    return f"""with d0 as materialized (select * from {DENSE} x), g0 as (select cam, row, col, median(value) as background from d0 group by cam, row, col),
        r0 as materialized (select cam, frame, row, col, value - background as value from d0 join g0 using (cam, row, col)),
        f1 as materialized (select * from {fine1} x), c1 as materialized (select * from {coarse1} x),
        f2 as (select * from {fine2.format("f1")} x), c2 as (select * from {coarse2.format("c1")} x),
        d as materialized (select cam, frame, row, col, f2.value - c2.value as value from f2 join c2 using (cam, frame, row, col)),
        m0 as (select cam, median(value) as m from d group by cam),
        s0 as materialized (select cam, greatest({k} * 1.4826e0 * median(abs(value - m)), {floor}) as threshold from d join m0 using (cam) group by cam),
        o0 as materialized (select * from d where value > {floor}), o1 as materialized (select d.* from d join s0 using (cam) where value > threshold and value > {floor}),
        k0 as materialized (select * from {maxima.format("o0")} z), k1 as materialized (select * from {maxima.format("o1")} z),
        w0 as materialized ({suppressed_sql("k0", radius2)}), w1 as materialized ({suppressed_sql("k1", radius2)}),
        b0 as (select cam, max(case when i = greatest(floor(0.9e0 * c + 0.5e0), 1) then value end) as bright from (
          select cam, value, row_number() over (partition by cam order by value) as i, count(*) over (partition by cam) as c from w0) x group by cam)
        select p.cam, p.frame, p.row, p.col, p.value, s0.threshold, {target} / greatest(b0.bright, 2.220446049250313e-16) as gain,
        p.col + case when p.row between 1 and 14 and p.col between 1 and 14 then {_log3('l.value', 'r.value')} else 0 end as x,
        p.row + case when p.row between 1 and 14 and p.col between 1 and 14 then {_log3('u.value', 'b.value')} else 0 end as y
        from w1 p join s0 on s0.cam = p.cam left join b0 on b0.cam = p.cam {_at('l', 0, -1)} {_at('r', 0, 1)} {_at('u', -1, 0)} {_at('b', 1, 0)}"""


@query("x7b_detect_tracers", ints="cam frame row col", reals="value x y threshold gain", sql=_chain_sql(3.0, 5.0, 9, 200.0))
def _(t):
    return X.detect_tracers(t.pixels, SHAPE, sigma_bg=2.0, sigma_noise=0.7, k=3.0, floor=5.0, window=3, radius=3.0, target=200.0)


MASK = f"""(select cam, frame, row, col, value from (select cam * 100 + frame as g, * from {PIXELS} p where value > 0) x
    join {midpoint_quantile_sql(0.8, f'(select cam * 100 + frame as g, value from {PIXELS} p where value > 0)', 'g', 'value', 'cut')} c using (g) where value >= cut)"""


@query("x9_percentile_mask", ints="cam frame row col value", sql=f"select * from {MASK} m")
def _(t):
    return X.percentile_mask(t.pixels, 80)


@query(
    "x10_blobs", ints="cam frame blob area", reals="mean peak x y",
    sql=f"""with recursive p as materialized (select cam, frame, row, col, value, row * 16 + col as id from {MASK} m),
        e as materialized (select a.cam, a.frame, a.id as a, b.id as b from p a join p b on a.cam = b.cam and a.frame = b.frame
          and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 and a.id <> b.id),
        r as (select cam, frame, id as a, id as b from p union select r.cam, r.frame, r.a, e.b from r join e on r.cam = e.cam and r.frame = e.frame and r.b = e.a),
        l as (select cam, frame, a as id, min(b) as blob from r group by cam, frame, a)
        select cam, frame, blob, count(*) as area, avg(value) as mean, max(value) as peak, sum(col * value) / sum(value) as x,
          sum(row * value) / sum(value) as y from p join l using (cam, frame, id) group by cam, frame, blob having count(*) between 1 and 400""",
)
def _(t):
    return X.blobs(X.percentile_mask(t.pixels, 80), 16, 1, 400, tile=8)


@query(
    "x11_otsu_threshold", ints="cam frame threshold",
    sql=f"""with h as (select cam, frame, level, coalesce(n, 0) as n from (select * from (select distinct cam, frame from {PIXELS} p) f, (select unnest(range(256)) as level) l) every
          left join (select cam, frame, least(value, 255) as level, count(*) as n from {PIXELS} p where value between 0 and 256 group by 1, 2, 3) x using (cam, frame, level)),
        p as (select cam, frame, level, n / sum(n) over (partition by cam, frame) as p from h),
        c as (select *, sum(p) over o as w, sum(p * level) over o as mu, sum(p * level) over (partition by cam, frame) as mt from p
          window o as (partition by cam, frame order by level)),
        s as (select *, case when w * (1 - w) > 1e-12 then round(power(mt * w - mu, 2) / (w * (1 - w)), 9) end as s from c)
        select cam, frame, level as threshold from (select *, row_number() over (partition by cam, frame order by s desc, level) as r from s where s is not null) q where r = 1""",
)
def _(t):
    return X.otsu_threshold(t.pixels, ["cam", "frame"])

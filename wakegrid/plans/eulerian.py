"""Queries over binned samples: fields, stresses, profiles, fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import attach
from ..functions import scalars as P
from ..operators import binning as A
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import sequence as W
from ..session import cut
from .registry import query
from .views import (
    DT, FS, GRID, PIXELS, SAMPLES, SIGNAL, TOWER, TRACKS, X8, Y11, Z3, bin_sql, grid_sql, num,
)

BINS = "ix iy iz"
G = grid_sql()
MEANS = f"(select run, ix, iy, iz, count(*) as n, avg(u) as u, avg(v) as v, avg(w) as w from {G} g group by run, ix, iy, iz)"


@query("a1_uniform_bins", ints="ix iy iz n", sql=f"select ix, iy, iz, count(*) as n from {G} g group by ix, iy, iz")
def _(t):
    return A.with_bins(t.samples, GRID).groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"))


def cosine_sql(v: str, n: int) -> str:
    edges = A.cosine_edges(n)
    passed = " + ".join(f"(case when {num(e)} <= {v} then 1 else 0 end)" for e in edges)
    return f"case when {v} >= -1e0 and {v} <= 1e0 then least({passed}, {n}) end"


@query(
    "a2_cosine_bins", ints="bin n", reals="u",
    sql=f"""select bin, count(*) as n, avg(u) as u from (
        select u, {cosine_sql('(x / 25e0 - 1)', 12)} as bin from {SAMPLES} s) b group by bin""",
)
def _(t):
    rows = t.samples.withColumn("bin", A.cosine_bins(F.col("x") / 25.0 - 1, 12))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("u"))


@query(
    "a3_padded_bounds", ints="run", reals="lo_x hi_x lo_u hi_u",
    sql=f"""select run, min(x) - 0.05e0 * (max(x) - min(x)) as lo_x, max(x) + 0.05e0 * (max(x) - min(x)) as hi_x,
        min(u) - 0.05e0 * (max(u) - min(u)) as lo_u, max(u) + 0.05e0 * (max(u) - min(u)) as hi_u
        from {SAMPLES} s group by run""",
)
def _(t):
    return A.padded_bounds(t.samples, ["x", "u"], ["run"])


@query("a4_bin_means", ints="run ix iy iz n", reals="u v w", sql=MEANS)
def _(t):
    return A.bin_means(t.samples, GRID, ["u", "v", "w"], ["run"])


STRESS_SQL = f"""select ix, iy, iz, count(*) as n, avg(u) as u, avg(v) as v, avg(w) as w,
    covar_pop(u, u) as uu, covar_pop(v, v) as vv, covar_pop(w, w) as ww,
    covar_pop(u, v) as uv, covar_pop(u, w) as uw, covar_pop(v, w) as vw from {G} g group by ix, iy, iz"""


@query("a5_reynolds_stress", ints="ix iy iz n", reals="u v w uu vv ww uv uw vw", sql=STRESS_SQL)
def _(t):
    return A.reynolds_stress(t.samples, GRID)


@query("a6_tke", ints="ix iy iz", reals="tke",
       sql=f"select ix, iy, iz, 0.5e0 * (uu + vv + ww) as tke from ({STRESS_SQL}) s")
def _(t):
    return A.with_tke(A.reynolds_stress(t.samples, GRID))


VELOCITY_SQL = f"""(select track_id, frame, (x + x_n) / 2 as x, (y + y_n) / 2 as y, (z + z_n) / 2 as z,
    (x_n - x) / {DT} as u, (y_n - y) / {DT} as v, (z_n - z) / {DT} as w from (
        select *, lead(x) over o as x_n, lead(y) over o as y_n, lead(z) over o as z_n, lead(frame) over o as f_n
        from {TRACKS} t window o as (partition by track_id order by frame)) l where f_n = frame + 1)"""


def track_velocity(t):
    """Forward velocities of the tracks at segment mid-points."""
    v = W.forward_velocity(t.tracks, ["track_id"], "frame", ["x", "y", "z"], 1 / DT)
    return v.select(
        "track_id", "frame",
        *[F.col(f"{c}_mid").alias(c) for c in "xyz"],
        *[F.col(f"v_{c}").alias(n) for c, n in zip("xyz", "uvw")],
    )


# The flagship: raw tracks -> mid-point velocities -> padded grid -> bin means -> profile.
@query(
    "a7_plane_average", ints="iy bins", reals="u v w", digits=2,
    sql=f"""with v as {VELOCITY_SQL},
    b as (select min(x) - 0.05e0 * (max(x) - min(x)) as lo_x, max(x) + 0.05e0 * (max(x) - min(x)) as hi_x,
                 min(y) - 0.05e0 * (max(y) - min(y)) as lo_y, max(y) + 0.05e0 * (max(y) - min(y)) as hi_y from v),
    n as (select least(floor((x - lo_x) * 4 / (hi_x - lo_x)) + 1, 4) as ix,
                 least(floor((y - lo_y) * 9 / (hi_y - lo_y)) + 1, 9) as iy, u, v, w from v, b),
    m as (select ix, iy, avg(u) as u, avg(v) as v, avg(w) as w from n group by ix, iy)
    select iy, count(*) as bins, avg(u) as u, avg(v) as v, avg(w) as w from m group by iy""",
)
def _(t):
    v = cut(track_velocity(t))  # read twice: for the bounds of the grid and for its bins
    v = attach(v, A.padded_bounds(v, ["x", "y"]), [])
    numbered = v.withColumns(
        {f"i{c}": A.uniform_bins(c, F.col(f"lo_{c}"), F.col(f"hi_{c}"), n) for c, n in (("x", 4), ("y", 9))}
    )
    means = numbered.groupBy("ix", "iy").agg(*[F.avg(c).alias(c) for c in "uvw"])
    return means.groupBy("iy").agg(F.count(F.lit(1)).alias("bins"), *[F.avg(c).alias(c) for c in "uvw"])


@query(
    "a8_dispersive_flux", ints="run iy", reals="d_uu d_vv d_ww d_uv d_uw d_vw",
    sql=f"""with m as {MEANS}, p as (select *, avg(u) over o as pu, avg(v) over o as pv, avg(w) over o as pw
            from m window o as (partition by run, iy))
        select run, iy, avg((u-pu)*(u-pu)) as d_uu, avg((v-pv)*(v-pv)) as d_vv, avg((w-pw)*(w-pw)) as d_ww,
               avg((u-pu)*(v-pv)) as d_uv, avg((u-pu)*(w-pw)) as d_uw, avg((v-pv)*(w-pw)) as d_vw
        from p group by run, iy""",
)
def _(t):
    return A.dispersive_flux(A.bin_means(t.samples, GRID, ["u", "v", "w"], ["run"]), ["run", "iy"])


@query(
    "a9_sample_counts", ints="ix iy iz total least",
    sql=f"""select ix, iy, iz, sum(n) as total, min(n) as least from
        (select ix, iy, iz, count(*) as n from {G} g group by ix, iy, iz) b
        group by grouping sets ((ix, iy), (ix, iz), (iy))""",
)
def _(t):
    bins = A.bin_means(t.samples, GRID, [])
    return A.sample_counts(bins, [("ix", "iy"), ("ix", "iz"), ("iy",)], ["ix", "iy", "iz"])


@query(
    "a10_nearest_slice", ints="run ix iy iz n", reals="u",
    sql=f"""with m as {MEANS}, c as (select distinct run, iz, {num(Z3.lo)} + (iz - 0.5e0) * {num(Z3.width)} as zc from m),
        t as (select run, avg(zc) as z0 from c group by run),
        k as (select run, iz, row_number() over (partition by run order by abs(zc - z0), iz) as r from c join t using (run))
        select m.run, ix, iy, m.iz, n, u from m join k on m.run = k.run and m.iz = k.iz where r = 1""",
)
def _(t):
    return A.nearest_slice(A.bin_means(t.samples, GRID, ["u", "v", "w"], ["run"]), Z3, ["run"])


SWEEP = (4, 8, 16, 32)


@query(
    "a11_resolution_sweep", ints="bins ix iy n", reals="u v w uu vv ww uv uw vw",
    sql=f"""select bins, ix, iy, count(*) as n, avg(u) as u, avg(v) as v, avg(w) as w,
        var_pop(u) as uu, var_pop(v) as vv, var_pop(w) as ww,
        covar_pop(u, v) as uv, covar_pop(u, w) as uw, covar_pop(v, w) as vw
        from (select bins, iy, u, v, w, {bin_sql('x', X8.lo, X8.hi, 'bins')} as ix
              from {grid_sql((Y11,))} g, (select unnest([{', '.join(map(str, SWEEP))}]) as bins) r) s
        where ix is not null group by bins, ix, iy""",
)
def _(t):
    return A.resolution_sweep(t.samples, X8, SWEEP, (Y11,))


SWEPT = f"""(select bins, ix, iy, avg(u) as u, avg(v) as v, avg(w) as w, 0.5e0 * (var_pop(u) + var_pop(v) + var_pop(w)) as tke
    from (select bins, iy, u, v, w, {bin_sql('x', X8.lo, X8.hi, 'bins')} as ix
      from {grid_sql((Y11,))} g, (select unnest([{', '.join(map(str, SWEEP))}]) as bins) r) s where ix is not null group by bins, ix, iy)"""


def sweep_planes(t):
    return A.sweep_profiles(A.resolution_sweep(t.samples, X8, SWEEP, (Y11,)), "iy")


@query(
    "a11b_sweep_profiles", ints="bins iy n", reals="u v w tke d_uu d_uv",
    sql=f"""with p as (select *, avg(u) over o as pu, avg(v) over o as pv from {SWEPT} m window o as (partition by bins, iy))
        select bins, iy, count(*) as n, avg(u) as u, avg(v) as v, avg(w) as w, avg(tke) as tke, avg((u-pu)*(u-pu)) as d_uu,
          avg((u-pu)*(v-pv)) as d_uv from p group by bins, iy""",
)
def _(t):
    return sweep_planes(t)


@query(
    "a11c_sweep_errors", ints="bins", reals="l2_u linf_u l2_tke linf_tke",
    sql=f"""with p as (select bins, iy, avg(u) as u, avg(tke) as tke from {SWEPT} m group by bins, iy),
        r as (select iy, u as ru, tke as rt from p where bins = {max(SWEEP)})
        select bins, sqrt(sum(power(u-ru,2)) / sum(ru*ru)) as l2_u, max(abs(u-ru)) / max(abs(ru)) as linf_u,
          sqrt(sum(power(tke-rt,2)) / sum(rt*rt)) as l2_tke, max(abs(tke-rt)) / max(abs(rt)) as linf_tke from p join r using (iy) group by bins""",
)
def _(t):
    return A.sweep_errors(sweep_planes(t), "iy", ["u", "tke"])


@query(
    "a12_profile_moments", ints="run height n", reals="u v w uu vv ww uv tke",
    sql=f"""select record as run, height, count(*) as n, avg(u) as u, avg(v) as v, avg(w) as w, var_pop(u) as uu,
        var_pop(v) as vv, var_pop(w) as ww, covar_pop(u, v) as uv, 0.5e0 * (var_pop(u) + var_pop(v) + var_pop(w)) as tke
        from {TOWER} t group by record, height""",
)
def _(t):
    return A.profile_moments(t.tower, "height", ["record"]).withColumnRenamed("record", "run")


@query(
    "a13_group_stats", texts="case_id", ints="n", reals="mean std min max pct_valid",
    sql=f"""select case_id, count(g) as n, avg(g) as mean, stddev_samp(g) as std, min(g) as min, max(g) as max,
        100e0 * count(g) / count(*) as pct_valid
        from (select case_id, case when u > 0.5e0 then u end as g from {SIGNAL} s) x group by case_id""",
)
def _(t):
    return A.group_stats(t.signal, ["case_id"], "u", F.col("u") > 0.5)


@query(
    "a14_skewness_flatness", texts="case_id", reals="skew_u flat_u skew_v flat_v",
    sql=f"""with m as (select *, avg(u) over o as mu, avg(v) over o as mv from {SIGNAL} s
            window o as (partition by case_id))
        select case_id, avg(power(u-mu,3)) / power(avg(power(u-mu,2)), 1.5e0) as skew_u,
          avg(power(u-mu,4)) / power(avg(power(u-mu,2)), 2) as flat_u,
          avg(power(v-mv,3)) / power(avg(power(v-mv,2)), 1.5e0) as skew_v,
          avg(power(v-mv,4)) / power(avg(power(v-mv,2)), 2) as flat_v from m group by case_id""",
)
def _(t):
    return A.skewness_flatness(t.signal, ["u", "v"], ["case_id"])


@query(
    "a15_normalised_stress", texts="case_id", reals="uu vv uv",
    sql=f"""select case_id, var_pop(u) / power(avg(u), 2) as uu, var_pop(v) / power(avg(u), 2) as vv,
        covar_pop(u, v) / power(avg(u), 2) as uv from {SIGNAL} s group by case_id""",
)
def _(t):
    return A.normalised_stress(t.signal, ["case_id"])


@query(
    "a16_histogram", ints="cam bin n",
    sql=f"""select cam, bin, count(*) as n from (select cam, {bin_sql('value', 0, 400, 20)} as bin from {PIXELS} p) b
        where bin is not null group by cam, bin""",
)
def _(t):
    return A.histogram(t.pixels, "value", 0, 400, 20, ["cam"])


def midpoint_quantile_sql(p: float, source: str, by: str, value: str, name: str) -> str:
    """Percentile at position p*n + 1/2 by explicit ranks."""
    return f"""(select {by}, max(case when r = floor(h) then {value} end) + (max(h) - floor(max(h))) *
        (max(case when r = least(floor(h) + 1, c) then {value} end) - max(case when r = floor(h) then {value} end)) as {name}
        from (select {by}, {value}, row_number() over (partition by {by} order by {value}) as r,
              count(*) over (partition by {by}) as c,
              least(greatest(count(*) over (partition by {by}) * {num(p)} + 0.5e0, 1e0), count(*) over (partition by {by})) as h
              from {source} src) ranked group by {by})"""


@query(
    "a16b_intensity_stats", ints="cam n", reals="min max mean std saturated median p95",
    sql=f"""with p as (select * from {PIXELS} px where value > 0)
        select cam, n, min, max, mean, std, saturated, median, p95 from
        (select cam, count(*) as n, min(value) as min, max(value) as max, avg(value) as mean, stddev_samp(value) as std,
            100e0 * avg(case when value >= 255 then 1e0 else 0e0 end) as saturated from p group by cam) s
        join {midpoint_quantile_sql(0.5, 'p', 'cam', 'value', 'median')} q using (cam)
        join {midpoint_quantile_sql(0.95, 'p', 'cam', 'value', 'p95')} r using (cam)""",
)
def _(t):
    return A.intensity_stats(t.pixels, "value", 255, ["cam"])


#: Calibration targets that are polynomials of the voltages, so that a fit has known values and no residual.
HOT_WIRE = {"speed": "1 + 0.5e0 * {0} * {0} * {1} - 0.2e0 * {1} * {1} * {1}", "angle": "2 * {0} - 3 * {1} + 0.1e0 * {0} * {0} * {1} * {1}"}
VOLTS = f"(select case_id, n, sqrt(1 + sqrt(u + 0.3e0 * v)) as e1, sqrt(1 + sqrt(v + 0.3e0 * u)) as e2 from {SIGNAL} sg)"


def hot_wire_targets():
    return {name: F.expr(text.format("e1", "e2")) for name, text in HOT_WIRE.items()}


def hot_wire_volts(t):
    """Two sensor voltages that depend smoothly on the velocity components."""
    return t.signal.withColumns(
        {"e1": F.sqrt(1 + F.sqrt(F.col("u") + 0.3 * F.col("v"))), "e2": F.sqrt(1 + F.sqrt(F.col("v") + 0.3 * F.col("u")))}
    )


def _fits_sql(pick: str) -> str:
    return " union all ".join(f"select case_id, '{name}' as target, {pick.format(text.format('c1', 'c2'), text.format('m1', 'm2'))} from r" for name, text in HOT_WIRE.items())


@query(
    "a17_poly_calibration_fit", texts="case_id target", reals="at_centre at_corner", digits=2,
    sql=f"""with r as (select case_id, (min(e1) + max(e1)) / 2 as c1, (min(e2) + max(e2)) / 2 as c2, max(e1) as m1, max(e2) as m2 from {VOLTS} v group by case_id)
        {_fits_sql('{0} as at_centre, {1} as at_corner')}""",
)
def _(t):
    fit = A.poly_calibration_fit(hot_wire_volts(t), "e1", "e2", hot_wire_targets(), ["case_id"])
    corner = F.aggregate("coeffs", F.lit(0.0), lambda s, x: s + x)
    return fit.withColumns({"at_centre": F.element_at("coeffs", 1), "at_corner": corner})


@query(
    "a18_fit_errors", texts="case_id target", reals="rel_pct absolute", digits=3,
    sql=f"with r as (select distinct case_id, 0 as c1, 0 as c2, 0 as m1, 0 as m2 from {VOLTS} v) {_fits_sql('0e0 as rel_pct, 0e0 as absolute')}",
)
def _(t):
    rows = hot_wire_volts(t)
    fit = A.poly_calibration_fit(rows, "e1", "e2", hot_wire_targets(), ["case_id"])
    targets = hot_wire_targets()
    actual = F.when(F.col("target") == "speed", targets["speed"]).otherwise(targets["angle"])
    both = rows.join(fit, "case_id").withColumns({"actual": actual, "predicted": A.predict_poly("e1", "e2")})
    return A.fit_errors(both, "predicted", "actual", ["case_id", "target"])


@query("a19_singular_energy", ints="k", reals="sigma frobenius spectral energy")
def _(t):
    return A.singular_energy(t.embeddings, "embedding", 64, (1, 2, 4, 8, 16, 32, 64))


_GRAM = ", ".join(f"sum(cast(embedding[{i}] as double) * embedding[{j}]) as g{i}{j}" for i, j in ((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)))


@query(
    "a19b_singular_energy_by_label", ints="label k", reals="sigma frobenius spectral energy",
    sql=f"""with g as (select label, {_GRAM} from embeddings group by label), t as (select *, (g11 + g22 + g33) / 3 as m from g),
        p as (select *, sqrt((power(g11 - m, 2) + power(g22 - m, 2) + power(g33 - m, 2) + 2 * (g12 * g12 + g13 * g13 + g23 * g23)) / 6) as p from t),
        r as (select *, ((g11 - m) * ((g22 - m) * (g33 - m) - g23 * g23) - g12 * (g12 * (g33 - m) - g23 * g13) + g13 * (g12 * g23 - (g22 - m) * g13)) / (2 * p * p * p) as r from p),
        a as (select *, acos(least(greatest(r, -1), 1)) / 3 as a from r),
        e as (select label, [m + 2 * p * cos(a), m + 2 * p * cos(a - 2 * pi() / 3), m + 2 * p * cos(a + 2 * pi() / 3)] as e from a)
        select label, k, sqrt(e[k]) as sigma, sqrt(list_sum(e[k + 1:])) as frobenius, sqrt(e[k + 1]) as spectral, list_sum(e[:k]) / list_sum(e) as energy
        from e, (values (1), (2)) as ks(k)""",
)
def _(t):
    """The three eigenvalues of a 3x3 matrix have a closed form, which the twin uses."""
    short = t.embeddings.select("label", F.slice("embedding", 1, 3).alias("embedding"))
    return A.singular_energy(short, "embedding", 3, (1, 2), ["label"])


@query(
    "a20_simpson_trapezoid", texts="case_id", reals="trapezoid simpson",
    sql=f"""with e as (select case_id, max(n) as m from {SIGNAL} s group by case_id)
        select case_id, {num(1 / FS)} * sum(case when n = 0 or n = m then 0.5e0 else 1e0 end * u) as trapezoid,
          case when max(m) % 2 = 0 then {num(1 / FS)} / 3 *
            sum(case when n = 0 or n = m then 1e0 when n % 2 = 1 then 4e0 else 2e0 end * u) end as simpson
        from {SIGNAL} s join e using (case_id) group by case_id""",
)
def _(t):
    return A.simpson_trapezoid(t.signal.withColumn("t", F.col("n") / FS), ["case_id"], "t", "u", "n")


@query(
    "a21_extreme_with_error", ints="height", reals="highest highest_se lowest lowest_se",
    sql=f"""with m as (select height, n % 50 as k, avg(u) as mu, stddev_samp(u) as sd from {TOWER} t group by height, n % 50)
        select height, max(mu) as highest, arg_max(sd, mu) / sqrt(5) as highest_se, min(mu) as lowest,
          arg_min(sd, mu) / sqrt(5) as lowest_se from m group by height""",
)
def _(t):
    curve = t.tower.groupBy("height", (F.col("n") % 50).alias("k")).agg(
        F.avg("u").alias("mu"), F.stddev_samp("u").alias("sd")
    )
    return A.extreme_with_error(curve, ["height"], "k", "mu", "sd", 5)


# -------------------------------------------------------------- joins on bins


@query(
    "j1_attach_bin_mean", ints="run l_orderkey l_linenumber l_partkey l_suppkey", reals="u_p w_p",
    sql=f"""with m as {MEANS} select s.run, l_orderkey, l_linenumber, l_partkey, l_suppkey, s.u - m.u as u_p, s.w - m.w as w_p
        from {G} s join m on s.run = m.run and s.ix = m.ix and s.iy = m.iy and s.iz = m.iz""",
)
def _(t):
    return J.attach_bin_mean(t.samples, GRID, ["u", "w"], ["run"])


PROFILE = f"(select record, height, avg(u) as u, avg(v) as v from {TOWER} tw group by record, height)"
HEIGHTS = f"(select *, l_orderkey % 10 as record, 2.5e0 * x as v0 from {SAMPLES} sm)"


def tower_profile(t):
    """Mean wind of every record by height."""
    return t.tower.groupBy("record", "height").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))


def sample_heights(t):
    """Every sample asks the profile of one record."""
    return t.samples.withColumns({"h": 2.5 * F.col("x"), "record": F.col("l_orderkey") % 10})


@query(
    "j2_interp_linear", ints="l_orderkey l_linenumber l_partkey l_suppkey", reals="u_at",
    sql=f"""with n as (select record, height as h0, u as a, lead(height) over o as h1, lead(u) over o as b,
            row_number() over o as i, count(*) over (partition by record) as m from {PROFILE} p window o as (partition by record order by height))
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, a + (v0 - h0) / (h1 - h0) * (b - a) as u_at
        from {HEIGHTS} s left join n on s.record = n.record and h1 is not null and (i = 1 or v0 >= h0) and (i = m - 1 or v0 < h1)""",
)
def _(t):
    return J.interp_linear(sample_heights(t), "h", tower_profile(t), "height", ["u"], ["record"])


def pchip_sql(table: str, x: str, y: str, by: str = "") -> str:
    """Intervals with end slopes of the shape-preserving cubic."""
    part = f"partition by {by}" if by else ""
    lead_by = f"{by}," if by else ""
    sign = "(case when {0} > 0 then 1 when {0} < 0 then -1 else 0 end)".format
    def end(h0, d0, h1, d1):
        raw = f"((2*{h0}+{h1})*{d0} - {h0}*{d1}) / ({h0}+{h1})"
        return f"""case when {h1} is null then {d0} when {sign(raw)} <> {sign(d0)} then 0
            when {sign(d0)} <> {sign(d1)} and abs({raw}) > 3*abs({d0}) then 3*{d0} else {raw} end"""
    return f"""(with g as (select {lead_by} {x} as x0, {y} as y0, lead({x}) over o - {x} as h,
          (lead({y}) over o - {y}) / (lead({x}) over o - {x}) as d from {table} tb window o as ({part} order by {x})),
        k as (select *, lag(h) over o as hp, lag(d) over o as dp, lead(h) over o as hn, lead(d) over o as dn,
          lag(h, 2) over o as hq, lag(d, 2) over o as dq, row_number() over o as i,
          count(*) over ({part}) as m from g window o as ({part} order by x0)),
        s as (select *, case when hp is null then {end('h', 'd', 'hn', 'dn')} when h is null then {end('hp', 'dp', 'hq', 'dq')}
          when dp * d <= 0 then 0 else (3*h + 3*hp) / ((2*h + hp) / dp + (h + 2*hp) / d) end as sl from k)
        select {lead_by} x0, lead(x0) over o as x1, y0, h, d, sl as m0, lead(sl) over o as m1, i, m from s
        window o as ({part} order by x0))"""


CUBIC = "y0 + (v - x0) * (m0 + (v - x0) * ((3*d - 2*m0 - m1) / h + (v - x0) * (m0 - 2*d + m1) / (h*h)))"


@query(
    "j3_interp_pchip", ints="l_orderkey l_linenumber l_partkey l_suppkey", reals="u_at",
    sql=f"""with n as {pchip_sql(PROFILE, 'height', 'u', 'record')}
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, {CUBIC} as u_at
        from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, record, v0 as v from {HEIGHTS} sh) s
        left join n on s.record = n.record and x1 is not null and (i = 1 or v >= x0) and (i = m - 1 or v < x1)""",
)
def _(t):
    return J.interp_pchip(sample_heights(t), "h", tower_profile(t), "height", ["u"], ["record"])


REF = f"(select z as y, avg(u) as u, avg(v) as v from {SAMPLES} r group by z)"


@query(
    "j11_compare_profiles", ints="run iy", reals="u u_ref err_u",
    sql=f"""with b as (select run, iy, avg(u) as u from {grid_sql((Y11,))} g group by run, iy),
        n as {pchip_sql(REF, 'y', 'u')},
        c as (select *, {num(Y11.lo)} + (iy - 0.5e0) * {num(Y11.width)} as v from b)
        select run, iy, u, {CUBIC} as u_ref, u - ({CUBIC}) as err_u from c
        join n on x1 is not null and (i = 1 or v >= x0) and (i = m - 1 or v < x1)""",
)
def _(t):
    bins = A.bin_means(t.samples, (Y11,), ["u"], ["run"])
    ref = t.samples.groupBy(F.col("z").alias("y")).agg(F.avg("u").alias("u"))
    return J.compare_profiles(bins, ref, Y11, ["u"], ["run"][:0])


@query(
    "f2_in_domain", ints="run n",
    sql=f"select run, count(*) as n from (select run, {bin_sql('x', 5, 40, 7)} as i from {SAMPLES} s) b where i is not null group by run",
)
def _(t):
    return A.with_bins(t.samples, [A.Axis("x", 5, 40, 7)]).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f10_min_samples", ints="run ix iy iz n", sql=f"select * from {MEANS} m where n >= 25",
)
def _(t):
    return Q.min_samples(A.bin_means(t.samples, GRID, ["u"], ["run"]), 25)

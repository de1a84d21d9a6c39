"""Queries over ordered tracks and records, and their quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import ordinal, top_k
from ..functions import scalars as P
from ..operators import joins as J
from ..operators import lagrangian as L
from ..operators import quality as Q
from ..operators import sequence as W
from ..sources import tables as ST
from ..sources import tracks as S
from .eulerian import VELOCITY_SQL, midpoint_quantile_sql, pchip_sql, CUBIC, track_velocity
from .registry import query
from .views import DT, GAPPY, OBS, SAMPLES, SCADA, SIGNAL, TOWER, TRACKS, bin_sql, num

TRACK = ["track_id"]


# --------------------------------------------------------------------- sources


@query(
    "s1_scale_tracks", ints="track_id frame", reals="x y z t",
    sql=f"""select track_id, frame, x * 1e-3 as x, y * 1e-3 as y, z * 1e-3 as z,
        (frame - (select min(frame) from {TRACKS} m)) / 600e0 as t from {TRACKS} tr""",
)
def _(t):
    return S.scale_tracks(t.tracks, 600, 1e-3, ["x", "y", "z"])


@query(
    "s2_melt_wide_tracks", ints="vec_id frame", reals="x y z w",
    sql="""select vec_id, k - 1 as frame, cast(embedding[k] as double) as x, cast(embedding[k + 16] as double) as y,
        cast(embedding[k + 32] as double) as z, cast(embedding[k + 48] as double) as w
        from embeddings, (select unnest(range(1, 17)) as k) r where embedding[k] >= -0.1""",
)
def _(t):
    e = F.transform("embedding", lambda v: v.cast("double"))
    wide = t.embeddings.withColumn("e", e).select(
        "vec_id",
        F.transform(F.slice("e", 1, 16), lambda v: F.when(v >= F.lit(-0.1).cast("float"), v).otherwise(F.lit(float("nan")))).alias("x"),
        F.slice("e", 17, 16).alias("y"),
        F.slice("e", 33, 16).alias("z"),
        F.slice("e", 49, 16).alias("w"),
    )
    return S.melt_wide_tracks(wide, ["vec_id"], ("x", "y", "z", "w"))


@query(
    "s3_index_tracks", ints="track_id column_index row_index",
    sql=f"""select track_id, dense_rank() over (order by track_id) - 1 as column_index,
        frame - min(frame) over () as row_index from {GAPPY} g""",
)
def _(t):
    return S.index_tracks(t.gappy)


@query(
    "s13_filename_fields", texts="part6", ints="event_id frame_no", reals="delay",
    sql="""select event_id, cast(round(value) as bigint) as delay, 'p' || cast(user_id % 9 as varchar) as part6, event_id % 1000 as frame_no
        from events""",
)
def _(t):
    e = t.events
    name = F.concat(
        F.lit("/data/run_a_b_c_delay="), F.round("value").cast("bigint").cast("string"), F.lit("_p"),
        (F.col("user_id") % 9).cast("string"), F.lit("_img"), F.lpad((F.col("event_id") % 1000).cast("string"), 4, "0"), F.lit(".tif"),
    )
    return e.select("event_id", *[c.alias(n) for n, c in ST.filename_fields(name).items()])


AXES = {"x": (0.0, 3.0, 4), "y": (-1.0, 1.0, 9), "z": (0.0, 1.0, 6)}


@query(
    "s14_query_grid", ints="node n", reals="x y z u",
    sql=f"""with g as (select i * 54 + j * 6 + k as node, i * 1e0 as x, -1 + j * 0.25e0 as y, k * 0.2e0 as z
          from (select unnest(range(4)) as i) a, (select unnest(range(9)) as j) b, (select unnest(range(6)) as k) c),
        s as (select cast(l_partkey % 216 as bigint) as node, count(*) as n, avg(u) as u from {SAMPLES} sm group by 1)
        select node, n, x, y, z, u from g left join s using (node)""",
)
def _(t):
    seen = t.samples.groupBy((F.col("l_partkey") % 216).alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("u").alias("u")
    )
    return S.query_grid(t.spark, AXES).join(seen, "node", "left")


@query(
    "s15_label_components", texts="name", ints="vec_id point component", reals="value",
    sql="""select vec_id, (k - 1) // 9 as point, (k - 1) % 9 as component,
        ['duxdx','duxdy','duxdz','duydx','duydy','duydz','duzdx','duzdy','duzdz'][(k - 1) % 9 + 1] as name,
        cast(embedding[k] as double) as value from embeddings, (select unnest(range(1, 64)) as k) r
        union all select vec_id, 0, 0, 'p', cast(embedding[64] as double) from embeddings""",
)
def _(t):
    flat = t.embeddings.withColumns({"flat": F.slice("embedding", 1, 63), "rest": F.slice("embedding", 64, 1)})
    gradients = S.label_components(flat, ["vec_id"], "flat", "gradient")
    return gradients.unionByName(S.label_components(flat, ["vec_id"], "rest", "field", "scalar"))


# -------------------------------------------------------------------- sequence


@query("w1_forward_velocity", ints="track_id frame", reals="x y z u v w", digits=3, sql=f"select * from {VELOCITY_SQL} v")
def _(t):
    return track_velocity(t)


GRADIENT = f"""(select *, (coalesce(lead(x) over o, x) - coalesce(lag(x) over o, x)) / nullif(st, 0) as d_x,
      (coalesce(lead(y) over o, y) - coalesce(lag(y) over o, y)) / nullif(st, 0) as d_y,
      (coalesce(lead(z) over o, z) - coalesce(lag(z) over o, z)) / nullif(st, 0) as d_z
    from (select *, (coalesce(lead(frame) over o, frame) - coalesce(lag(frame) over o, frame)) * {DT}e0 as st
          from {{src}} tr window o as (partition by track_id order by frame)) s
    window o as (partition by track_id order by frame))"""


@query("w2_central_gradient", ints="track_id frame", reals="d_x d_y d_z", digits=3,
       sql=f"select * from {GRADIENT.format(src=TRACKS)} g")
def _(t):
    return W.central_gradient(t.tracks, TRACK, "frame", ["x", "y", "z"], DT)


@query(
    "w3_midpoint_position", ints="track_id frame", reals="x y z",
    sql=f"""select track_id, frame, (x + x_n) / 2 as x, (y + y_n) / 2 as y, (z + z_n) / 2 as z from (
        select *, lead(x) over o as x_n, lead(y) over o as y_n, lead(z) over o as z_n, lead(frame) over o as f_n
        from {GAPPY} t window o as (partition by track_id order by frame)) l where f_n = frame + 1""",
)
def _(t):
    return W.midpoint_position(t.gappy, TRACK, "frame", ["x", "y", "z"])


SEGMENT = f"""(select track_id, frame, x, y, z from (select *, count(*) over (partition by track_id, g) as c from (
      select *, g = min(g) over (partition by track_id) as lead_run from (
        select *, frame - row_number() over (partition by track_id order by frame) as g from {GAPPY} gp) a) b
      where lead_run) c where c >= 10)"""


@query("w4_first_contiguous_segment", ints="track_id frame", reals="x", sql=f"select * from {SEGMENT} s")
def _(t):
    return W.first_contiguous_segment(t.gappy, TRACK, "frame", 10)


@query(
    "w5_compact", ints="track_id frame n",
    sql=f"select track_id, frame, row_number() over (partition by track_id order by frame) - 1 as n from {GAPPY} g",
)
def _(t):
    return W.compact(t.gappy, TRACK, "frame", ["x", "y", "z"])


@query(
    "w6_moving_mean", ints="record height n", reals="mm_u mm_w",
    sql=f"""select record, height, n, avg(u) over o as mm_u, avg(w) over o as mm_w from {TOWER} t
        window o as (partition by record, height order by n rows between 10 preceding and 9 following)""",
)
def _(t):
    return W.moving_mean(t.tower, ["record", "height"], "n", ["u", "w"], 20)


@query(
    "w7_fluctuation", texts="case_id", ints="n", reals="u_p v_p",
    sql=f"""select case_id, n, u - avg(u) over (partition by case_id) as u_p, v - avg(v) over (partition by case_id) as v_p
        from {SIGNAL} s""",
)
def _(t):
    return W.fluctuation(t.signal, ["case_id"], ["u", "v"])


LEVEL_MEANS = f"(select record, height, avg(u) as u from {TOWER} tw group by record, height)"
LEVEL_GRADIENT = f"""(select *, (coalesce(lead(u) over o, u) - coalesce(lag(u) over o, u))
    / (coalesce(lead(height) over o, height) - coalesce(lag(height) over o, height)) as du
    from {LEVEL_MEANS} m window o as (partition by record order by height))"""


@query("w8_vertical_gradient", ints="record height", reals="du", digits=6, sql=f"select * from {LEVEL_GRADIENT} g")
def _(t):
    levels = t.tower.groupBy("record", "height").agg(F.avg("u").alias("u"))
    return W.vertical_gradient(levels, ["record"], "height", "u", "du")


@query(
    "w9_peak_rms", ints="track_id n_peak n_rest", reals="rms_peak rms_rest",
    sql=f"""with m as (select *, max(x) over (partition by track_id) as top,
          first_value(frame) over (partition by track_id order by x desc, frame) as pk from {TRACKS} t),
        e as (select *, max(case when frame < pk and not x > 0.25e0 * top then frame end) over (partition by track_id) as lo,
          min(case when frame > pk and not x > 0.25e0 * top then frame end) over (partition by track_id) as hi from m),
        f as (select *, x > 0.25e0 * top and frame > coalesce(lo, -1) and frame < coalesce(hi, 1e18) as inside from e)
        select track_id, count(case when inside then 1 end) as n_peak, count(case when not inside then 1 end) as n_rest,
          sqrt(avg(case when inside then x * x end)) as rms_peak, sqrt(avg(case when not inside then x * x end)) as rms_rest
        from f group by track_id""",
)
def _(t):
    return W.peak_rms(t.tracks, TRACK, "frame", "x", 0.25)


@query(
    "w10_cumulative_sum", texts="case_id", ints="n", reals="cum_u", digits=2,
    sql=f"select case_id, n, sum(u) over (partition by case_id order by n) as cum_u from {SIGNAL} s",
)
def _(t):
    return W.cumulative_sum(t.signal, ["case_id"], "n", ["u"], size=512)


@query(
    "w11_rank_points", ints="frame camera idx rank",
    sql=f"""select frame, camera, idx, row_number() over (partition by frame, camera order by radius desc, idx) as rank from (
        select *, row_number() over (partition by frame, camera order by metric desc, idx) as r from {OBS} o) b where r <= 2""",
)
def _(t):
    return W.rank_points(t.obs, ["frame", "camera"], "metric", "radius", "idx")


@query(
    "w12_first_below", ints="track_id first",
    sql=f"select track_id, coalesce(min(case when x < 5 then frame end), max(frame)) as first from {TRACKS} t group by track_id",
)
def _(t):
    return W.first_below(t.tracks, TRACK, "frame", "x", 5.0)


@query(
    "w13_cumulative_trapezoid", ints="track_id frame", reals="integral",
    sql=f"""select track_id, frame, sum(coalesce(a, 0)) over (partition by track_id order by frame) as integral from (
        select *, {DT}e0 * (x + lag(x) over (partition by track_id order by frame)) / 2 as a from {TRACKS} t) p""",
)
def _(t):
    rows = t.tracks.withColumn("t", F.col("frame") * DT)
    return W.cumulative_trapezoid(rows, TRACK, "frame", "t", "x")


@query(
    "w13b_trapezoid_upto", ints="track_id", reals="area",
    sql=f"""select track_id, coalesce(sum(a), 0e0) as area from (
        select *, {DT}e0 * (x + lag(x) over (partition by track_id order by frame)) / 2 as a,
          coalesce(min(case when x < 5 then frame end) over (partition by track_id), 1000000) as stop from {TRACKS} t) p
        where frame <= stop group by track_id""",
)
def _(t):
    first = W.first_below(t.tracks, TRACK, "frame", "x", 5.0, "stop")
    rows = t.tracks.withColumn("t", F.col("frame") * DT).join(first, "track_id")
    return W.trapezoid(rows, TRACK, "frame", "t", "x", "area", "stop")


@query(
    "w14_detrend_linear", texts="case_id", ints="n", reals="u_d",
    sql=f"""with f as (select case_id, regr_slope(u, n) as s, regr_intercept(u, n) as i from {SIGNAL} x group by case_id)
        select case_id, n, u - (s * n + i) as u_d from {SIGNAL} x join f using (case_id)""",
)
def _(t):
    return W.detrend_linear(t.signal, ["case_id"], "n", ["u"])


@query(
    "w15_even_subsample", texts="case_id", ints="n",
    sql=f"""with c as (select case_id, count(*) as k from {SIGNAL} s group by case_id),
        o as (select case_id, cast(floor(1 + j * (k - 1) / 39e0 + 0.5e0) as bigint) - 1 as n from c, (select unnest(range(40)) as j) r)
        select distinct case_id, n from o""",
)
def _(t):
    return W.even_subsample(t.signal, ["case_id"], "n", 40)


@query("w15b_decimated", texts="case_id", ints="n", reals="u", sql=f"select * from {SIGNAL} s where n % 7 = 0")
def _(t):
    return W.decimated(t.signal, "n", 7)


def _filtered_sql(source: str, name: str, sections) -> str:
    """One pass of a cascade of second-order sections over (case_id, e, x), sample after sample.

    Each section keeps two numbers and starts in the steady state of the first value.
    """
    states, moves, first = [], [], []
    x, x0 = "p.x", "x"
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        y = f"({num(b0)} * {x} + r.s{k})"
        states += [f"s{k}", f"z{k}"]
        moves += [f"{num(b1)} * {x} - {num(a1)} * {y} + r.z{k} as s{k}", f"{num(b2)} * {x} - {num(a2)} * {y} as z{k}"]
        y0 = f"({num((b0 + b1 + b2) / (1 + a1 + a2))} * {x0})"
        steady = [f"{num(b1)} * {x0} - {num(a1)} * {y0} + {num(b2)} * {x0} - {num(a2)} * {y0}", f"{num(b2)} * {x0} - {num(a2)} * {y0}"]
        first += [f"{steady[0]} as s{k}", f"{steady[1]} as z{k}"]
        x, x0 = y, y0
    return f"""{name}_p as materialized (select * from {source}),
        {name} as (select case_id, cast(-1 as bigint) as e, cast(0 as double) as y, {", ".join(first)} from {name}_p where e = 0
          union all select p.case_id, p.e, {x} as y, {", ".join(moves)} from {name} r join {name}_p p on p.case_id = r.case_id and p.e = r.e + 1)"""


def _zero_phase_sql(order: int, fc: float, fs: float) -> str:
    sections = [tuple(map(float, s)) for s in W.butterworth_sections(order, fc, fs)]
    pad = 3 * order
    return f"""with recursive s as materialized (select case_id, n, u, max(n) over (partition by case_id) + 1 as m,
          first_value(u) over (partition by case_id order by n) as a, first_value(u) over (partition by case_id order by n desc) as b from {SIGNAL} s),
        x as materialized (select case_id, n + {pad} as e, u as x from s where m > {pad}
          union all select case_id, {pad} - n, 2 * a - u from s where m > {pad} and n between 1 and {pad}
          union all select case_id, 2 * (m - 1) - n + {pad}, 2 * b - u from s where m > {pad} and n between m - 1 - {pad} and m - 2),
        {_filtered_sql("x", "forth", sections)},
        turned as materialized (select f.case_id, t.m + {2 * pad - 1} - f.e as e, f.y as x from forth f join (select distinct case_id, m from s) t using (case_id) where f.e >= 0),
        {_filtered_sql("turned", "back", sections)},
        done as (select f.case_id, t.m + {pad - 1} - f.e as n, f.y as smooth from back f join (select distinct case_id, m from s) t using (case_id) where f.e >= 0)
        select s.case_id, s.n, coalesce(d.smooth, case when s.m <= {pad} then s.u end) as smooth from s left join done d on d.case_id = s.case_id and d.n = s.n"""


@query("w16_zero_phase_lowpass", texts="case_id", ints="n", reals="smooth", sql=_zero_phase_sql(6, 2.0, 100.0))
def _(t):
    return W.zero_phase_lowpass(t.signal, ["case_id"], "n", "u", "smooth", fc=2.0, fs=100.0, size=4096)


# --------------------------------------------------------- scalar expressions


@query(
    "p1_speed", ints="track_id frame", reals="speed", digits=2,
    sql=f"select track_id, frame, sqrt(u * u + v * v + w * w) as speed from {VELOCITY_SQL} v",
)
def _(t):
    return track_velocity(t).withColumn("speed", P.speed("u", "v", "w"))


@query(
    "p2_nondim_time", ints="track_id frame", reals="tc",
    sql=f"select track_id, frame, frame * {DT}e0 * 0.42e0 / 0.125e0 + 10 as tc from {TRACKS} t",
)
def _(t):
    return t.tracks.withColumn("tc", P.nondim_time(F.col("frame") * DT, 0.42, 0.125, 10))


@query(
    "p3_force_coeff", texts="case_id", ints="n", reals="cl",
    sql=f"select case_id, n, u / (0.5e0 * 998 * 0.42e0 * 0.42e0 * 0.05e0) as cl from {SIGNAL} s",
)
def _(t):
    return t.signal.withColumn("cl", P.force_coeff("u", 998.0, 0.42, 0.05))


@query(
    "p4_rebase_first", ints="track_id frame", reals="n_x n_y distance",
    sql=f"""with f as (select *, (x - first_value(x) over o) / 10 as n_x, (y - first_value(y) over o) / 10 as n_y
        from {TRACKS} t window o as (partition by track_id order by frame))
        select track_id, frame, n_x, n_y, sqrt(n_x * n_x + n_y * n_y) as distance from f""",
)
def _(t):
    return W.rebase_first(t.tracks, TRACK, "frame", ["x", "y"], 10.0)


@query(
    "p5_rebase_mean_head", texts="case_id", ints="n", reals="c",
    sql=f"""select case_id, n, -(u - avg(case when n < 50 then u end) over (partition by case_id)) as c from {SIGNAL} s""",
)
def _(t):
    return W.rebase_mean_head(t.signal, ["case_id"], "n", "u", 50, "c")


@query(
    "p6_rebase_to_known", ints="track_id frame", reals="c",
    sql=f"""select track_id, frame, x - first_value(x) over (partition by track_id order by frame) + 1.5e0 as c from {TRACKS} t""",
)
def _(t):
    return W.rebase_to_known(t.tracks, TRACK, "frame", "x", 1.5, "c")


@query(
    "p7_stderr", texts="case_id", reals="se", digits=6,
    sql=f"select case_id, stddev_samp(u) / sqrt(count(u)) as se from {SIGNAL} s group by case_id",
)
def _(t):
    g = t.signal.groupBy("case_id").agg(F.stddev_samp("u").alias("sd"), F.count("u").alias("k"))
    return g.withColumn("se", P.stderr("sd", "k"))


@query(
    "p10_ratio_column", ints="track_id frame", reals="r",
    sql=f"select track_id, frame, x / nullif(y, 0) as r from {TRACKS} t",
)
def _(t):
    return t.tracks.withColumn("r", P.ratio_column("x", "y"))


@query(
    "p13_polar_to_uv", ints="track_id frame", reals="pu pv",
    sql=f"select track_id, frame, x * cos(radians(y)) as pu, x * sin(radians(y)) as pv from {TRACKS} t",
)
def _(t):
    pu, pv = P.polar_to_uv("x", "y")
    return t.tracks.withColumns({"pu": pu, "pv": pv})


def _poly_sql(a: str, b: str) -> str:
    parts = []
    for i, j in P.POLY5_EXPONENTS:
        parts.append(" * ".join(["1e0", *[a] * i, *[b] * j]))
    return "[" + ", ".join(parts) + "]"


@query(
    "p14_poly5_features", ints="track_id frame k", reals="f",
    sql=f"""select track_id, frame, k - 1 as k, feats[k] as f from (
        select track_id, frame, {_poly_sql('(x / 100)', '(y / 100)')} as feats from {TRACKS} t) p, (select unnest(range(1, 22)) as k) r""",
)
def _(t):
    feats = P.poly5_features(F.col("x") / 100, F.col("y") / 100)
    return t.tracks.select("track_id", "frame", F.posexplode(feats).alias("k", "f"))


@query(
    "p15_minmax_rescale", texts="case_id", ints="n", reals="u v",
    sql=f"""select case_id, n, (u - min(u) over o) / (max(u) over o - min(u) over o) as u,
        (v - min(v) over o) / (max(v) over o - min(v) over o) as v from {SIGNAL} s window o as (partition by case_id)""",
)
def _(t):
    return W.minmax_rescale(t.signal, ["u", "v"], ["case_id"])


@query(
    "p17_datenum_to_ts", ints="event_id secs local_hour",
    # mountain time: seven hours behind, six in summer; the years that the events may lie in
    sql="""with e as (select event_id, epoch_us(ts) + 500 as us, ts + interval 500 microsecond as ts from events)
        select event_id, us // 1000000 as secs, (hour(ts) + case when
            ts >= timestamp '2023-03-12 09:00:00' and ts < timestamp '2023-11-05 08:00:00' or
            ts >= timestamp '2024-03-10 09:00:00' and ts < timestamp '2024-11-03 08:00:00' or
            ts >= timestamp '2025-03-09 09:00:00' and ts < timestamp '2025-11-02 08:00:00' then 18 else 17 end) % 24 as local_hour from e""",
)
def _(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = t.events.withColumn("datenum", micros / 86400e6 + P.DATENUM_OF_UNIX_EPOCH)
    return rows.select(
        "event_id",
        F.floor(F.unix_micros(P.datenum_to_ts("datenum")) / 1000000).alias("secs"),
        F.hour(P.datenum_to_ts("datenum", "America/Denver")).alias("local_hour"),
    )


# --------------------------------------------------------------- quality gates


@query(
    "f1_valid_samples", ints="track_id frame",
    sql=f"select track_id, frame from (select *, nullif(y, 0) as yy from {TRACKS} t) a where yy is not null",
)
def _(t):
    return Q.valid_samples(t.tracks.withColumn("yy", F.when(F.col("y") != 0, F.col("y"))), ["x", "yy", "z"])


@query(
    "f3_min_track_length", ints="track_id frame",
    sql=f"select * from (select *, count(*) over (partition by track_id) as c from {GAPPY} g) a where c >= 55",
)
def _(t):
    return Q.min_track_length(t.gappy, TRACK, 55)


@query(
    "f9_plausible_power", ints="turbine n", reals="power",
    sql=f"""select turbine, count(p) as n, avg(p) as power from (
        select turbine, case when power >= 0 then power end as p from {SCADA} s) a group by turbine""",
)
def _(t):
    p = Q.plausible_power("power")
    return t.scada.groupBy("turbine").agg(F.count(p).alias("n"), F.avg(p).alias("power"))


@query(
    "f7_mad_outliers", texts="case_id", ints="n accepted", reals="median mad",
    sql=f"""with m as (select * from {SIGNAL} s join (select case_id, median(u) as median from {SIGNAL} s2 group by case_id) q using (case_id)),
        d as (select case_id, median(abs(u - median)) as mad from m group by case_id)
        select case_id, n, median, mad, case when abs(u - median) <= greatest(3 * 1.4826e0 * mad, 0.5e0) then 1 else 0 end as accepted
        from m join d using (case_id)""",
)
def _(t):
    return Q.mad_outliers(t.signal, "u", ["case_id"], 3.0, 0.5)


@query(
    "f11_cv_flag", ints="track_id contaminated", reals="cv",
    sql=f"""select track_id, cv, case when cv > 0.9e0 then 1 else 0 end as contaminated from (
        select track_id, stddev_samp(x) / avg(x) as cv from {TRACKS} t group by track_id) c""",
)
def _(t):
    return Q.cv_flag(t.tracks, "x", TRACK, 0.9)


def _trim_bounds(c: str) -> str:
    lo = midpoint_quantile_sql(0.01, f"(select 1 as one, * from {TRACKS} t)", "one", c, "lo")
    hi = midpoint_quantile_sql(0.99, f"(select 1 as one, * from {TRACKS} t)", "one", c, "hi")
    return f"{c} between (select lo from {lo} a) and (select hi from {hi} b)"


@query(
    "f12_percentile_trim", ints="track_id frame",
    sql=f"select track_id, frame from {TRACKS} t where {_trim_bounds('x')} and {_trim_bounds('z')}",
)
def _(t):
    return Q.percentile_trim(t.tracks, ["x", "z"])


# ------------------------------------------------------------------ Lagrangian

PROFILE_SQL = f"""(select -0.5e0 + 100e0 * (iy - 0.5e0) / 9 as y, avg(u) as u, avg(v) as v, avg(w) as w
    from (select *, {bin_sql('y', -0.5, 99.5, 9)} as iy from {VELOCITY_SQL} vl) b where iy is not null group by iy)"""


def velocity_profile(t):
    """Mean track velocity over nine y bins."""
    from ..operators.binning import Axis, bin_means

    axis = Axis("y", -0.5, 99.5, 9)
    bins = bin_means(track_velocity(t), [axis], ["u", "v", "w"])
    return bins.select((-0.5 + 100.0 * (F.col("iy") - 0.5) / 9).alias("y"), "u", "v", "w")


def _local(v: str) -> str:
    return f"""(select s.track_id, s.frame, {CUBIC.replace('v -', 's.y -')} as m
        from {SEGMENT} s join {pchip_sql(PROFILE_SQL, 'y', v)} n
        on x1 is not null and (i = 1 or s.y >= x0) and (i = m - 1 or s.y < x1))"""


FLUCT = f"""(select g.track_id, g.frame, g.y, d_x - mu.m as u_p, d_y - mv.m as v_p, d_z - mw.m as w_p
    from {GRADIENT.format(src=SEGMENT)} g
    join {_local('u')} mu on g.track_id = mu.track_id and g.frame = mu.frame
    join {_local('v')} mv on g.track_id = mv.track_id and g.frame = mv.frame
    join {_local('w')} mw on g.track_id = mw.track_id and g.frame = mw.frame)"""


def fluctuations(t):
    return L.velocity_fluctuation(t.gappy, velocity_profile(t), [], "track_id", "frame", DT)


@query("l1_velocity_fluctuation", ints="track_id frame", reals="u_p v_p w_p", digits=2, sql=f"select * from {FLUCT} f")
def _(t):
    return fluctuations(t)


@query(
    "l1b_tracked_velocity", ints="track_id frame", reals="u_p v_p w_p", digits=2,
    sql=f"""select g.track_id, g.frame, g.z - mu.m as u_p, g.x - mv.m as v_p, g.y - mw.m as w_p from {SEGMENT} g
        join {_local('u')} mu on g.track_id = mu.track_id and g.frame = mu.frame
        join {_local('v')} mv on g.track_id = mv.track_id and g.frame = mv.frame
        join {_local('w')} mw on g.track_id = mw.track_id and g.frame = mw.frame""",
)
def _(t):
    return L.velocity_fluctuation(t.gappy, velocity_profile(t), [], "track_id", "frame", DT, velocities=("z", "x", "y"))


VALUES = ["u_p", "v_p", "w_p"]
LAGS = 20


def _lag_sql(source: str, key: str = "", lags: int = LAGS) -> str:
    """Normalised lag curves of a fluctuation table, optionally per key."""
    k = f"a.{key} as {key}, " if key else ""
    j = f"on c.{key} = z.{key}" if key else "on true"
    return f"""(with f as (select * from {source} src),
      c as (select {k} lag, count(*) as n, avg(a.u_p * b.u_p) as ru, avg(a.v_p * b.v_p) as rv, avg(a.w_p * b.w_p) as rw
        from f a cross join (select unnest(range({lags + 1})) as lag) r join f b on a.track_id = b.track_id and b.frame = a.frame + lag
        group by {f"a.{key}, " if key else ""} lag)
      select {f'c.{key},' if key else ''} c.lag, c.n, c.lag * {DT}e0 as tau, c.ru as raw_u_p, c.rv as raw_v_p, c.rw as raw_w_p,
        c.ru / z.ru as r_u_p, c.rv / z.rv as r_v_p, c.rw / z.rw as r_w_p
      from c join (select * from c where lag = 0) z {j})"""


CURVE = _lag_sql(FLUCT)


def curve(t):
    return L.lagrangian_autocorr(fluctuations(t), [], "track_id", "frame", VALUES, LAGS, DT)


@query("l2_lagrangian_autocorr", ints="lag n", reals="tau r_u_p r_v_p r_w_p", sql=f"select * from {CURVE} c")
def _(t):
    return curve(t)


TRACK_FLUCT = f"""(select track_id, frame, y, x - avg(x) over (partition by track_id) as u_p,
    y - avg(y) over (partition by track_id) as v_p, z - avg(z) over (partition by track_id) as w_p from {TRACKS} t)"""


@query("l2b_autocorr_long_lags", ints="lag n", reals="tau r_u_p r_v_p r_w_p",
       sql=f"select * from {_lag_sql(TRACK_FLUCT, lags=60)} c")
def _(t):
    rows = W.fluctuation(t.tracks, TRACK, ["x", "y", "z"])
    rows = rows.select("track_id", "frame", *[F.col(f"{c}_p").alias(n) for c, n in zip("xyz", VALUES)])
    return L.lagrangian_autocorr(rows, [], "track_id", "frame", VALUES, 60, DT, method="fft")


CENTRES, HALF = (20.0, 50.0, 80.0), 12.0
BAND_CASE = " ".join(f"when abs(y0 - {num(c)}) <= {num(HALF)} then {i + 1}" for i, c in enumerate(CENTRES))
BANDED = f"""(select f.*, case {BAND_CASE} end as band from {FLUCT} f join
    (select track_id, first_value(y) over (partition by track_id order by frame) as y0, row_number() over (partition by track_id order by frame) as r
     from {FLUCT} q) s on f.track_id = s.track_id and s.r = 1)"""


@query(
    "j15_track_start_band", ints="track_id frame band",
    sql=f"select track_id, frame, band from {BANDED} b",
)
def _(t):
    return J.track_start_band(fluctuations(t), TRACK, "frame", "y", CENTRES, HALF)


@query(
    "l3_banded_autocorr", ints="band lag n", reals="r_u_p r_v_p r_w_p",
    sql=f"""select * from {_lag_sql(f'(select * from {BANDED} b where band is not null)', 'band')} c
        union all by name select 0 as band, * from {CURVE} e""",
)
def _(t):
    return L.banded_autocorr(fluctuations(t), [], "track_id", "frame", VALUES, CENTRES, HALF, LAGS, DT)


def _scale_sql(v: str, threshold: str = "exp(-1e0)", op: str = "<") -> str:
    return f"""(select coalesce(sum((tau - p_tau) * (r + p_r) / 2), 0e0) as tl from (
        select lag, tau, r_{v} as r, lag(tau) over (order by lag) as p_tau, lag(r_{v}) over (order by lag) as p_r,
        coalesce(min(case when r_{v} {op} {threshold} then lag end) over (), max(lag) over ()) as stop from {CURVE} c) x
        where lag <= stop)"""


@query(
    "l4_integral_timescale", reals="tl_u tl_v tl_w", digits=6,
    sql=f"select (select tl from {_scale_sql('u_p')} a) as tl_u, (select tl from {_scale_sql('v_p')} b) as tl_v, (select tl from {_scale_sql('w_p')} c) as tl_w",
)
def _(t):
    c = L.eddy_diffusivity(curve(t), [], VALUES)
    return c.select(*[F.col(f"tl_{v}_p").alias(f"tl_{v}") for v in "uvw"])


@query(
    "l5_eddy_diffusivity", reals="d_u d_v d_w", digits=2,
    sql=f"""select raw_u_p * (select tl from {_scale_sql('u_p')} a) as d_u, raw_v_p * (select tl from {_scale_sql('v_p')} b) as d_v,
        raw_w_p * (select tl from {_scale_sql('w_p')} d) as d_w from {CURVE} c where lag = 0""",
)
def _(t):
    c = L.eddy_diffusivity(curve(t), [], VALUES)
    return c.select(*[F.col(f"d_{v}_p").alias(f"d_{v}") for v in "uvw"])


@query(
    "l6_exp_model", ints="lag", reals="model log_r", digits=3,
    sql=f"""select lag, case when tau < 2 * tl then exp(-tau / tl) end as model, ln(abs(r_u_p)) as log_r
        from {CURVE} c, {_scale_sql('u_p')} s""",
)
def _(t):
    return L.exp_model(curve(t), [], "r_u_p")


STEPS = (1, 2, 5, 10, 20, 40, 60)


@query(
    "l7_survival_curve", ints="m n",
    sql=f"""select b.frame - 10 as m, count(*) as n from {GAPPY} a join {GAPPY} b on a.track_id = b.track_id
        where a.frame = 10 and b.frame - 10 in {STEPS} group by 1""",
)
def _(t):
    return L.survival_curve(t.gappy, [], "track_id", "frame", 10, STEPS)


@query(
    "l8_longest_tracks", ints="track_id frame",
    sql=f"""select track_id, frame from {GAPPY} g where track_id in (select track_id from {GAPPY} h group by track_id
        order by count(*) desc, track_id limit 25)""",
)
def _(t):
    return L.longest_tracks(t.gappy, [], "track_id", 25)


@query(
    "l9_track_summary", ints="samples tracks longest", reals="mean_length",
    sql=f"""select sum(k) as samples, count(*) as tracks, max(k) as longest, avg(k) as mean_length from
        (select count(*) as k from {GAPPY} g group by track_id) c""",
)
def _(t):
    return L.track_summary(t.gappy, [], "track_id")


@query(
    "j7_lagged_pairs", ints="lag n", reals="s",
    sql=f"""select lag, count(*) as n, avg(a.x * b.x) as s from {GAPPY} a cross join (select unnest(range(6)) as lag) r
        join {GAPPY} b on a.track_id = b.track_id and b.frame = a.frame + lag group by lag""",
)
def _(t):
    pairs = J.lagged_pairs(t.gappy, TRACK, "frame", ["x"], 5)
    return pairs.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x_0") * F.col("x_1")).alias("s"))


STARTS, SPAN = (5, 15, 25), 10


@query(
    "j8_flow_map", ints="i0 track_id", reals="x y z x1 y1 z1",
    sql=f"""select i0, a.track_id, a.x, a.y, a.z, b.x as x1, b.y as y1, b.z as z1 from (select unnest({list(STARTS)}) as i0) s
        join {GAPPY} a on a.frame = i0 join {GAPPY} b on a.track_id = b.track_id and b.frame = i0 + {SPAN}""",
)
def _(t):
    return J.flow_map(t.gappy, [], "track_id", "frame", STARTS, SPAN)


@query(
    "j8b_flow_map_span", ints="i0 track_id", reals="x x1",
    sql=f"""select i0, track_id, max(case when frame = i0 then x end) as x, max(case when frame = i0 - 3 then x end) as x1
        from (select unnest({list(STARTS)}) as i0) s join {GAPPY} a on frame between i0 - 3 and i0
        group by i0, track_id having count(*) = 4""",
)
def _(t):
    return J.flow_map(t.gappy, [], "track_id", "frame", STARTS, -3, require_span=True)


REPEATS = f"(select case_id, n % 5 + 1 as rep, n // 5 as k, n // 5 + (n % 5) * 0.13e0 as t, u from {SIGNAL} s)"
ALIGNED = f"""(with r as {REPEATS},
    g as (select case_id, min(t) as a, max(t) as b, count(*) as m from r where rep = 1 group by case_id),
    q as (select g.case_id, rep, i, a + i * ((b - a) / (m - 1)) as tc from g, (select unnest(range(100000)) as i) x,
          (select unnest(range(1, 6)) as rep) y where i < m),
    e as (select case_id, rep, t as t0, u as u0, lead(t) over o as t1, lead(u) over o as u1,
          row_number() over o as j, count(*) over (partition by case_id, rep) as c from r
          window o as (partition by case_id, rep order by t))
    select q.case_id, q.rep, q.i, tc, u0 + (tc - t0) / (t1 - t0) * (u1 - u0) as u from q join e
      on q.case_id = e.case_id and q.rep = e.rep and t1 is not null and (j = 1 or tc >= t0) and (j = c - 1 or tc < t1))"""


def repeats(t):
    k = F.floor(F.col("n") / 5)
    return t.signal.select(
        "case_id", (F.col("n") % 5 + 1).alias("rep"), (k + (F.col("n") % 5) * 0.13).alias("t"), "u"
    )


@query("j14_align_repeats", texts="case_id", ints="rep i", reals="u", sql=f"select * from {ALIGNED} a")
def _(t):
    return J.align_repeats(repeats(t), ["case_id"], "rep", "t", ["u"])


@query(
    "m14_repeat_average", texts="case_id", ints="i n", reals="mean std se",
    sql=f"""select case_id, i, count(*) as n, avg(u) as mean, stddev_samp(u) as std, stddev_samp(u) / sqrt(count(*)) as se
        from {ALIGNED} a group by case_id, i""",
)
def _(t):
    rows = J.align_repeats(repeats(t), ["case_id"], "rep", "t", ["u"])
    return J.repeat_average(rows, ["case_id"], "u")


# --------------------------------------------------------- sorts, limits, sets


@query(
    "o1_top_tracks", ints="track_id n",
    sql=f"select track_id, count(*) as n from {GAPPY} g group by track_id order by n desc, track_id limit 10",
)
def _(t):
    return t.gappy.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "track_id").limit(10)


@query(
    "o2_top_k_per_group", ints="track_id frame rank",
    sql=f"""select * from (select track_id, frame, row_number() over (partition by track_id order by x desc, frame) as rank
        from {TRACKS} t) r where rank <= 3""",
)
def _(t):
    return top_k(t.tracks, TRACK, [F.desc("x"), F.asc("frame")], 3)


@query(
    "o3_arg_extremes", ints="track_id at_max at_min",
    sql=f"select track_id, arg_max(frame, x * 1000 - frame * 1e-6) as at_max, arg_min(frame, x * 1000 + frame * 1e-6) as at_min from {TRACKS} t group by track_id",
)
def _(t):
    return t.tracks.groupBy("track_id").agg(
        F.max_by("frame", F.struct("x", -F.col("frame"))).alias("at_max"),
        F.min_by("frame", F.struct("x", "frame")).alias("at_min"),
    )


FRAMES_OF = f"(select distinct frame from {OBS} o where camera = {{}})"


@query("o4_intersect", ints="frame", sql=f"select * from {FRAMES_OF.format(0)} a intersect select * from {FRAMES_OF.format(1)} b")
def _(t):
    a, b = (t.obs.filter(F.col("camera") == c).select("frame") for c in (0, 1))
    return a.intersect(b)


@query("o5_difference", ints="frame", sql=f"select * from {FRAMES_OF.format(0)} a except select * from {FRAMES_OF.format(1)} b")
def _(t):
    a, b = (t.obs.filter(F.col("camera") == c).select("frame").distinct() for c in (0, 1))
    return a.join(b, "frame", "left_anti")


@query(
    "o6_union", ints="frame camera side",
    sql=f"""select frame, camera, 1 as side from {OBS} o where camera < 2 union all
        select frame, camera, 2 as side from {OBS} o where camera >= 2""",
)
def _(t):
    a = t.obs.filter(F.col("camera") < 2).withColumn("side", F.lit(1))
    return a.unionByName(t.obs.filter(F.col("camera") >= 2).withColumn("side", F.lit(2)))


@query(
    "o7_distinct_reindex", ints="track_id column_index",
    sql=f"select track_id, row_number() over (order by track_id) - 1 as column_index from (select distinct track_id from {GAPPY} g) d",
)
def _(t):
    return S.index_tracks(t.gappy).select("track_id", "column_index").distinct()


@query(
    "o8_natural_order", texts="name", ints="frame_no place",
    sql="""select 'img' || cast(event_id as varchar) || '.tif' as name, event_id as frame_no,
        row_number() over (order by event_id) - 1 as place from events""",
)
def _(t):
    name = F.concat(F.lit("img"), F.col("event_id").cast("string"), F.lit(".tif"))
    rows = t.events.select(name.alias("name")).withColumn("frame_no", ST.filename_fields("name")["frame_no"])
    return ordinal(rows, [], ["frame_no"], F.floor(F.col("frame_no") / 65536), "place")

"""Queries over neighbourhoods, Lyapunov exponents and node fields."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import ftle as E
from ..operators import neighbours as N
from ..operators.binning import Axis
from .eulerian import midpoint_quantile_sql
from .registry import query
from .views import DT, FLOW, PIXELS, SAMPLES, TRACKS, num

RADIUS = 0.12
BY = ["label"]


@query(
    "j9_radius_neighbours", ints="seed n_seed", reals="dist", digits=6,
    sql=f"""select a.seed, b.seed as n_seed, sqrt(power(a.x-b.x,2) + power(a.y-b.y,2) + power(a.z-b.z,2)) as dist
        from {FLOW} a join {FLOW} b on a.label = b.label and a.seed <> b.seed
        and power(a.x-b.x,2) + power(a.y-b.y,2) + power(a.z-b.z,2) <= {num(RADIUS * RADIUS)}""",
)
def _(t):
    p = t.flow.select("label", "seed", "x", "y", "z")
    return N.radius_neighbours(p, p, BY, ["x", "y", "z"], RADIUS, "seed", "seed", include_self=False)


@query(
    "j10_knn", ints="seed n_seed rank", reals="dist", digits=6,
    sql=f"""select * from (select *, row_number() over (partition by seed order by dist, n_seed) as rank from (
        select a.seed, b.seed as n_seed, sqrt(power(a.x-b.x,2) + power(a.y-b.y,2) + power(a.z-b.z,2)) as dist
        from {FLOW} a join {FLOW} b on a.seed <> b.seed) p) r where rank <= 12""",
)
def _(t):
    return N.knn(t.flow, [], "seed", ["x", "y", "z"], 12)


_BRIGHT = f"(select cam, frame, row, col from {PIXELS} px where value > 120)"


@query(
    "j10b_nearest_2d", ints="frame cam n", reals="median_nn", digits=4,
    sql=f"""select cam, frame, count(*) as n, median(d) as median_nn from (
        select a.cam, a.frame, a.row, a.col, min(sqrt(power(a.row - b.row, 2) + power(a.col - b.col, 2))) as d from {_BRIGHT} a join {_BRIGHT} b
        on a.cam = b.cam and a.frame = b.frame and (a.row <> b.row or a.col <> b.col) group by a.cam, a.frame, a.row, a.col) m group by cam, frame""",
)
def _(t):
    p = t.pixels.filter(F.col("value") > 120).select(
        "cam", "frame", (F.col("row") * 16 + F.col("col")).alias("pid"), "row", "col"
    )
    near = N.knn(p, ["cam", "frame"], "pid", ["row", "col"], 1)
    return near.groupBy("cam", "frame").agg(F.count(F.lit(1)).alias("n"), F.median("dist").alias("median_nn"))


def _sym(i: int, j: int) -> str:
    return f"{min(i, j)}{max(i, j)}"


def _eigen_sql(m: str, source: str) -> str:
    """Adds <m>_hi and <m>_lo, the extreme eigenvalues of the symmetric 3x3 matrix in columns <m>ij."""
    q = f"(({m}00 + {m}11 + {m}22) / 3)"
    spread = f"""(power({m}00 - q, 2) + power({m}11 - q, 2) + power({m}22 - q, 2) + 2 * (power({m}01, 2) + power({m}02, 2) + power({m}12, 2))) / 6"""
    det = f"""(({m}00 - q) * (({m}11 - q) * ({m}22 - q) - {m}12 * {m}12) - {m}01 * ({m}01 * ({m}22 - q) - {m}12 * {m}02)
        + {m}02 * ({m}01 * {m}12 - ({m}11 - q) * {m}02))"""
    return f"""(select * exclude (q, p, phi), q + 2 * p * cos(phi) as {m}_hi, q + 2 * p * cos(phi + {num(2 * math.pi / 3)}) as {m}_lo from (
        select *, acos(greatest(least({det} / (2 * p * p * p), 1e0), -1e0)) / 3 as phi from (
        select *, sqrt({spread}) as p from (select *, {q} as q from {source} e1) e2) e3) e4)"""


def stretch_sql(flow: str, key: str, seed: str, pairs: str) -> str:
    """Largest singular value of the least-squares gradient per seed, from closed forms.

    ``pairs`` gives key, seed and the separations d0..d2 (start), e0..e2 (end).
    """
    a = [f"sum(d{i} * d{j}) as a{i}{j}" for i in range(3) for j in range(i, 3)]
    b = [f"sum(e{i} * d{j}) as b{i}{j}" for i in range(3) for j in range(3)]
    cof = {
        "00": "a11 * a22 - a12 * a12", "01": "a02 * a12 - a01 * a22", "02": "a01 * a12 - a02 * a11",
        "11": "a00 * a22 - a02 * a02", "12": "a01 * a02 - a00 * a12", "22": "a00 * a11 - a01 * a01",
    }
    f = [f"({' + '.join(f'b{i}{k} * c{_sym(k, j)}' for k in range(3))}) / det as f{i}{j}" for i in range(3) for j in range(3)]
    m = [f"{' + '.join(f'f{k}{i} * f{k}{j}' for k in range(3))} as m{i}{j}" for i in range(3) for j in range(i, 3)]
    sums = f"(select {key}, {seed}, count(*) as n, {', '.join(a)}, {', '.join(b)} from {pairs} p group by {key}, {seed})"
    cofactors = f"(select *, {', '.join(f'{v} as c{k}' for k, v in cof.items())} from {_eigen_sql('a', sums)} s)"
    gradient = f"(select *, {', '.join(f)} from (select *, a00 * c00 + a01 * c01 + a02 * c02 as det from {cofactors} t) u)"
    good = _eigen_sql("m", f"(select *, {', '.join(m)} from {gradient} g)")
    rated = f"(select *, n >= 4 and a_lo > 1e-6 * a_hi and a_lo > 0 as ok from {good} h)"
    return f"""(select w.{key}, w.{seed}, case when ok then 1 else 0 end as valid, case when ok then sqrt(m_hi) end as smax
        from {flow} w left join {rated} r on w.{key} = r.{key} and w.{seed} = r.{seed})"""


def near_sql(flow: str, key: str, seed: str, k: int | None = None, radius: float | None = None) -> str:
    """Separations of every seed from its k nearest seeds, or those within a radius."""
    gap = "power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2)"
    diffs = ", ".join([f"b.{c} - a.{c} as d{i}" for i, c in enumerate("xyz")] + [f"b.{c}1 - a.{c}1 as e{i}" for i, c in enumerate("xyz")])
    pairs = f"(select a.{key}, a.{seed}, b.{seed} as other, {gap} as gap, {diffs} from {flow} a join {flow} b on a.{key} = b.{key} and a.{seed} <> b.{seed})"
    if radius is not None:
        return f"(select * from {pairs} q where gap <= {num(radius * radius)})"
    return f"(select * from (select *, row_number() over (partition by {key}, {seed} order by gap, other) as r from {pairs} q) z where r <= {k})"


ALL_FLOW = f"(select 0 as one, * from {FLOW} f)"
STRETCH = stretch_sql(ALL_FLOW, "one", "seed", near_sql(ALL_FLOW, "one", "seed", 12))


@query("e1_deformation_gradient", ints="seed valid", reals="smax", digits=5, sql=f"select * from {STRETCH} s")
def _(t):
    return E.deformation_gradient(t.flow, [], "seed", k=12)


@query("e1b_deformation_gradient_radius", ints="label seed valid", reals="smax", digits=4,
       sql=f"select * from {stretch_sql(FLOW, 'label', 'seed', near_sql(FLOW, 'label', 'seed', radius=0.2))} s")
def _(t):
    return E.deformation_gradient(t.flow, BY, "seed", radius=0.2)


@query("e2_ftle", ints="seed valid", reals="sigma", digits=5, sql=f"select seed, valid, ln(smax) / 2 as sigma from {STRETCH} s")
def _(t):
    return E.ftle(t.flow, [], "seed", 2.0, k=12)


STARTS = (0, 10, 20)


WINDOWS = f"""(select i0, a.track_id, a.x, a.y, a.z, b.x as x1, b.y as y1, b.z as z1 from (select unnest({list(STARTS)}) as i0) s
    join {TRACKS} a on a.frame = i0 join {TRACKS} b on a.track_id = b.track_id and b.frame = i0 + 10)"""


@query(
    "e3_ftle_windows", ints="i0 seeds kept rejected", reals="sigma",
    sql=f"""select i0, count(*) as seeds, sum(valid) as kept, count(*) - sum(valid) as rejected, avg(ln(smax) / 0.1e0) as sigma
        from {stretch_sql(WINDOWS, 'i0', 'track_id', near_sql(WINDOWS, 'i0', 'track_id', 12))} s group by i0""",
)
def _(t):
    field = E.ftle_windows(t.tracks, [], "track_id", "frame", STARTS, 10, DT, k=12)
    return E.ftle_counts(field, ["i0"], "sigma")


# ------------------------------------------------------------- node fields

GRID = (Axis("x", -0.2, 0.2, 9), Axis("y", -0.2, 0.2, 9), Axis("z", -0.2, 0.2, 9))
H = 0.09
SCATTER = f"""(with n as (select i, j, k, -0.2e0 + i * {num(0.4 / 8)} as nx, -0.2e0 + j * {num(0.4 / 8)} as ny, -0.2e0 + k * {num(0.4 / 8)} as nz
      from (select unnest(range(9)) as i) a, (select unnest(range(9)) as j) b, (select unnest(range(9)) as k) c),
    p as (select label, i, j, k, x1 as v, power(x-nx,2) + power(y-ny,2) + power(z-nz,2) as d2,
      case when x >= nx then 1 else 0 end + case when y >= ny then 2 else 0 end + case when z >= nz then 4 else 0 end as o
      from {FLOW} f, n)
    select label, i, j, k, count(*) as seeds, sum(v / (d2 + {num(1e-12 * H * H)})) / sum(1 / (d2 + {num(1e-12 * H * H)})) as x1
    from p where d2 <= {num(H * H)} group by label, i, j, k having count(*) >= 4 and count(distinct o) >= 4)"""


@query("e4_scatter_to_grid", ints="label i j k seeds", reals="x1", sql=f"select * from {SCATTER} s")
def _(t):
    return E.scatter_to_grid(t.flow, BY, "x1", GRID, H)


@query(
    "e5_ensemble_mean", ints="i j k windows", reals="x1",
    sql=f"select i, j, k, avg(x1) as x1, count(*) as windows from {SCATTER} s group by i, j, k having count(*) >= 2",
)
def _(t):
    return E.ensemble_mean(E.scatter_to_grid(t.flow, BY, "x1", GRID, H), [], "x1", 2)


SHAPE = (10, 11, 9)
AXES = (Axis("x", 0.0, 45.0, 10), Axis("y", 0.0, 0.1, 11), Axis("z", 0.0, 0.08, 9))
FIELD = f"""(select least(floor(x / 5e0), 9) as i, round(y * 100) as j, round(z * 100) as k, avg(u) as v
    from {SAMPLES} s group by 1, 2, 3 having count(*) % 16 <> 0)"""


def field(t):
    """Mean price on quantity x discount x tax nodes, with gaps."""
    node = t.samples.select(
        F.least(F.floor(F.col("x") / 5.0), F.lit(9).cast("bigint")).alias("i"),
        F.round(F.col("y") * 100).cast("bigint").alias("j"),
        F.round(F.col("z") * 100).cast("bigint").alias("k"),
        "u",
    )
    rows = node.groupBy("i", "j", "k").agg(F.avg("u").alias("v"), F.count(F.lit(1)).alias("n"))
    return rows.filter(F.col("n") % 16 != 0).drop("n")


NEAR6 = "(values (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)) as o(di, dj, dk)"


@query(
    "e6_erode6", ints="i j k",
    sql=f"""with f as (select * from {FIELD} f) select a.i, a.j, a.k from f a, {NEAR6}, f b
        where b.i = a.i + di and b.j = a.j + dj and b.k = a.k + dk group by 1, 2, 3 having count(*) = 6""",
)
def _(t):
    return E.erode6(field(t), [])


PASSES = 2


def _fill_sql() -> str:
    nodes = ", ".join(f"(select unnest(range({n})) as {c}) n{c}" for n, c in zip(SHAPE, "ijk"))
    parts = [f"f0 as materialized (select n.i, n.j, n.k, v from (select i, j, k from {nodes}) n left join {FIELD} f on n.i = f.i and n.j = f.j and n.k = f.k)"]
    for p in range(PASSES):
        parts.append(
            f"f{p + 1} as materialized (select a.i, a.j, a.k, coalesce(max(a.v), avg(b.v)) as v from (select * from f{p}, {NEAR6}) a "
            f"left join f{p} b on b.i = a.i + di and b.j = a.j + dj and b.k = a.k + dk group by a.i, a.j, a.k)"
        )
    return f"(with {', '.join(parts)} select i, j, k, coalesce(v, (select avg(v) from f0)) as v from f{PASSES})"


FILLED = _fill_sql()


def filled(t):
    return E.fill_gaps6(field(t), [], "v", SHAPE, PASSES)


@query("e7_fill_gaps6", ints="i j k", reals="v", sql=f"select * from {FILLED} f")
def _(t):
    return filled(t)


KERNEL = E.gaussian_kernel(0.8, 2)


SMOOTH = f"""(with s0 as materialized (select * from {FILLED} f), s1 as materialized (select * from {{}} x1), s2 as materialized (select * from {{}} x2)
    select * from {{}} x3)"""


def _one_axis(source: str, axis: int) -> str:
    weights = ", ".join(f"({o - 2}, {num(w)})" for o, w in enumerate(KERNEL))
    c, n = "ijk"[axis], SHAPE[axis]
    p, q = [x for x in "ijk" if x != c]
    return f"""(select a.i, a.j, a.k, sum(w * b.v) as v from {source} a, (values {weights}) as g(o, w), {source} b
        where b.{c} = least(greatest(a.{c} + o, 0), {n - 1}) and b.{p} = a.{p} and b.{q} = a.{q} group by a.i, a.j, a.k)"""


SMOOTH = SMOOTH.format(_one_axis("s0", 0), _one_axis("s1", 1), _one_axis("s2", 2))


@query("e8_gaussian_smooth", ints="i j k", reals="v", sql=f"select * from {SMOOTH} s")
def _(t):
    return E.gaussian_smooth(filled(t), [], "v", SHAPE, 0.8)


def _diff_sql(c: str, axis: int) -> str:
    a, p = AXES[axis], "ijk"[axis]
    others = ", ".join(x for x in "ijk" if x != p)
    step = num((a.hi - a.lo) / (a.n - 1))
    w = f"over (partition by {others} order by {p})"
    return f"""((coalesce(lead({c}) {w}, {c}) - coalesce(lag({c}) {w}, {c}))
        / (case when {p} = 0 or {p} = {a.n - 1} then 1 else 2 end * {step}))"""


def hessian_sql(source: str) -> str:
    return f"""(select *, {_diff_sql('gx', 0)} as hxx, {_diff_sql('gx', 1)} as hxy, {_diff_sql('gx', 2)} as hxz,
    {_diff_sql('gy', 1)} as hyy, {_diff_sql('gy', 2)} as hyz, {_diff_sql('gz', 2)} as hzz from (
    select *, {_diff_sql('v', 0)} as gx, {_diff_sql('v', 1)} as gy, {_diff_sql('v', 2)} as gz from {source} f) g)"""


HESSIAN = hessian_sql(FILLED)


@query("e9_grid_gradient_hessian", ints="i j k", reals="gx gy gz hxx hxy hxz hyy hyz hzz", digits=2,
       sql=f"select * from {HESSIAN} h")
def _(t):
    return E.grid_gradient_hessian(filled(t), [], "v", AXES)


ERODED = f"""(with f as (select * from {FIELD} f) select a.i, a.j, a.k from f a, {NEAR6}, f b
        where b.i = a.i + di and b.j = a.j + dj and b.k = a.k + dk group by 1, 2, 3 having count(*) = 6)"""


def _ridge_sql(floor: float, concave: float, align: float) -> str:
    """Ridges with the smallest eigenvalue in closed form; its vector is the longest cross product of two rows of H - lambda I."""
    rows = {"a": ("hxx - lam", "hxy", "hxz"), "b": ("hxy", "hyy - lam", "hyz"), "c": ("hxz", "hyz", "hzz - lam")}

    def cross(p: str, q: str) -> str:
        (x, y, z), (u, v, w) = rows[p], rows[q]
        return f"[({y}) * ({w}) - ({z}) * ({v}), ({z}) * ({u}) - ({x}) * ({w}), ({x}) * ({v}) - ({y}) * ({u})]"

    norm = lambda c: f"({c}[1] * {c}[1] + {c}[2] * {c}[2] + {c}[3] * {c}[3])"
    return f"""with valid as materialized (select h.* from {hessian_sql(SMOOTH)} h join {ERODED} e using (i, j, k)),
        cand as (select v.* from (select 1 as g, * from valid) v join {midpoint_quantile_sql(floor, '(select 1 as g, v from valid)', 'g', 'v', 'low')} q using (g) where v > low),
        t as (select *, (hxx + hyy + hzz) / 3 as m from cand),
        p as (select *, sqrt((power(hxx - m, 2) + power(hyy - m, 2) + power(hzz - m, 2) + 2 * (hxy * hxy + hxz * hxz + hyz * hyz)) / 6) as p from t),
        r as (select *, case when p > 0 then ((hxx - m) * ((hyy - m) * (hzz - m) - hyz * hyz) - hxy * (hxy * (hzz - m) - hyz * hxz) + hxz * (hxy * hyz - (hyy - m) * hxz)) / (2 * p * p * p) else 0 end as r from p),
        l as (select *, m + 2 * p * cos(acos(least(greatest(r, -1), 1)) / 3 + 2 * pi() / 3) as lam from r),
        c as (select *, {cross("a", "b")} as ab, {cross("a", "c")} as ac, {cross("b", "c")} as bc from l),
        w as (select *, case when {norm("ab")} >= {norm("ac")} and {norm("ab")} >= {norm("bc")} then ab when {norm("ac")} >= {norm("bc")} then ac else bc end as w from c),
        e as materialized (select 1 as g, i, j, k, v, lam, abs(gx * w[1] + gy * w[2] + gz * w[3]) / sqrt({norm("w")}) / (sqrt(gx * gx + gy * gy + gz * gz) + 2.220446049250313e-16) as align from w)
        select i, j, k, v, lam, align from e join {midpoint_quantile_sql(concave, '(select g, -lam as d from e where lam < 0)', 'g', 'd', 'cut')} q using (g)
        where lam < 0 and -lam > cut and align < {align}"""


@query("e10_ridge_points", ints="i j k", reals="v lam align", digits=3, sql=_ridge_sql(0.5, 0.3, 0.7))
def _(t):
    smooth = E.gaussian_smooth(filled(t), [], "v", SHAPE, 0.8)
    derivs = E.grid_gradient_hessian(smooth, [], "v", AXES)
    return E.ridge_points(derivs, E.erode6(field(t), []), [], "v", 50.0, 30.0, 0.7)


LEVELS = (80, 90, 95, 99)


@query(
    "e11_level_percentiles", ints="label", reals="p80 p90 p95 p99",
    sql="select * from " + " join ".join(
        midpoint_quantile_sql(p / 100, FLOW, "label", "x1", f"p{p}") + f" q{p}" + (" using (label)" if p > 80 else "") for p in LEVELS
    ),
)
def _(t):
    return E.level_percentiles(t.flow, BY, "x1", LEVELS)

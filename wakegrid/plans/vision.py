"""Queries over multi-camera observations.

Points of a wand come from ``orders``; four fixed cameras see them.  With equal
refractive indices a camera is a pinhole with a lens, which SQL can state, so
those queries have exact twins; refraction itself is tested in ``tests/``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import cameras as C
from ..operators import joins as J
from ..operators import quality as Q
from ..sources import tables as ST
from ..session import scratch_path
from .registry import query
from .views import CAMERAS, OBS, num

#: Length of the wand in metres.
WAND = 0.15

# ------------------------------------------------------------ fixed cameras

_CENTRES = [(0.8, 0.3, 0.10), (0.8, -0.3, -0.05), (-0.8, 0.3, 0.0), (-0.8, -0.3, 0.12)]
_FOCAL, _CX, _CY = 2000.0, 640.0, 512.0
_DIST = (-0.08, 0.02, 0.001, -0.0005, 0.0)


def _look_at(centre):
    z = -np.asarray(centre, float)
    z /= np.linalg.norm(z)
    x = np.cross([0.0, 0.0, 1.0], z)
    x /= np.linalg.norm(x)
    return np.stack([x, np.cross(z, x), z])


def camera_list(index=(1.0, 1.0, 1.0), dist=_DIST) -> list[dict]:
    out = []
    for c, centre in enumerate(_CENTRES):
        r = _look_at(centre)
        side = 1.0 if centre[0] > 0 else -1.0
        out.append(
            {
                "camera": c,
                "k": [_FOCAL + 10 * c, _FOCAL + 10 * c, _CX, _CY],
                "dist": [float(d) for d in dist],
                "r": [float(v) for v in r.ravel()],
                "t": [float(v) for v in -r @ np.asarray(centre)],
                "plate_point": [side * 0.24, 0.0, 0.0],
                "plate_normal": [-side, 0.0, 0.0],
                "idx3": [float(v) for v in index],
                "width": 0.01,
            }
        )
    return out


_CAMERA_DDL = (
    "camera int, k array<double>, dist array<double>, r array<double>, t array<double>,"
    " plate_point array<double>, plate_normal array<double>, idx3 array<double>, width double"
)


def camera_table(spark, **options):
    return spark.createDataFrame(camera_list(**options), _CAMERA_DDL)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(num(v) if isinstance(v, float) else str(v) for v in row) + ")" for row in rows)


def cameras_sql(dist=_DIST) -> str:
    """Pinhole cameras as a table: focal lengths, rotation, translation, centre."""
    rows = [
        (c["camera"], c["k"][0], *c["r"], *c["t"], *map(float, centre))
        for c, centre in zip(camera_list(dist=dist), _CENTRES)
    ]
    names = "camera, f, " + ", ".join(f"r{i}{j}" for i in range(3) for j in range(3)) + ", t0, t1, t2, c0, c1, c2"
    return f"(select * from (values {_values(rows)}) as cam({names}))"


# ------------------------------------------------------------- wand points

_WAND = """
    select frame, frame % 10 as run, idx,
           mx + (idx * 2 - 1) * {half} * cos(ph) * cos(th) as tx,
           my + (idx * 2 - 1) * {half} * cos(ph) * sin(th) as ty,
           mz + (idx * 2 - 1) * {half} * sin(ph) as tz
    from (select o_orderkey as frame, idx,
                 (o_custkey % 101) / 101e0 * 0.16e0 - 0.08e0 as mx, (o_custkey % 67) / 67e0 * 0.16e0 - 0.08e0 as my,
                 (floor(o_totalprice) % 89) / 89e0 * 0.16e0 - 0.08e0 as mz,
                 (floor(o_totalprice) % 360) / 57.3e0 as th, (o_custkey % 50 - 25) / 40e0 as ph
          from {source}) as raw
"""
HALF = num(WAND / 2)
#: Half a wand whose length differs from frame to frame.
STRETCHED = f"{HALF} * (1 + 0.01e0 * (frame % 7))"
TRUTH = "(" + _WAND.format(source="orders, (select unnest([0, 1]) as idx)", half=HALF) + ")"
SEEN = f"(select * from {TRUTH} tr, (select unnest([0, 1, 2, 3]) as camera) c where (frame + camera) % 7 <> 0)"
# Deterministic pixel noise of up to half a pixel.
NOISE_X = "(((frame * 31 + camera * 17 + idx * 7) % 11 - 5) * 0.1e0)"
NOISE_Y = "(((frame * 13 + camera * 29 + idx * 3) % 11 - 5) * 0.1e0)"


def truth(t, half: str = HALF):
    wide = t.orders.withColumn("idx", F.explode(F.array(F.lit(0), F.lit(1))))
    return t.spark.sql(_WAND.format(source="{rows}", half=half), rows=wide)


def observed(t, noise: bool = False, half: str = HALF, **options):
    """Pixels of the wand points in the cameras that see them."""
    cams = camera_table(t.spark, **options)
    rows = truth(t, half).withColumn("camera", F.explode(F.array(*[F.lit(c) for c in CAMERAS])))
    rows = rows.filter((F.col("frame") + F.col("camera")) % 7 != 0)
    rows = rows.withColumns({"px": F.col("tx"), "py": F.col("ty"), "pz": F.col("tz")})
    seen = C.project(rows, cams).drop("px", "py", "pz")
    dx, dy = (F.expr(n) if noise else F.lit(0.0) for n in (NOISE_X, NOISE_Y))
    return seen.withColumns({"x": F.col("u") + dx, "y": F.col("v") + dy}).drop("u", "v"), cams


def pixels_sql(dist=_DIST, noise: bool = False) -> str:
    k1, k2, p1, p2, k3 = (num(v) for v in dist)
    nx, ny = (NOISE_X, NOISE_Y) if noise else ("0e0", "0e0")
    return f"""(with a as (select s.frame, s.run, s.idx, s.camera, tx, ty, tz, f,
          (r00*tx+r01*ty+r02*tz+t0) / (r20*tx+r21*ty+r22*tz+t2) as a, (r10*tx+r11*ty+r12*tz+t1) / (r20*tx+r21*ty+r22*tz+t2) as b
          from {SEEN} s join {cameras_sql(dist)} c on s.camera = c.camera),
        q as (select *, a*a + b*b as r2 from a)
        select frame, run, idx, camera, tx, ty, tz,
          {num(_CX)} + f * (a * (1 + {k1}*r2 + {k2}*r2*r2 + {k3}*r2*r2*r2) + 2*{p1}*a*b + {p2}*(r2 + 2*a*a)) + {nx} as x,
          {num(_CY)} + f * (b * (1 + {k1}*r2 + {k2}*r2*r2 + {k3}*r2*r2*r2) + {p1}*(r2 + 2*b*b) + 2*{p2}*a*b) + {ny} as y from q)"""


BY = ["run", "frame", "idx"]


@query("c4_project", ints="frame idx camera in_image", reals="u v",
       sql=f"""select frame, idx, camera, x as u, y as v, case when x between 0 and 1279 and y between 0 and 1023 then 1 else 0 end as in_image
       from {pixels_sql()} p""")
def _(t):
    rows = truth(t).withColumn("camera", F.explode(F.array(*[F.lit(c) for c in CAMERAS])))
    rows = rows.filter((F.col("frame") + F.col("camera")) % 7 != 0)
    rows = rows.withColumns({"px": F.col("tx"), "py": F.col("ty"), "pz": F.col("tz")})
    return C.project(rows, camera_table(t.spark), (1280, 1024))


_N = (1.333, 1.49, 1.0003)
_K1, _K2, _P1, _P2, _K3 = (num(v) for v in _DIST)
# The plates are planes x = ±0.24 m, so refraction scales the y and z parts of a direction.
REFRACTED = f"""(with a as (select s.frame, s.idx, s.camera, tx, ty, tz, c.* exclude (camera), sign(c0) as s,
      sqrt(power(tx - c0, 2) + power(ty - c1, 2) + power(tz - c2, 2)) as d from {SEEN} s join {cameras_sql()} c on s.camera = c.camera),
    b as (select *, (ty - c1) / d as dy, (tz - c2) / d as dz, (tx - c0) / d as dx from a),
    h as (select *, c1 + (s * 0.25e0 - c0) / dx * dy as y1, c2 + (s * 0.25e0 - c0) / dx * dz as z1,
      {num(_N[2] / _N[1])} * dy as gy, {num(_N[2] / _N[1])} * dz as gz from b),
    g as (select *, -s * sqrt(1 - gy * gy - gz * gz) as gx from h),
    w as (select *, s * 0.24e0 as x2, y1 + (s * 0.24e0 - s * 0.25e0) / gx * gy as y2, z1 + (s * 0.24e0 - s * 0.25e0) / gx * gz as z2,
      {num(_N[1] / _N[0])} * gy as wy, {num(_N[1] / _N[0])} * gz as wz from g),
    v as (select *, -s * sqrt(1 - wy * wy - wz * wz) as wx from w),
    q as (select *, r20*tx + r21*ty + r22*tz + t2 as depth, r20*x2 + r21*y2 + r22*z2 + t2 as o2, r20*wx + r21*wy + r22*wz as v2 from v),
    m as (select *, (r00*x2 + r01*y2 + r02*z2 + t0 + (depth - o2) / v2 * (r00*wx + r01*wy + r02*wz)) / depth as a,
      (r10*x2 + r11*y2 + r12*z2 + t1 + (depth - o2) / v2 * (r10*wx + r11*wy + r12*wz)) / depth as b from q),
    n as (select *, a*a + b*b as r2 from m)
    select frame, idx, camera, {num(_CX)} + f * (a * (1 + {_K1}*r2 + {_K2}*r2*r2 + {_K3}*r2*r2*r2) + 2*{_P1}*a*b + {_P2}*(r2 + 2*a*a)) as u,
      {num(_CY)} + f * (b * (1 + {_K1}*r2 + {_K2}*r2*r2 + {_K3}*r2*r2*r2) + {_P1}*(r2 + 2*b*b) + 2*{_P2}*a*b) as v from n)"""


@query("c4b_project_refracted", ints="frame idx camera", reals="u v", sql=f"select * from {REFRACTED} r")
def _(t):
    obs, _ = observed(t, index=(1.333, 1.49, 1.0003))
    return obs.withColumnsRenamed({"x": "u", "y": "v"})


@query(
    "c1_lines_of_sight", ints="frame idx camera", reals="dx dy dz", digits=5,
    sql=f"""select s.frame, s.idx, s.camera, (tx - c0) / d as dx, (ty - c1) / d as dy, (tz - c2) / d as dz from
        (select *, sqrt(power(tx - c0, 2) + power(ty - c1, 2) + power(tz - c2, 2)) as d from {SEEN} o
         join {cameras_sql()} c using (camera)) s""",
)
def _(t):
    return C.lines_of_sight(*observed(t))


@query(
    "c2_triangulate", ints="run frame idx rays", reals="px py pz residual",
    sql=f"""select run, frame, idx, count(*) as rays, max(tx) as px, max(ty) as py, max(tz) as pz, 0e0 as residual
        from {SEEN} s group by run, frame, idx""",
)
def _(t):
    return C.triangulate(C.lines_of_sight(*observed(t)), BY, CAMERAS)


@query(
    "c3_wand_qc", texts="verdict", ints="run frames", reals="mean_length std_length mean_depth mean_residual error_pct",
    sql=f"""select run, 'PASS' as verdict, count(*) as frames, {num(WAND)} as mean_length, 0e0 as std_length, avg(mz) as mean_depth,
        0e0 as mean_residual, 0e0 as error_pct from (select run, frame, avg(tz) as mz from {TRUTH} t group by run, frame) f group by run""",
)
def _(t):
    points = C.triangulate(C.lines_of_sight(*observed(t)), BY, CAMERAS)
    return C.wand_qc(points, ["run"], "frame", WAND, 1e-3, 6e-4)


@query(
    "c5_reprojection_rms", texts="grade", ints="run camera frame n", reals="rms",
    sql=f"""select run, camera, frame, n, rms, case when rms < 0.5e0 then 'excellent' when rms < 1 then 'acceptable' else 'poor' end as grade
        from (select run, camera, frame, count(*) as n, sqrt(avg(power({NOISE_X}, 2) + power({NOISE_Y}, 2))) as rms from {SEEN} s
        group by grouping sets ((run, camera), (run, frame), (run))) g""",
)
def _(t):
    obs, cams = observed(t, noise=True)
    points = truth(t).withColumnsRenamed({"tx": "px", "ty": "py", "tz": "pz"})
    errors = C.reprojection_errors(obs.drop("tx", "ty", "tz"), points, cams, BY)
    return C.reprojection_rms(errors, ["run"], "frame")


def disturbed(t):
    """Wand pixels with some frames seen by one camera only and some with a displaced detection."""
    obs, cams = observed(t)
    frame = F.col("frame")
    few = (frame % 13 == 0) & (F.col("camera") != 1)
    obs = obs.filter(~few)
    shift = F.when((frame % 10 == 5) & (F.col("camera") == 2), 80.0).otherwise(0.0)
    return obs.withColumn("y", F.col("y") + shift), cams


DISTURBED = f"""(select run, frame, idx, count(*) as cameras, max(case when frame % 10 = 5 and camera = 2 then 1 else 0 end) as moved
    from {SEEN} s where not (frame % 13 = 0 and camera <> 1) group by run, frame, idx)"""


@query(
    "c6_reconstruct", texts="status", ints="run n", reals="cameras",
    sql=f"""select run, case when cameras < 2 then 'FEW_CAMERAS' when moved = 1 then 'HIGH_ERROR' else 'OK' end as status,
        count(*) as n, avg(cameras) as cameras from {DISTURBED} d group by 1, 2""",
)
def _(t):
    return C.reconstruction_counts(C.reconstruct(*disturbed(t), BY, 2, 2.0, CAMERAS), ["run"])


def noisy_errors(t):
    """Pixel errors of noisy observations against the true points."""
    obs, cams = observed(t, noise=True)
    points = truth(t).withColumnsRenamed({"tx": "px", "ty": "py", "tz": "pz"})
    return C.reprojection_errors(obs.drop("tx", "ty", "tz"), points, cams, BY)


ERRORS = f"(select run, camera, sqrt(power({NOISE_X}, 2) + power({NOISE_Y}, 2)) as err from {SEEN} s)"


def own_bins_sql(source: str, value: str, bins: int) -> str:
    """The library's histogram over a run's own range; values on an edge must not occur."""
    return f"""(select run, bin, count(*) as n, max(lo + bin * w) as lo, max(lo + (bin + 1) * w) as hi from (
        select run, lo, w, least(floor(({value} - lo) / w), {bins - 1}) as bin from {source} s
        join (select run, min({value}) as lo, (max({value}) - min({value})) / {bins} as w from {source} m group by run) r using (run)) b group by run, bin)"""


@query("c6b_error_histogram", ints="run bin n", reals="lo hi", sql=f"select * from {own_bins_sql(ERRORS, 'err', 47)} h")
def _(t):
    return C.error_histogram(noisy_errors(t), ["run"], 47)


@query(
    "c6c_camera_errors", ints="run camera n", reals="mean_err max_err",
    sql=f"select run, camera, count(*) as n, avg(err) as mean_err, max(err) as max_err from {ERRORS} e group by run, camera",
)
def _(t):
    return C.camera_errors(noisy_errors(t), ["run"])


LENGTHS = f"(select distinct run, frame, {num(1000 * WAND)} * (1 + 0.01e0 * (frame % 7)) as mm from {TRUTH} t)"


@query(
    "c6d_wand_lengths", ints="run bin n", reals="lo hi mean_mm std_mm error_pct",
    sql=f"""select h.*, mean_mm, std_mm, 100e0 * abs(mean_mm - {num(1000 * WAND)}) / {num(1000 * WAND)} as error_pct from {own_bins_sql(LENGTHS, 'mm', 29)} h
        join (select run, avg(mm) as mean_mm, stddev_samp(mm) as std_mm from {LENGTHS} l group by run) w using (run)""",
)
def _(t):
    obs, cams = observed(t, half=STRETCHED)
    points = C.triangulate(C.lines_of_sight(obs, cams), BY, CAMERAS)
    return C.wand_histogram(points, ["run"], "frame", WAND, 29)


@query("c7_position_sigma", ints="frame idx", reals="sx sy sz", digits=7)
def _(t):
    obs, cams = observed(t, noise=True, index=(1.333, 1.49, 1.0003))
    errors = C.located_errors(obs, cams, BY, CAMERAS)
    return C.position_sigma(errors, cams, ["frame", "idx"])


def _sigma_sql() -> str:
    """Position errors of pinhole cameras: the Jacobian of a pixel in closed form, and the inverse of the summed matrix by cofactors."""
    axes = "xyz"
    jac = {(p, a): f"f * (r{p}{a} - {q} * r2{a}) / d" for p, q in ((0, "a"), (1, "b")) for a in range(3)}
    sums = ", ".join(f"sum(w * (({jac[0, i]}) * ({jac[0, j]}) + ({jac[1, i]}) * ({jac[1, j]}))) as m{i}{j}" for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))
    det = "(m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02))"
    cofactors = ("m11 * m22 - m12 * m12", "m00 * m22 - m02 * m02", "m00 * m11 - m01 * m01")
    return f"""with s as (select s.frame, s.idx, tx, ty, tz, c.*, 1 / power(greatest(sqrt(power({NOISE_X}, 2) + power({NOISE_Y}, 2)), 0.1e0), 2) as w
          from {SEEN} s join (select camera as cam, * exclude (camera) from {cameras_sql()} k) c on s.camera = c.cam),
        q as (select *, r20*tx + r21*ty + r22*tz + t2 as d, (r00*tx + r01*ty + r02*tz + t0) / (r20*tx + r21*ty + r22*tz + t2) as a,
          (r10*tx + r11*ty + r12*tz + t1) / (r20*tx + r21*ty + r22*tz + t2) as b from s),
        m as (select frame, idx, {sums} from q group by frame, idx)
        select frame, idx, {", ".join(f"1000 * sqrt(({c}) / {det}) as s{a}_mm" for a, c in zip(axes, cofactors))} from m"""


@query("c7b_position_sigma_pinhole", ints="frame idx", reals="sx_mm sy_mm sz_mm", sql=_sigma_sql())
def _(t):
    obs, cams = observed(t, noise=True, dist=(0.0,) * 5)
    points = truth(t).withColumnsRenamed({"tx": "px", "ty": "py", "tz": "pz"})
    errors = C.reprojection_errors(obs.drop("tx", "ty", "tz"), points, cams, BY)
    sigma = C.position_sigma(errors, cams, ["frame", "idx"])
    return sigma.select("frame", "idx", *[(1000.0 * F.col(f"s{a}")).alias(f"s{a}_mm") for a in "xyz"])


def _skew(v):
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def pairs_sql() -> str:
    """Fundamental matrices of the fixed cameras, for the SQL twins."""
    cams, rows = camera_list(dist=(0.0,) * 5), []
    for a in cams:
        for b in cams:
            if a["camera"] < b["camera"]:
                r1, r2 = np.reshape(a["r"], (3, 3)), np.reshape(b["r"], (3, 3))
                rel = r2 @ r1.T
                e = _skew(np.array(b["t"]) - rel @ np.array(a["t"])) @ rel
                k1, k2 = (np.array([[c["k"][0], 0, _CX], [0, c["k"][1], _CY], [0, 0, 1]]) for c in (a, b))
                f = np.linalg.inv(k2).T @ e @ np.linalg.inv(k1)
                cross = int(a["plate_normal"][0] != b["plate_normal"][0])
                rows.append((a["camera"], b["camera"], cross, *[float(v) for v in f.ravel()]))
    return f"(select * from (values {_values(rows)}) as pr(c1, c2, cross_wall, {', '.join(f'f{i}' for i in range(9))}))"


def _line(x, y):
    return [f"(f{3 * i} * {x} + f{3 * i + 1} * {y} + f{3 * i + 2})" for i in range(3)]


def sampson_sql(x1, y1, x2, y2) -> str:
    a, b, c = _line(x1, y1)
    at, bt = (f"(f{i} * {x2} + f{3 + i} * {y2} + f{6 + i})" for i in range(2))
    return f"(power({x2} * {a} + {y2} * {b} + {c}, 2) / ({a}*{a} + {b}*{b} + {at}*{at} + {bt}*{bt}))"


PLAIN = pixels_sql((0.0,) * 5, True)
_A, _B, _C = _line("p.x", "p.y")


@query(
    "c8_epipolar_residuals", ints="c1 c2 n", reals="mean std",
    sql=f"""with o as (select * from {PLAIN} o)
        select c1, c2, count(*) as n, avg(d) as mean, stddev_samp(d) as std from (
          select c1, c2, abs(q.x * {_A} + q.y * {_B} + {_C}) / sqrt({_A}*{_A} + {_B}*{_B}) as d
          from o p join o q on p.frame = q.frame and p.idx = q.idx join {pairs_sql()} f on c1 = p.camera and c2 = q.camera) e
        group by c1, c2""",
)
def _(t):
    obs, cams = observed(t, noise=True, dist=(0.0,) * 5)
    return C.epipolar_residuals(obs, cams, ["frame", "idx"], CAMERAS)


def _count_sql(s1, s2):
    parts = [
        f"case when {sampson_sql(f'p.x{i ^ s1}', f'p.y{i ^ s1}', f'q.x{i ^ s2}', f'q.y{i ^ s2}')} < 25 then 1 else 0 end"
        for i in (0, 1)
    ]
    return f"sum({' + '.join(parts)}) as n{s1}{s2}"


_BITS = ", ".join(f"(k // {2 ** (3 - c)}) % 2 as s{c}" for c in range(4))
_PICK = lambda c: "case " + " ".join(f"when {c} = {i} then s{i}" for i in range(4)) + " end"


@query(
    "c9_swap_search", texts="swaps", ints="rank cross_inliers all_inliers",
    sql=f"""with o as (select frame, camera, max(case when (idx = 0) <> (camera = 1) then x end) as x0, max(case when (idx = 0) <> (camera = 1) then y end) as y0,
          max(case when (idx = 1) <> (camera = 1) then x end) as x1, max(case when (idx = 1) <> (camera = 1) then y end) as y1
          from {PLAIN} o group by frame, camera),
        n as (select c1, c2, cross_wall, {', '.join(_count_sql(a, b) for a in (0, 1) for b in (0, 1))}
          from o p join o q on p.frame = q.frame join {pairs_sql()} f on c1 = p.camera and c2 = q.camera group by c1, c2, cross_wall),
        k as (select k, {_BITS} from (select unnest(range(16)) as k) r),
        h as (select s0, s1, s2, s3, cross_wall, case when {_PICK('c1')} = 0 and {_PICK('c2')} = 0 then n00 when {_PICK('c1')} = 0 then n01
          when {_PICK('c2')} = 0 then n10 else n11 end as hit from n, k),
        g as (select concat(s0, s1, s2, s3) as swaps, sum(hit * cross_wall) as cross_inliers, sum(hit) as all_inliers from h group by 1)
        select * from (select *, row_number() over (order by cross_inliers desc, swaps) as rank from g) r where rank <= 3""",
)
def _(t):
    obs, cams = observed(t, noise=True, dist=(0.0,) * 5)
    obs = obs.withColumn("idx", F.when(F.col("camera") == 1, 1 - F.col("idx")).otherwise(F.col("idx")))
    return C.swap_search(obs, cams, ["frame"], CAMERAS)


@query(
    "c10_truth_errors", ints="run n", reals="mean_mm std_mm max_mm",
    sql=f"""select run, count(*) as n, avg(e) as mean_mm, stddev_samp(e) as std_mm, max(e) as max_mm from
        (select run, 1000 * 0.001e0 * (frame % 5) as e from {TRUTH} t) x group by run""",
)
def _(t):
    points = C.triangulate(C.lines_of_sight(*observed(t)), BY, CAMERAS)
    known = truth(t).withColumn("tx", F.col("tx") + 0.001 * (F.col("frame") % 5))
    return C.truth_errors(points, known, BY, ["run"])


@query(
    "c11_seeding_report", texts="track_check predict_check initial_check", ints="run",
    reals="mean_n std_n cv density spacing_vox moved_vox predict_vox initial_vox tol_px tol_vox",
    sql=f"""with c as (select frame % 10 as run, frame, count(*) as n from {OBS} o group by frame),
        b as (select run, avg(n) as mean_n, stddev_samp(n) as std_n, stddev_samp(n) / avg(n) as cv from c group by run),
        s as (select *, mean_n / 6000e0 as density, power(6000e0 / mean_n, 1e0 / 3) / 0.5e0 as spacing_vox from b)
        select *, 1.6e0 as moved_vox, 4.8e0 as predict_vox, 1.2e0 as tol_px, 0.12e0 as tol_vox, greatest(least(6 * 1.6e0, 0.7e0 * spacing_vox), 3) as initial_vox,
          case when 1.6e0 / spacing_vox < 0.33e0 then 'OK' else 'WARN' end as track_check,
          case when 4.8e0 / spacing_vox < 0.3e0 then 'OK' else 'WARN' end as predict_check,
          case when greatest(least(6 * 1.6e0, 0.7e0 * spacing_vox), 3) / spacing_vox < 0.6e0 then 'OK' else 'WARN' end as initial_check from s""",
)
def _(t):
    counts = t.obs.groupBy("run", "frame").agg(F.count(F.lit(1)).alias("n"))
    return C.seeding_report(
        counts, ["run"], "n", box_mm=(20.0, 20.0, 15.0), voxel_mm=0.5, px_mm=0.05, fps=500.0, velocity=0.4, worst_rms_px=0.4
    )


@query(
    "c12_observation_table", ints="frame camera", reals="xa ya xb yb",
    sql=f"""with p as (select frame, camera, max(case when idx = 0 then x end) as x0, max(case when idx = 0 then y end) as y0,
          max(case when idx = 1 then x end) as x1, max(case when idx = 1 then y end) as y1 from {OBS} o where camera <> 3 group by frame, camera),
        s as (select *, count(*) over (partition by frame) as c from p)
        select frame, camera, case when camera = 1 then x1 else x0 end as xa, case when camera = 1 then y1 else y0 end as ya,
          case when camera = 1 then x0 else x1 end as xb, case when camera = 1 then y0 else y1 end as yb from s where c >= 3""",
)
def _(t):
    return C.observation_table(t.obs, [], "frame", [3], [1], 3)


#: Two cameras of different walls, by frame, whose view of the wand is left as it is.
_PAIR = [(0, 2), (0, 3), (1, 2), (1, 3)]


@query(
    "c13_best_pair", ints="run frame c1 c2", reals="length score px0 py0 pz0 px1 py1 pz1",
    sql=f"""with p as (select run, frame, frame % 4 as k, {", ".join(f"max(case when idx = {i} then t{a} end) as p{a}{i}" for i in (0, 1) for a in "xyz")} from {TRUTH} t group by run, frame),
        c as (select *, case when k < 2 then 0 else 1 end as c1, case when k % 2 = 0 then 2 else 3 end as c2 from p)
        select *, {num(WAND)} as length, 0e0 as score from c where (frame + c1) % 7 <> 0 and (frame + c2) % 7 <> 0""",
)
def _(t):
    """All cameras but two see one end displaced, so the wand of those two is the one that fits."""
    obs, cams = observed(t)
    at = lambda i: F.element_at(F.array(*[F.lit(pair[i]) for pair in _PAIR]), (F.col("frame") % 4 + 1).cast("int"))
    spoilt = (F.col("camera") != at(0)) & (F.col("camera") != at(1)) & (F.col("idx") == 1)
    obs = obs.withColumn("x", F.col("x") + F.when(spoilt, 40.0 + 7 * F.col("camera")).otherwise(0.0))
    best = C.best_pair(obs, cams, ["run"], "frame", CAMERAS, WAND)
    return best.filter(((F.col("frame") + at(0)) % 7 != 0) & ((F.col("frame") + at(1)) % 7 != 0))


# -------------------------------------------------------- gates on detections

PAIRS = f"""(select frame, camera, max(case when idx = 0 then x end) as x0, max(case when idx = 0 then y end) as y0,
    max(case when idx = 1 then x end) as x1, max(case when idx = 1 then y end) as y1,
    max(case when idx = 0 then metric end) as bright, max(case when idx = 1 then metric end) as dim from {OBS} o group by frame, camera)"""


def pairs(t):
    p = J.point_pairs(t.obs, ["frame", "camera"], ["x", "y", "metric"])
    return p.withColumnsRenamed({"metric0": "bright", "metric1": "dim"})


@query("j5_point_pairs", ints="frame camera", reals="x0 y0 x1 y1", sql=f"select * from {PAIRS} p")
def _(t):
    return pairs(t)


@query(
    "f4_length_gate", ints="camera total rejected", reals="pct",
    sql=f"""select camera, count(*) as total, count(*) - sum(ok) as rejected, 100e0 * sum(ok) / count(*) as pct from (
        select camera, case when sqrt(power(x0-x1, 2) + power(y0-y1, 2)) between 40 + 10 * camera and 300 then 1 else 0 end as ok from {PAIRS} p) g
        group by camera""",
)
def _(t):
    lo = Q.per_camera({c: 40.0 + 10 * c for c in CAMERAS})
    return Q.gate_report(Q.length_gate(pairs(t), lo, 300.0), ["camera"])


#: The gate row after row: the state is the last accepted frame and its points.
JUMPS = f"""(with recursive p as materialized (select camera, frame, x0, y0, x1, y1, row_number() over (partition by camera order by frame) as i
      from {PAIRS} s where x0 + y0 + x1 + y1 is not null),
    r as (select camera, i, frame, x0, y0, x1, y1, 1 as ok from p where i = 1 union all
      select camera, i, case when near then frame else f end, case when near then x0 else a0 end, case when near then y0 else b0 end,
        case when near then x1 else a1 end, case when near then y1 else b1 end, case when near then 1 else 0 end
      from (select p.*, r.frame as f, r.x0 as a0, r.y0 as b0, r.x1 as a1, r.y1 as b1,
        greatest(power(p.x0 - r.x0, 2) + power(p.y0 - r.y0, 2), power(p.x1 - r.x1, 2) + power(p.y1 - r.y1, 2)) <= power(60 * least(p.frame - r.frame, 5), 2) as near
        from r join p on p.camera = r.camera and p.i = r.i + 1) q)
    select camera, sum(ok) as kept from r group by camera)"""
JUMP_REPORT = f"""select camera, total, total - kept as rejected, 100e0 * kept / total as pct from {JUMPS} j
    join (select camera, count(*) as total from {PAIRS} p group by camera) c using (camera)"""


@query("f5_jump_gate", ints="camera total rejected", reals="pct", sql=JUMP_REPORT)
def _(t):
    return Q.gate_report(Q.jump_gate(pairs(t), ["camera"], 60.0, size=2048), ["camera"])


@query(
    "f6_brightness_ratio_gate", ints="camera n rejected", reals="mean std least",
    sql=f"""select camera, count(r) as n, avg(r) as mean, stddev_samp(r) as std, min(r) as least,
        count(*) - count(case when r >= 1.4e0 then 1 end) as rejected
        from (select camera, case when dim >= 1e-6 then bright / dim end as r from {PAIRS} p) g group by camera""",
)
def _(t):
    return Q.brightness_report(Q.brightness_ratio_gate(pairs(t), 1.4), ["camera"])


@query(
    "f8_reprojection_gate", ints="run frame idx cameras", reals="worst",
    sql=f"""select run, frame, idx, count(*) as cameras, max(e) as worst from (
        select run, frame, idx, sqrt(power({NOISE_X}, 2) + power({NOISE_Y}, 2)) as e from {SEEN} s) x
        group by run, frame, idx having max(e) <= 0.6e0""",
)
def _(t):
    obs, cams = observed(t, noise=True)
    points = truth(t).withColumnsRenamed({"tx": "px", "ty": "py", "tz": "pz"})
    errors = C.reprojection_errors(obs.drop("tx", "ty", "tz"), points, cams, BY)
    return Q.reprojection_gate(errors, BY, "err", 0.6)


@query(
    "f8b_min_cameras", ints="frame camera idx",
    sql=f"""select frame, camera, idx from (select *, count(*) over (partition by frame, idx) as c from {OBS} o) x where c >= 4""",
)
def _(t):
    return Q.min_cameras(t.obs, ["frame", "idx"], n=4)


COMPLETE = f"(select frame from {OBS} o group by frame having count(*) = 8 and count(distinct camera * 2 + idx) = 8)"


@query("j4_frames_seen_by_all", ints="frame camera idx", reals="x y",
       sql=f"select * from {OBS} o where frame in (select frame from {COMPLETE} c)")
def _(t):
    return J.frames_seen_by_all(t.obs, 4)


@query(
    "j6_camera_pairs", ints="frame idx c1 c2", reals="dx",
    sql=f"""select p.frame, p.idx, p.camera as c1, q.camera as c2, p.x - q.x as dx from {OBS} p join {OBS} q
        on p.frame = q.frame and p.idx = q.idx and p.camera < q.camera""",
)
def _(t):
    rows = J.camera_pairs(t.obs, ["frame", "idx"], CAMERAS, ["x", "y"])
    return rows.withColumn("dx", F.col("x_1") - F.col("x_2"))


# ------------------------------------------------------ files and round trips


@query(
    "s4_read_observations", texts="status", ints="camera n", reals="x metric",
    sql=f"""select case when idx = 0 then 'Filtered_Small' else 'Filtered_Large' end as status, camera, count(*) as n, avg(x) as x,
        avg(metric) as metric from {OBS} o where frame in (select frame from {COMPLETE} c) group by 1, 2""",
)
def _(t):
    path = scratch_path(t.spark, "observations")
    ST.observation_rows(t.obs, 4).write.option("header", True).csv(path)
    return ST.read_observations(t.spark, path).groupBy("status", "camera").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("metric").alias("metric"))


@query(
    "s5_write_observations", texts="status", ints="frame camera idx", reals="x y radius metric",
    sql=f"""select frame, camera, case when idx = 0 then 'Filtered_Small' else 'Filtered_Large' end as status, idx, x, y, radius, metric
        from {OBS} o where frame in (select frame from {COMPLETE} c)""",
)
def _(t):
    path = scratch_path(t.spark, "observations")
    ST.write_observations(t.obs, path, 4)
    return ST.read_observations(t.spark, path)


def flat_cameras(t):
    """One flat camera row per supplier: the fixed cameras moved a little."""
    cams = camera_list()
    base = t.supplier.select(F.col("s_suppkey").cast("int").alias("cam_id"))
    pick = F.col("cam_id") % 4

    def choose(values):
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (pick + 1).cast("int"))

    names = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    cols = {n: choose([c["k"][i] for c in cams]) for i, n in enumerate(("fx", "fy", "cx", "cy"))}
    cols |= {n: choose([c["dist"][i] for c in cams]) for i, n in enumerate(("k1", "k2", "p1", "p2", "k3"))}
    cols |= {n: choose([c["r"][i] for c in cams]) for i, n in enumerate(names)}
    cols |= {f"t{a}": choose([c["t"][i] for c in cams]) + F.col("cam_id") * 1e-3 for i, a in enumerate("xyz")}
    cols |= {f"centre_{a}": F.lit(0.0) for a in "xyz"} | {"reproj_rms_px": F.lit(1.0)}
    return base.select("cam_id", *[c.cast("double").alias(n) for n, c in cols.items()])


CENTRE_SQL = f"""(select s_suppkey as camera, -(r00*a + r10*b + r20*c) as x, -(r01*a + r11*b + r21*c) as y, -(r02*a + r12*b + r22*c) as z
    from (select s_suppkey, cm.*, t0 + s_suppkey * 1e-3 as a, t1 + s_suppkey * 1e-3 as b, t2 + s_suppkey * 1e-3 as c
          from supplier join {cameras_sql()} cm on cm.camera = s_suppkey % 4) m)"""


@query("s6_read_cameras", ints="camera", reals="x y z", digits=6, sql=f"select * from {CENTRE_SQL} c")
def _(t):
    path = scratch_path(t.spark, "cameras")
    flat_cameras(t).write.option("header", True).csv(path)
    cams = ST.read_cameras(t.spark, path)
    return cams.select("camera", *[F.element_at("centre", i + 1).alias(a) for i, a in enumerate("xyz")])


@query("s7_write_nested", ints="camera", reals="x y z", digits=6, sql=f"select * from {CENTRE_SQL} c")
def _(t):
    path = scratch_path(t.spark, "nested")
    ST.write_nested(ST.camera_rows(flat_cameras(t)), path)
    cams = ST.read_nested(t.spark, path)
    return cams.select("camera", *[F.element_at("centre", i + 1).alias(a) for i, a in enumerate("xyz")])


@query(
    "s8_reconcile", texts="field", ints="frame camera idx", reals="a b",
    sql=f"""select frame, camera, idx, 'x' as field, x as a, case when frame % 9 <> 0 then x + 0.01e0 end as b from {OBS} o where frame % 9 = 0 or frame % 50 = 1
        union all select frame, camera, idx, 'y' as field, y as a, null as b from {OBS} o where frame % 9 = 0""",
)
def _(t):
    a = t.obs.select("frame", "camera", "idx", "x", "y")
    b = a.filter(F.col("frame") % 9 != 0)
    b = b.withColumn("x", F.when(F.col("frame") % 50 == 1, F.col("x") + 0.01).otherwise(F.col("x") + 1e-6))
    return ST.reconcile(a, b, ["frame", "camera", "idx"], ["x", "y"])


@query(
    "s16_save_cases", texts="case_id", ints="n", reals="u",
    sql="select event_type as case_id, count(*) as n, avg(value / 10e0) as u from events group by event_type",
)
def _(t):
    path = scratch_path(t.spark, "cases")
    ST.save_cases(t.signal, path)
    saved = t.spark.read.parquet(path)
    return saved.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("u"))


@query(
    "s17_read_peaks", texts="wing", ints="n", reals="cl1",
    sql="""select 'wing' || cast(l_linenumber % 2 as varchar) as wing, count(*) as n, avg(l_extendedprice / 1e4) as cl1
        from lineitem group by 1""",
)
def _(t):
    paths = {}
    peaks = t.lineitem.select(
        F.col("l_orderkey").cast("double").alias("scenario"), F.col("l_discount").alias("encounter_location"),
        F.col("l_quantity").alias("circulation"), (F.col("l_extendedprice") / 1e4).alias("cl1"), F.col("l_tax").alias("cl2"),
        *[F.lit(0.0).alias(c) for c in ("r", "cl1_se", "cl2_se", "peak_rms", "noise_rms")], "l_linenumber",
    )
    for k in (0, 1):
        paths[f"wing{k}"] = scratch_path(t.spark, f"peaks{k}")
        peaks.filter(F.col("l_linenumber") % 2 == k).drop("l_linenumber").write.option("header", True).csv(paths[f"wing{k}"])
    return ST.read_peaks(t.spark, paths).groupBy("wing").agg(F.count(F.lit(1)).alias("n"), F.avg("cl1").alias("cl1"))

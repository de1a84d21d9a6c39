"""Multi-camera observations: rays, triangulation, projection, quality (C operators).

Camera tables have one row per camera: camera, k (fx fy cx cy), dist (5),
r (9, row-major), t (3), plate_point (3), plate_normal (3, pointing into the
object medium), idx3 (object, plate, outside) and width.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import attach, exact_quantiles, small_table, top_k
from ..functions import optics
from ..functions.linear import solve3, symmetric3
from .joins import camera_pairs, point_pairs

CAMERA_FIELDS = ("k", "dist", "r", "t", "plate_point", "plate_normal", "idx3")


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


class Rig:
    """The cameras as arrays that go to the tasks; a rig has few cameras, which is checked."""

    LIMIT = 1 << 14

    def __init__(self, cams: DataFrame):
        rows = sorted(small_table(cams.select("camera", *CAMERA_FIELDS, "width"), self.LIMIT), key=lambda r: r["camera"])
        self.ids = np.array([r["camera"] for r in rows], np.int64)
        if len(np.unique(self.ids)) != len(rows):
            raise ValueError("a camera is listed twice")
        self.arrays = [np.array([r[f] for r in rows], float) for f in (*CAMERA_FIELDS, "width")]

    def of(self, camera: pd.Series | np.ndarray) -> list[np.ndarray]:
        """The camera of every row; an unknown camera gives NaN."""
        wanted = np.asarray(camera, np.int64)
        at = np.minimum(np.searchsorted(self.ids, wanted), len(self.ids) - 1)
        known = self.ids[at] == wanted
        out = [a[at] for a in self.arrays]
        out[0] = np.where(known[:, None], out[0], np.nan)
        return out


def lines_of_sight(obs: DataFrame, cams: DataFrame) -> DataFrame:
    """Each observed pixel with its ray in the object medium; NULL where the ray is lost."""
    rig = Rig(cams)

    @F.pandas_udf(_doubles("ox", "oy", "oz", "dx", "dy", "dz"))
    def sight(camera: pd.Series, u: pd.Series, v: pd.Series) -> pd.DataFrame:
        o, d = optics.lines_of_sight(u.to_numpy(float), v.to_numpy(float), *rig.of(camera))
        return pd.DataFrame(np.hstack([o, d]), columns=["ox", "oy", "oz", "dx", "dy", "dz"])

    seen = obs.dropna(subset=["camera", "x", "y"])
    # "Nondeterministic" keeps filters on the result from running the function a second time.
    rays = seen.withColumn("_ray", sight.asNondeterministic()("camera", "x", "y"))
    parts = {c: F.col("_ray")[c] for c in ("ox", "oy", "oz", "dx", "dy", "dz")}
    rays = rays.withColumns({c: F.when(~F.isnan(v), v) for c, v in parts.items()})
    return rays.drop("_ray")


def _projector(o: Sequence[Column], d: Sequence[Column]):
    """Terms of I - d dᵀ and of (I - d dᵀ) o."""
    m = {}
    for i, a in enumerate("xyz"):
        for j, b in enumerate("xyz"):
            if j >= i:
                m[a + b] = (1.0 if i == j else 0.0) - d[i] * d[j]
    along = d[0] * o[0] + d[1] * o[1] + d[2] * o[2]
    return m, [o[i] - d[i] * along for i in range(3)]


def ray_point_distance(o: Sequence[Column], d: Sequence[Column], p: Sequence[Column]) -> Column:
    """Distance of a point from a ray (unit direction)."""
    delta = [p[i] - o[i] for i in range(3)]
    along = delta[0] * d[0] + delta[1] * d[1] + delta[2] * d[2]
    return F.sqrt(sum((F.pow(delta[i] - along * d[i], 2) for i in range(3)), F.lit(0.0)))


_AXES = tuple(a + b for i, a in enumerate("xyz") for b in "xyz"[i:])


def triangulate(rays: DataFrame, by: Sequence[str], cameras: Sequence[int] | None = None) -> DataFrame:
    """Least-squares closest point of each group of rays: px, py, pz, rays, residual.

    With the list of cameras, one aggregate puts the rays of a point side by side
    (one per camera); points and mean distances are then solved in batches.
    Without it, nine sums give the point and a join with the rays the distance.
    """
    names = ["ox", "oy", "oz", "dx", "dy", "dz"]
    good = rays.dropna(subset=names)
    if cameras is not None:
        return _triangulate_side_by_side(good, by, sorted(cameras))
    o, d = [F.col(c) for c in names[:3]], [F.col(c) for c in names[3:]]
    m, b = _projector(o, d)
    sums = good.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rays"),
        *[F.sum(m[k]).alias(f"_m{k}") for k in _AXES],
        *[F.sum(c).alias(f"_b{i}") for i, c in enumerate(b)],
    )
    p = solve3({k: F.col(f"_m{k}") for k in _AXES}, tuple(F.col(f"_b{i}") for i in range(3)))
    points = sums.select(*by, "rays", *[c.alias(f"p{a}") for a, c in zip("xyz", p)])
    both = good.select(*by, *o, *d).join(points, list(by))
    gap = ray_point_distance(o, d, [F.col(f"p{a}") for a in "xyz"])
    resid = both.groupBy(*by).agg(
        F.max("rays").alias("rays"), *[F.max(f"p{a}").alias(f"p{a}") for a in "xyz"], F.avg(gap).alias("residual")
    )
    return resid.dropna(subset=["px", "py", "pz"])


def _triangulate_side_by_side(good: DataFrame, by: Sequence[str], cameras: Sequence[int]) -> DataFrame:
    names = ["ox", "oy", "oz", "dx", "dy", "dz"]
    by = list(by)
    wide = good.groupBy(*by).agg(
        *[F.max(F.when(F.col("camera") == c, F.struct(*names))).alias(f"_r{c}") for c in cameras]
    )
    flat = wide.select(*by, *[F.col(f"_r{c}")[n].alias(f"_{n}{c}") for c in cameras for n in names])
    columns = [f"_{n}{c}" for c in cameras for n in names]
    eye = np.eye(3)

    def closest(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            data = pdf[columns].to_numpy(float).reshape(len(pdf), len(cameras), 2, 3)
            o, d = data[:, :, 0], data[:, :, 1]
            seen = np.isfinite(d[:, :, 0])
            m = np.where(seen[:, :, None, None], eye - d[:, :, :, None] * d[:, :, None, :], 0.0)
            o = np.where(seen[:, :, None], o, 0.0)
            a = m.sum(axis=1)
            good_rows = np.abs(np.linalg.det(a)) > 1e-12 * (np.trace(a, axis1=1, axis2=2) / 3) ** 3
            p = np.full((len(pdf), 3), np.nan)
            rhs = np.einsum("ncij,ncj->ni", m, o)
            p[good_rows] = np.linalg.solve(a[good_rows], rhs[good_rows][:, :, None])[:, :, 0]
            gap = np.sqrt((np.einsum("ncij,ncj->nci", m, p[:, None] - o) ** 2).sum(axis=2))
            out = pdf[by].copy()
            out["rays"] = seen.sum(axis=1)
            out[["px", "py", "pz"]] = p
            out["residual"] = gap.sum(axis=1) / np.maximum(out["rays"].to_numpy(), 1)
            yield out[good_rows]

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wide.schema.fields if f.name in by)
    return flat.mapInPandas(closest, schema + "rays bigint, px double, py double, pz double, residual double")


def wand_lengths(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both triangulated ends of a frame side by side, with their distance."""
    pairs = point_pairs(points, by, ["px", "py", "pz", "residual"])
    d2 = sum((F.pow(F.col(f"p{a}0") - F.col(f"p{a}1"), 2) for a in "xyz"), F.lit(0.0))
    return pairs.withColumn("length", F.sqrt(d2))


def wand_qc(points: DataFrame, by: Sequence[str], frame: str, length: float, tol: float, resid_tol: float) -> DataFrame:
    """Mean and spread of the wand length, its error, mean depth and residual, verdict."""
    wands = wand_lengths(points, [*by, frame])
    out = wands.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg("length").alias("mean_length"),
        F.stddev_samp("length").alias("std_length"),
        F.avg((F.col("pz0") + F.col("pz1")) / 2).alias("mean_depth"),
        F.avg((F.col("residual0") + F.col("residual1")) / 2).alias("mean_residual"),
    )
    error = F.col("mean_length") - length
    ok = (F.abs(error) <= tol) & (F.col("mean_residual") <= resid_tol)
    return out.withColumn("error_pct", 100.0 * error / length).withColumn(
        "verdict", F.when(ok, "PASS").otherwise("FAIL")
    )


def project(points: DataFrame, cams: DataFrame, image: tuple[int, int] | None = None) -> DataFrame:
    """Pixels u, v of points px, py, pz in the camera named per row, and whether they are in the image."""
    rig = Rig(cams)

    @F.pandas_udf(_doubles("u", "v"))
    def pixel(camera: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        at = np.stack([x.to_numpy(float), y.to_numpy(float), z.to_numpy(float)], axis=1)
        u, v = optics.project(at, *rig.of(camera))
        return pd.DataFrame({"u": u, "v": v})

    rows = points.dropna(subset=["camera", "px", "py", "pz"]).withColumn(
        "_uv", pixel.asNondeterministic()("camera", "px", "py", "pz")
    )
    rows = rows.withColumns({c: F.when(~F.isnan(F.col("_uv")[c]), F.col("_uv")[c]) for c in "uv"}).drop("_uv")
    if image is None:
        return rows
    seen = F.col("u").between(0, image[0] - 1) & F.col("v").between(0, image[1] - 1)
    return rows.withColumn("in_image", F.coalesce(seen, F.lit(False)))


def reprojection_errors(obs: DataFrame, points: DataFrame, cams: DataFrame, by: Sequence[str]) -> DataFrame:
    """Observations with the projection of their point and the pixel distance ``err``."""
    both = obs.join(points.select(*by, "px", "py", "pz"), list(by))
    seen = project(both, cams)
    return seen.withColumn("err", F.sqrt(F.pow(F.col("u") - F.col("x"), 2) + F.pow(F.col("v") - F.col("y"), 2)))


#: Points whose rays are looked at together.
TOGETHER = 4096


def _gathered(obs: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per point: the pixels seen of it as a list, and the number of its cameras.

    The pixels are what is shuffled, once and before they are grouped, so that no task
    sorts its whole share of the observations; rays, points and errors follow from them.
    A missing key belongs to no point, so such rows count cameras and have no list.
    """
    pixel = F.struct("camera", "x", "y")
    whole = [F.col(c).isNotNull() for c in by]
    rows = obs.select(*by, F.col("camera").cast("bigint"), F.col("x").cast("double"), F.col("y").cast("double"))
    return rows.repartition(*by).groupBy(*by).agg(
        F.collect_list(F.when(functools.reduce(Column.__and__, whole), pixel)).alias("seen"),
        F.size(F.collect_set("camera")).cast("bigint").alias("cameras"),
    )


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(start, TOGETHER)


def _closest(point: np.ndarray, n: int, o: np.ndarray, d: np.ndarray):
    """Rays and closest point of each of ``n`` points, mean distance, and whether there is a point."""
    m = np.eye(3) - d[:, :, None] * d[:, None, :]
    rays = np.bincount(point, minlength=n)
    a = symmetric3(np.stack([np.bincount(point, m[:, i, j], n) for i in range(3) for j in range(i, 3)], axis=1))
    b = np.einsum("nij,nj->ni", m, o)
    rhs = np.stack([np.bincount(point, b[:, i], n) for i in range(3)], axis=1)
    found = np.abs(np.linalg.det(a)) > 1e-12 * (np.trace(a, axis1=1, axis2=2) / 3) ** 3
    p = np.full((n, 3), np.nan)
    p[found] = np.linalg.solve(a[found], rhs[found][:, :, None])[:, :, 0]
    gap = np.sqrt((np.einsum("nij,nj->ni", m, p[point] - o) ** 2).sum(axis=1))
    return rays, p, np.bincount(point, gap, n) / np.maximum(rays, 1), found


def _one_per_camera(point: np.ndarray, camera: np.ndarray, ray: np.ndarray) -> np.ndarray:
    """Places of the rays that count when a camera has one ray for a point: the largest."""
    order = np.lexsort((*ray.T[::-1], camera, point))
    point, camera = point[order], camera[order]
    last = np.ones(len(order), bool)
    last[:-1] = (point[1:] != point[:-1]) | (camera[1:] != camera[:-1])
    return order[last]


def _locator(rig: Rig, cameras: Sequence[int] | None):
    """From lists of pixels: rays, closest points as in ``triangulate``, and the pixel error of every observation."""

    def locate(lists: pa.ListArray) -> dict[str, np.ndarray]:
        n, flat = len(lists), lists.flatten()
        point = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        fields = {c: flat.field(c) for c in ("camera", "x", "y")}
        given = {c: ~f.is_null().to_numpy(zero_copy_only=False).astype(bool) for c, f in fields.items()}
        camera = fields["camera"].fill_null(0).to_numpy(zero_copy_only=False)
        x, y = (fields[c].to_numpy(zero_copy_only=False).astype(float) for c in "xy")
        cam = rig.of(camera)
        with np.errstate(all="ignore"):
            o, d = optics.lines_of_sight(x, y, *cam)
            ray = np.hstack([o, d])
            good = given["camera"] & ~np.isnan(ray).any(axis=1) & ~np.isnan(x) & ~np.isnan(y)
            if cameras is not None:
                good = np.flatnonzero(good & np.isin(camera, list(cameras)))
                good = good[_one_per_camera(point[good], camera[good], ray[good])]
            rays, p, residual, found = _closest(point[good], n, o[good], d[good])
            u, v = optics.project(p[point], *cam)
            err = np.sqrt((u - x) ** 2 + (v - y) ** 2)
        judged = functools.reduce(np.logical_and, [*given.values(), found[point], ~np.isnan(u), ~np.isnan(v)])
        return {"point": point, "camera": camera, "x": x, "y": y, "rays": rays, "p": p, "residual": residual, "found": found, "u": u, "v": v, "err": err, "judged": judged}

    return locate


def located_errors(obs: DataFrame, cams: DataFrame, by: Sequence[str], cameras: Sequence[int] | None = None) -> DataFrame:
    """The observations of every point that has one, with the point, its projection and the pixel distance ``err``.

    The same as ``lines_of_sight``, ``triangulate`` and ``reprojection_errors`` one after
    the other, but the pixels are shuffled once: neither rays (six numbers each) nor
    points and pixels again for a join.  Observations without an error are left out.
    """
    by = list(by)
    gathered = _gathered(obs.dropna(subset=by), by)
    kinds = [f for f in gathered.schema.fields if f.name in by]
    schema = T.StructType([*kinds, T.StructField("camera", T.LongType()), *_doubles("x", "y", "px", "py", "pz", "u", "v", "err")])
    locate = _locator(Rig(cams), cameras)

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in _parts(batches):
            at = locate(batch.column("seen"))
            kept = np.flatnonzero(at["judged"])
            point = at["point"][kept]
            own = [batch.column(c).take(pa.array(point)) for c in by]
            values = [at["camera"][kept], at["x"][kept], at["y"][kept], *at["p"][point].T, *[at[c][kept] for c in ("u", "v", "err")]]
            yield pa.record_batch([*own, *[pa.array(v) for v in values]], names=schema.names)

    return gathered.mapInArrow(judged, schema)


def grade(rms: Column) -> Column:
    # Fixed limits of the quality grades in pixels.
    return F.when(rms < 0.5, "excellent").when(rms < 1.0, "acceptable").otherwise("poor")


def reprojection_rms(errors: DataFrame, by: Sequence[str], frame: str) -> DataFrame:
    """RMS error per camera, per frame and overall (NULL keys), graded."""
    sets = [[*by, "camera"], [*by, frame], list(by)]
    out = errors.groupingSets(sets, *by, "camera", frame).agg(
        F.count("err").alias("n"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rms")
    )
    return out.withColumn("grade", grade(F.col("rms")))


def reconstruct(
    obs: DataFrame, cams: DataFrame, by: Sequence[str], min_cameras: int = 2, max_px: float = 2.0,
    cameras: Sequence[int] | None = None,
) -> DataFrame:
    """Every particle with position, cameras seen, errors and status.

    Status is OK, FEW_CAMERAS, NO_POINT or HIGH_ERROR, so that counts per status
    account for all particles.  The observations are shuffled once; see ``located_errors``.
    """
    by = list(by)
    gathered = _gathered(obs, by)
    kinds = [f for f in gathered.schema.fields if f.name in by]
    found = ["rays", "px", "py", "pz", "residual", "max_err", "mean_err"]
    schema = T.StructType([*kinds, T.StructField("cameras", T.LongType()), T.StructField("rays", T.LongType()), *_doubles(*found[1:])])
    locate = _locator(Rig(cams), cameras)

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in _parts(batches):
            n = batch.num_rows
            at = locate(batch.column("seen"))
            point, err = at["point"][at["judged"]], at["err"][at["judged"]]
            times, worst = np.bincount(point, minlength=n), np.full(n, -np.inf)
            with np.errstate(invalid="ignore"):  # NaN counts as the largest, as in Spark
                np.maximum.at(worst, point, err)
            mean = np.bincount(point, err, n) / np.maximum(times, 1)
            values = [at["rays"], *at["p"].T, at["residual"], worst, mean]
            lacks = [~at["found"]] * 5 + [times == 0] * 2
            columns = [pa.array(v, mask=m) for v, m in zip(values, lacks, strict=True)]
            yield pa.record_batch([*[batch.column(c) for c in (*by, "cameras")], *columns], names=schema.names)

    out = gathered.mapInArrow(judged, schema)
    status = (
        F.when(F.col("cameras") < min_cameras, "FEW_CAMERAS")
        .when(F.col("px").isNull() | F.col("max_err").isNull(), "NO_POINT")
        .when(F.col("max_err") > max_px, "HIGH_ERROR")
        .otherwise("OK")
    )
    return out.withColumn("status", status)


def reconstruction_counts(recon: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return recon.groupBy(*by, "status").agg(
        F.count(F.lit(1)).alias("n"), F.avg("cameras").alias("cameras"), F.avg("mean_err").alias("mean_err")
    )


def _own_range_histogram(df: DataFrame, value: str, bins: int, by: Sequence[str]) -> DataFrame:
    """Rows per equal-width bin of a group's own range, with the bin's edges; the last bin is closed, empty ones are left out."""
    by = list(by)
    box = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    number = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1).cast("bigint"))
    placed = attach(df.dropna(subset=[value]), box, by).withColumn("bin", F.when(width > 0, number).otherwise(F.lit(0).cast("bigint")))
    return placed.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("_lo") + F.col("bin") * width).alias("lo"), F.max(F.col("_lo") + (F.col("bin") + 1) * width).alias("hi")
    )


def error_histogram(errors: DataFrame, by: Sequence[str] = (), bins: int = 50) -> DataFrame:
    """Reprojection errors of all observations in ``bins`` bins over their range."""
    return _own_range_histogram(errors, "err", bins, by)


def camera_errors(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and largest reprojection error of each camera."""
    return errors.groupBy(*by, "camera").agg(F.count("err").alias("n"), F.avg("err").alias("mean_err"), F.max("err").alias("max_err"))


def wand_histogram(points: DataFrame, by: Sequence[str], frame: str, length: float, bins: int = 30) -> DataFrame:
    """Reconstructed wand lengths in millimetres in ``bins`` bins, beside their mean, spread and error in percent."""
    by = list(by)
    wands = wand_lengths(points, [*by, frame]).withColumn("mm", 1000.0 * F.col("length"))
    whole = wands.groupBy(*by).agg(F.avg("mm").alias("mean_mm"), F.stddev_samp("mm").alias("std_mm"))
    whole = whole.withColumn("error_pct", 100.0 * F.abs(F.col("mean_mm") - 1000.0 * length) / (1000.0 * length))
    return attach(_own_range_histogram(wands, "mm", bins, by), whole, by)


def position_sigma(
    errors: DataFrame, cams: DataFrame, by: Sequence[str], step: float = 1e-6, floor: float = 0.1
) -> DataFrame:
    """One-sigma position error per point from the projection Jacobians of its cameras.

    ``errors`` holds px, py, pz, camera and err per observation.  Six shifted
    projections per observation give the Jacobian; JᵀW⁻¹J is summed per point and
    inverted in batches; rank-deficient points get infinity.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in errors.schema.fields if f.name in by)
    rig = Rig(cams)

    def normal_terms(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            cam = rig.of(pdf["camera"])
            x = pdf[["px", "py", "pz"]].to_numpy(float)
            jac = np.empty((len(pdf), 2, 3))
            for a in range(3):
                shift = np.zeros(3)
                shift[a] = step
                hi = np.stack(optics.project(x + shift, *cam), axis=1)
                lo = np.stack(optics.project(x - shift, *cam), axis=1)
                jac[:, :, a] = (hi - lo) / (2 * step)
            weight = 1 / np.maximum(pdf["err"].to_numpy(float), floor) ** 2
            m = np.einsum("nki,nkj,n->nij", jac, jac, weight)
            out = pdf[list(by)].copy()
            for k, (i, j) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
                out[f"m{k}"] = m[:, i, j]
            yield out.dropna(subset=[f"m{k}" for k in range(6)])

    terms = errors.select(*by, "camera", "px", "py", "pz", "err").dropna().mapInPandas(
        normal_terms, schema + "".join(f", m{k} double" for k in range(6))
    )
    sums = terms.groupBy(*by).agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in range(6)])

    def invert(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            m = symmetric3(pdf[[f"m{k}" for k in range(6)]].to_numpy(float))
            eig, vec = np.linalg.eigh(m)
            full = eig[:, 0] > 1e-14 * np.maximum(eig[:, 2], 1e-300)
            with np.errstate(all="ignore"):
                var = np.einsum("nij,nj,nij->ni", vec, 1 / eig, vec)
            sigma = np.where(full[:, None], np.sqrt(np.maximum(var, 0)), np.inf)
            out = pdf[list(by)].copy()
            out[["sx", "sy", "sz"]] = sigma
            yield out

    return sums.mapInPandas(invert, schema + ", sx double, sy double, sz double")


# ------------------------------------------------------------ epipolar checks


def _arr(c: str, i: int) -> Column:
    return F.element_at(F.col(c), i + 1)


def _fundamental() -> list[list[Column]]:
    """F from the poses r_1, t_1, k_1 and r_2, t_2, k_2 as nine expressions."""
    r1 = [[_arr("r_1", 3 * i + j) for j in range(3)] for i in range(3)]
    r2 = [[_arr("r_2", 3 * i + j) for j in range(3)] for i in range(3)]
    rel = [[sum((r2[i][m] * r1[j][m] for m in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    t1, t2 = [_arr("t_1", i) for i in range(3)], [_arr("t_2", i) for i in range(3)]
    t = [t2[i] - sum((rel[i][m] * t1[m] for m in range(3)), F.lit(0.0)) for i in range(3)]
    essential = [
        [t[(i + 1) % 3] * rel[(i + 2) % 3][j] - t[(i + 2) % 3] * rel[(i + 1) % 3][j] for j in range(3)]
        for i in range(3)
    ]
    def left(i, j):  # transposed inverse of the second intrinsics
        fx, fy, cx, cy = (_arr("k_2", m) for m in range(4))
        e = essential
        return (e[0][j] / fx, e[1][j] / fy, e[2][j] - cx / fx * e[0][j] - cy / fy * e[1][j])[i]

    fx, fy, cx, cy = (_arr("k_1", m) for m in range(4))
    return [
        [left(i, 0) / fx, left(i, 1) / fy, left(i, 2) - left(i, 0) * cx / fx - left(i, 1) * cy / fy]
        for i in range(3)
    ]


#: Cameras whose pairs are listed, and cameras whose swaps are.
MAX_PAIRED, MAX_SWAPPED = 256, 12


def pair_geometry(cams: DataFrame) -> DataFrame:
    """One row per camera pair c1 < c2: fundamental matrix f (9) and whether their walls differ.

    The cameras are gathered in one checked list, whose pairs are listed without a join.
    """
    fields = ("k", "r", "t", "plate_normal")
    listed = cams.select(F.struct("camera", *fields).alias("c")).agg(F.sort_array(F.collect_list("c")).alias("l"))
    checked = F.when(F.size("l") <= MAX_PAIRED, F.col("l")).otherwise(F.raise_error(F.lit("too many cameras to pair")))
    both = F.flatten(F.transform("l", lambda a: F.transform("l", lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = listed.select(checked.alias("l")).select(F.explode(F.filter(both, lambda p: p["a"]["camera"] < p["b"]["camera"])).alias("p"))
    pairs = pairs.select(
        *[F.col(f"p.{side}.camera").alias(f"c{i}") for i, side in ((1, "a"), (2, "b"))],
        *[F.col(f"p.{side}.{f}").alias(f"{f}_{i}") for i, side in ((1, "a"), (2, "b")) for f in fields],
    )
    f = _fundamental()
    cross = _arr("plate_normal_1", 0) != _arr("plate_normal_2", 0)
    return pairs.select(
        "c1", "c2", F.array(*[c for row in f for c in row]).alias("f"), cross.alias("cross_wall")
    )


def _lines(x1: Column, y1: Column) -> list[Column]:
    return [_arr("f", 3 * i) * x1 + _arr("f", 3 * i + 1) * y1 + _arr("f", 3 * i + 2) for i in range(3)]


def epipolar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of the second pixel from the line of the first."""
    a, b, c = _lines(x1, y1)
    return F.abs(x2 * a + y2 * b + c) / F.sqrt(a * a + b * b)


def sampson_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """First-order squared epipolar distance."""
    a, b, c = _lines(x1, y1)
    at = _arr("f", 0) * x2 + _arr("f", 3) * y2 + _arr("f", 6)
    bt = _arr("f", 1) * x2 + _arr("f", 4) * y2 + _arr("f", 7)
    value = x2 * a + y2 * b + c
    return value * value / (a * a + b * b + at * at + bt * bt)


def epipolar_residuals(
    obs: DataFrame, cams: DataFrame, by: Sequence[str], cameras: Sequence[int], group: Sequence[str] = ()
) -> DataFrame:
    """Mean and spread of the point-to-line distance of every camera pair."""
    pairs = camera_pairs(obs, by, cameras, ["x", "y"]).join(pair_geometry(cams), ["c1", "c2"])
    d = epipolar_distance(F.col("x_1"), F.col("y_1"), F.col("x_2"), F.col("y_2"))
    return pairs.groupBy(*group, "c1", "c2").agg(
        F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std")
    )


def swap_search(
    obs: DataFrame, cams: DataFrame, by: Sequence[str], cameras: Sequence[int],
    limit_px: float = 5.0, top: int = 3, min_shared: int = 20, group: Sequence[str] = (),
) -> DataFrame:
    """All combinations of A/B swaps per camera, ranked by cross-wall inliers.

    The inliers of a camera pair depend only on the swaps of its own two cameras,
    so one aggregate gives four counts per pair and the 2^n combinations are sums
    of those counts.
    """
    sides = point_pairs(obs, [*by, "camera"], ["x", "y"])
    pairs = camera_pairs(sides, by, cameras, ["x0", "y0", "x1", "y1"]).join(pair_geometry(cams), ["c1", "c2"])

    def inliers(s1: int, s2: int) -> Column:
        total = F.lit(0)
        for p in (0, 1):
            i, j = p ^ s1, p ^ s2
            d = sampson_distance(F.col(f"x{i}_1"), F.col(f"y{i}_1"), F.col(f"x{j}_2"), F.col(f"y{j}_2"))
            total = total + F.when(d < limit_px * limit_px, 1).otherwise(0)
        return F.sum(total)

    counts = pairs.groupBy(*group, "c1", "c2", "cross_wall").agg(
        F.count(F.lit(1)).alias("shared"),
        *[inliers(a, b).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)],
    ).filter(F.col("shared") * 2 >= min_shared)
    if len(cameras) > MAX_SWAPPED:
        raise ValueError(f"the swaps of {len(cameras)} cameras are too many to list")
    combos = list(itertools.product((0, 1), repeat=len(cameras)))
    position = {c: k for k, c in enumerate(sorted(cameras))}
    place = F.create_map(*[x for c, k in position.items() for x in (F.lit(c), F.lit(k))])
    listed = F.array(*[F.struct(F.lit("".join(map(str, c))).alias("swaps"), F.array(*map(F.lit, c)).alias("s")) for c in combos])
    rows = counts.withColumn("_c", F.explode(listed))
    a = F.element_at("_c.s", place[F.col("c1")] + 1)
    b = F.element_at("_c.s", place[F.col("c2")] + 1)
    hit = (
        F.when((a == 0) & (b == 0), F.col("n00")).when((a == 0) & (b == 1), F.col("n01"))
        .when((a == 1) & (b == 0), F.col("n10")).otherwise(F.col("n11"))
    )
    scores = rows.groupBy(*group, F.col("_c.swaps").alias("swaps")).agg(
        F.sum(F.when(F.col("cross_wall"), hit).otherwise(0)).alias("cross_inliers"), F.sum(hit).alias("all_inliers")
    )
    return top_k(scores, group, [F.desc("cross_inliers"), F.asc("swaps")], top)


def truth_errors(points: DataFrame, truth: DataFrame, by: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Distance of points to the known positions (tx, ty, tz): mean, std and max in millimetres."""
    d2 = sum((F.pow(F.col(f"p{a}") - F.col(f"t{a}"), 2) for a in "xyz"), F.lit(0.0))
    mm = 1000.0 * F.sqrt(d2)
    return points.join(truth, list(by)).groupBy(*group).agg(
        F.count(mm).alias("n"), F.avg(mm).alias("mean_mm"), F.stddev_samp(mm).alias("std_mm"), F.max(mm).alias("max_mm")
    )


# Fixed values of the seeding report: limits of the ratios to the spacing, the full
# width at half maximum of a Gaussian over its sigma, the variation of the counts
# from which a film counts as contaminated.
RATIO_LIMITS = (("track", "moved_vox", 0.33), ("predict", "predict_vox", 0.30), ("initial", "initial_vox", 0.60))
FWHM = 2.3548
VARIES = 0.15


def seeding_report(
    counts: DataFrame, by: Sequence[str], count: str, *, box_mm: tuple[float, float, float], voxel_mm: float,
    px_mm: float, fps: float, velocity: float, worst_rms_px: float, efficiency: float = 1.0,
    predict_factor: float = 3.0, initial_factor: float = 6.0, tolerance_factor: float = 3.0,
    neighbours: DataFrame | None = None, widths: DataFrame | None = None,
) -> DataFrame:
    """Density, spacing, displacement, search radii and OK/WARN ratios from counts per frame.

    ``neighbours`` (by, dist) are distances in pixels to the nearest neighbour in an
    image, whose median is a lower bound of the spacing; ``widths`` (by, sigma) are
    widths of particle images in pixels.  A group without them has NULL there.
    """
    volume = box_mm[0] * box_mm[1] * box_mm[2]
    base = counts.groupBy(*by).agg(
        (F.avg(count) * efficiency).alias("mean_n"),
        F.stddev_samp(count).alias("std_n"),
        (F.stddev_samp(count) / F.avg(count)).alias("cv"),
    )
    moved = velocity / fps * 1000.0 / voxel_mm
    out = base.withColumn("density", F.col("mean_n") / volume)
    out = out.withColumn("spacing_vox", F.pow(volume / F.col("mean_n"), 1.0 / 3.0) / voxel_mm)
    spacing = F.col("spacing_vox")
    out = out.withColumns(
        {
            "moved_vox": F.lit(moved),
            "predict_vox": F.lit(max(2.0, predict_factor * moved)),
            "initial_vox": F.greatest(F.least(F.lit(initial_factor * moved), 0.7 * spacing), F.lit(3.0)),
            "tol_px": F.lit(tolerance_factor * worst_rms_px),
            "tol_vox": F.lit(tolerance_factor * worst_rms_px * px_mm / voxel_mm),
        }
    )
    if neighbours is not None:
        near = exact_quantiles(neighbours, by, "dist", {"nn_px": 0.5})
        out = attach(out, near, by, "left").withColumn("nn_vox", F.col("nn_px") * (px_mm / voxel_mm))
        out = out.withColumn("nn_check", F.when(F.col("nn_vox") <= spacing, "OK").when(F.col("nn_vox") > spacing, "WARN"))
    if widths is not None:
        sizes = exact_quantiles(widths, by, "sigma", {"sigma_px": 0.5})
        out = attach(out, sizes, by, "left").withColumn("fwhm_px", FWHM * F.col("sigma_px"))
    out = out.withColumn("contaminated", F.coalesce(F.col("cv") > VARIES, F.lit(False)))
    for name, part, limit in RATIO_LIMITS:
        ratio = F.col(part) / spacing
        out = out.withColumn(f"{name}_check", F.when(ratio < limit, "OK").otherwise("WARN"))
    return out


def observation_table(
    obs: DataFrame, by: Sequence[str], frame: str, exclude: Sequence[int] = (), swapped: Sequence[int] = (),
    min_cameras: int = 2,
) -> DataFrame:
    """One row per (frame, camera) with points A and B; swaps applied, thin frames dropped."""
    kept = obs.filter(~F.col("camera").isin(list(exclude))) if exclude else obs
    pairs = point_pairs(kept, [*by, frame, "camera"], ["x", "y"])
    swap = F.col("camera").isin(list(swapped)) if swapped else F.lit(False)
    sides = pairs.select(
        *by, frame, "camera",
        F.when(swap, F.col("x1")).otherwise(F.col("x0")).alias("xa"),
        F.when(swap, F.col("y1")).otherwise(F.col("y0")).alias("ya"),
        F.when(swap, F.col("x0")).otherwise(F.col("x1")).alias("xb"),
        F.when(swap, F.col("y0")).otherwise(F.col("y1")).alias("yb"),
    )
    enough = sides.groupBy(*by, frame).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= min_cameras)
    return sides.join(enough.select(*by, frame), [*by, frame], "left_semi")


def best_pair(
    obs: DataFrame, cams: DataFrame, by: Sequence[str], frame: str, cameras: Sequence[int], length: float,
    lo: float = 0.01, hi: float = 1.0, same_wall_penalty: float = 0.5,
) -> DataFrame:
    """Per frame the camera pair whose triangulated wand length is most plausible.

    One shuffle puts the rays of a frame side by side; the closest points of two rays
    have a closed form, and all pairs of a frame are judged in Arrow batches.
    """
    rays = lines_of_sight(obs, cams).dropna(subset=["ox", "dx"])
    names = ["ox", "oy", "oz", "dx", "dy", "dz"]
    cameras = sorted(cameras)
    ray = F.struct(*names)
    wide = rays.groupBy(*by, frame).agg(
        *[F.max(F.when((F.col("camera") == c) & (F.col("idx") == i), ray)).alias(f"_r{c}_{i}") for c in cameras for i in (0, 1)]
    )
    columns = [f"_{n}{c}_{i}" for c in cameras for i in (0, 1) for n in names]
    flat = wide.select(*by, frame, *[F.col(f"_r{c}_{i}")[n].alias(f"_{n}{c}_{i}") for c in cameras for i in (0, 1) for n in names])
    # one row for each two cameras of a checked list
    walls = {(r["c1"], r["c2"]): r["cross_wall"] for r in small_table(pair_geometry(cams).select("c1", "c2", "cross_wall"), MAX_PAIRED**2)}
    listed = [(a, b, c1, c2) for (a, c1), (b, c2) in itertools.combinations(enumerate(cameras), 2) if (c1, c2) in walls]
    kinds = {f.name: f.dataType for f in wide.schema.fields}
    fields = [T.StructField(c, T.IntegerType()) for c in ("c1", "c2")] + [T.StructField(c, T.DoubleType()) for c in ("length", "score", *[f"p{a}{i}" for i in (0, 1) for a in "xyz"])]
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in (*by, frame)], *fields])

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            rays = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
            rays = rays.reshape(n, len(cameras), 2, 2, 3)
            best, pair = np.full((n, 8), np.nan), np.zeros((n, 2), np.int32)
            best[:, 1] = np.inf
            for a, b, c1, c2 in listed:
                ends = optics.between(rays[:, a, :, 0], rays[:, a, :, 1], rays[:, b, :, 0], rays[:, b, :, 1])
                size = np.sqrt(((ends[:, 0] - ends[:, 1]) ** 2).sum(axis=1))
                score = np.abs(size - length) / length + (0.0 if walls[c1, c2] else same_wall_penalty)
                # among equals the first two cameras
                better = (size >= lo) & (size <= hi) & (score < best[:, 1])
                best[better] = np.concatenate([size[:, None], score[:, None], ends.reshape(n, 6)], axis=1)[better]
                pair[better] = c1, c2
            found = pair[:, 0] != pair[:, 1]
            kept = batch.filter(pa.array(found))
            out = [*[kept.column(c) for c in (*by, frame)], *[pa.array(c) for c in pair[found].T], *[pa.array(c) for c in best[found].T]]
            yield pa.record_batch(out, names=schema.names)

    return flat.mapInArrow(judged, schema)

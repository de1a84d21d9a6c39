import math

import numpy as np
import pandas as pd
import pytest

from wakegrid.functions import optics
from wakegrid.operators import cameras as C
from wakegrid.plans.vision import camera_list, camera_table

WATER = (1.333, 1.49, 1.0003)


def snell(d, n, n1, n2):
    """Scalar refraction through angles instead of the vector formula."""
    d, n = d / np.linalg.norm(d), n / np.linalg.norm(n)
    if np.dot(d, n) < 0:
        n = -n
    theta = math.acos(min(1.0, np.dot(d, n)))
    s = n1 / n2 * math.sin(theta)
    if s > 1:
        return None
    across = d - np.dot(d, n) * n
    if np.linalg.norm(across) < 1e-15:
        return n
    return math.cos(math.asin(s)) * n + s * across / np.linalg.norm(across)


def hit(o, d, p, n):
    return o + np.dot(p - o, n) / np.dot(d, n) * d


def refracted(cam, d):
    r, t = np.reshape(cam["r"], (3, 3)), np.array(cam["t"])
    n, p = np.array(cam["plate_normal"]), np.array(cam["plate_point"])
    obj, win, air = cam["idx3"]
    h1 = hit(-r.T @ t, d, p - cam["width"] * n, n)
    d2 = snell(d, n, air, win)
    h2 = hit(h1, d2, p, n)
    return h2, snell(d2, n, win, obj)


def pinhole(cam, p):
    q = np.reshape(cam["r"], (3, 3)) @ p + np.array(cam["t"])
    x, y = q[0] / q[2], q[1] / q[2]
    k1, k2, p1, p2, k3 = cam["dist"]
    r2 = x * x + y * y
    rad = 1 + k1 * r2 + k2 * r2**2 + k3 * r2**3
    fx, fy, cx, cy = cam["k"]
    return (
        fx * (x * rad + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)) + cx,
        fy * (y * rad + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y) + cy,
    )


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(1)
    return rng.uniform(-0.08, 0.08, (30, 3))


def test_projection_and_sight_with_refraction(spark, scene):
    cams = camera_list(index=WATER)
    rows = [(i, c["camera"], *map(float, p)) for i, p in enumerate(scene) for c in cams]
    points = spark.createDataFrame(rows, "id int, camera int, px double, py double, pz double")
    table = camera_table(spark, index=WATER)
    seen = C.project(points, table, (1280, 1024)).toPandas()
    for r in seen.itertuples():
        cam = cams[r.camera]
        rot, t = np.reshape(cam["r"], (3, 3)), np.array(cam["t"])
        p = np.array([r.px, r.py, r.pz])
        o, d = refracted(cam, p + rot.T @ t)
        oc, dc = rot @ o + t, rot @ d
        depth = (rot @ p + t)[2]
        at = rot.T @ (oc + (depth - oc[2]) / dc[2] * dc - t)
        assert (r.u, r.v) == pytest.approx(pinhole(cam, at), abs=1e-8)
        assert r.in_image == (0 <= r.u <= 1279 and 0 <= r.v <= 1023)
    obs = spark.createDataFrame(seen[["id", "camera", "u", "v"]].rename(columns={"u": "x", "v": "y"}))
    for r in C.lines_of_sight(obs, table).toPandas().itertuples():
        cam = cams[r.camera]
        x, y = optics.undistort(
            np.array([(r.x - cam["k"][2]) / cam["k"][0]]), np.array([(r.y - cam["k"][3]) / cam["k"][1]]), np.array([cam["dist"]])
        )
        d = np.reshape(cam["r"], (3, 3)).T @ np.array([x[0], y[0], 1.0])
        o, dd = refracted(cam, d / np.linalg.norm(d))
        np.testing.assert_allclose([r.ox, r.oy, r.oz, r.dx, r.dy, r.dz], [*o, *dd], atol=1e-10)


def test_total_reflection_is_null(spark):
    cams = [{**c, "idx3": [1.0, 1.0, 9.0]} for c in camera_list()]
    names = list(cams[0])
    table = spark.createDataFrame([tuple(c[n] for n in names) for c in cams], names)
    obs = spark.createDataFrame([(0, 0, 100.0, 512.0), (1, 0, 640.0, 512.0)], "id int, camera long, x double, y double")
    rays = C.lines_of_sight(obs, table).orderBy("id").collect()
    assert rays[0]["dx"] is None


def true_rays(scene, cams):
    """Rays that meet the points exactly: backwards from the point through the plate."""
    rng = np.random.default_rng(2)
    for i, p in enumerate(scene):
        for c in cams:
            d = rng.normal(size=3)
            d /= np.linalg.norm(d)
            yield (i // 2, i % 2, c["camera"], *map(float, p - 0.3 * d), *map(float, d))


@pytest.mark.parametrize("cameras", [None, [0, 1, 2, 3]])
def test_noise_free_triangulation_returns_the_points(spark, scene, cameras):
    rows = list(true_rays(scene, camera_list()))
    rays = spark.createDataFrame(rows, "frame int, idx int, camera int, ox double, oy double, oz double, dx double, dy double, dz double")
    got = C.triangulate(rays, ["frame", "idx"], cameras).toPandas().sort_values(["frame", "idx"])
    np.testing.assert_allclose(got[["px", "py", "pz"]], scene, atol=1e-9)
    assert got["residual"].max() < 1e-9
    single = C.triangulate(rays.filter("camera = 0"), ["frame", "idx"], cameras)
    assert single.count() == 0  # one ray does not fix a point


@pytest.mark.parametrize("shift, verdict", [(0.0, "PASS"), (0.004, "FAIL")])
def test_wand_verdict(spark, shift, verdict):
    rows = [(f, i, 0.1 * i + (shift if i else 0), 0.0, 0.5, 1e-5) for f in range(5) for i in range(2)]
    points = spark.createDataFrame(rows, "frame int, idx int, px double, py double, pz double, residual double")
    row = C.wand_qc(points, [], "frame", 0.1, 1e-3, 6e-4).first()
    assert row["verdict"] == verdict and row["error_pct"] == pytest.approx(1000 * shift)


def test_position_sigma_against_dense_jacobian(spark, scene):
    cams = camera_list(index=WATER)
    rows = [(i, c["camera"], *map(float, p), 0.05 + 0.2 * c["camera"]) for i, p in enumerate(scene[:5]) for c in cams]
    rows += [(99, 0, *map(float, scene[6]), 0.3)]
    df = spark.createDataFrame(rows, "id int, camera int, px double, py double, pz double, err double")
    got = C.position_sigma(df, camera_table(spark, index=WATER), ["id"]).toPandas().set_index("id")

    def pixel(cam, p):
        arr = [np.array([cam[f]], float) for f in C.CAMERA_FIELDS] + [np.array([cam["width"]])]
        u, v = optics.project(np.array([p]), *arr)
        return np.array([u[0], v[0]])

    for i, p in enumerate(scene[:5]):
        m = np.zeros((3, 3))
        for c in cams:
            j = np.stack([(pixel(c, p + e) - pixel(c, p - e)) / 2e-6 for e in 1e-6 * np.eye(3)], axis=1)
            m += j.T @ j / max(0.05 + 0.2 * c["camera"], 0.1) ** 2
        np.testing.assert_allclose(got.loc[i], np.sqrt(np.diag(np.linalg.inv(m))), rtol=1e-6)
    assert np.isinf(got.loc[99]).all()


def test_swap_is_found(spark, scene):
    cams = camera_list(dist=(0.0,) * 5)
    rows = []
    for f in range(15):
        for c in cams:
            ends = [pinhole(c, scene[2 * f + i]) for i in range(2)]
            if c["camera"] in (1, 2):
                ends = ends[::-1]
            rows += [(f, c["camera"], i, *map(float, e)) for i, e in enumerate(ends)]
    obs = spark.createDataFrame(rows, "frame int, camera int, idx int, x double, y double")
    table = camera_table(spark, dist=(0.0,) * 5)
    best = C.swap_search(obs, table, ["frame"], [0, 1, 2, 3]).collect()
    assert len(best) == 3 and best[0]["swaps"] == "0110" and best[0]["cross_inliers"] == 4 * 30
    fixed = C.observation_table(obs, [], "frame", swapped=[1, 2])
    straight = C.point_pairs(obs.filter("camera in (0, 3)"), ["frame", "camera"], ["x", "y"])
    assert fixed.count() == 60 and straight.count() == 30
    right = obs.filter("camera = 0 or camera = 3")
    resid = C.epipolar_residuals(right, table, ["frame", "idx"], [0, 1, 2, 3]).first()
    assert resid["mean"] < 1e-6 and resid["n"] == 30


def test_best_pair_prefers_the_right_length(spark, scene):
    cams = camera_list()
    rows = []
    for f in range(10):
        mid = scene[f] / 2
        for i, s in enumerate((-1, 1)):
            for c in cams:
                u, v = pinhole(c, mid + np.array([0.02, 0.055, 0.0]) * s)
                rows.append((f, c["camera"], i, float(u) + (40 if c["camera"] == 0 and i else 0), float(v)))
    obs = spark.createDataFrame(rows, "frame int, camera int, idx int, x double, y double")
    got = C.best_pair(obs, camera_table(spark), [], "frame", [0, 1, 2, 3], 2 * math.hypot(0.02, 0.055)).toPandas()
    assert len(got) == 10 and (got["c1"] == 1).all() and (got["score"] < 1e-9).all()


def test_duplicate_camera_raises(spark):
    from wakegrid.plans.vision import flat_cameras
    from wakegrid.sources import tables as ST

    class Suppliers:
        supplier = spark.createDataFrame([(1,), (2,)], "s_suppkey long")

    flat = flat_cameras(Suppliers)
    assert ST.camera_rows(flat).count() == 2
    with pytest.raises(Exception, match="camera listed twice"):
        ST.camera_rows(flat.unionByName(flat)).collect()


def test_seeding_checks(spark):
    counts = spark.createDataFrame([(n,) for n in (90, 100, 110)], "n int")
    row = C.seeding_report(
        counts, [], "n", box_mm=(10.0, 10.0, 10.0), voxel_mm=0.1, px_mm=0.05, fps=100.0, velocity=0.1, worst_rms_px=0.5
    ).first()
    spacing = (1000 / 100) ** (1 / 3) / 0.1
    assert row["spacing_vox"] == pytest.approx(spacing) and row["moved_vox"] == pytest.approx(10.0)
    assert row["track_check"] == ("OK" if 10 / spacing < 0.33 else "WARN")

"""The best pair of cameras: one shuffle, duplicates and ties beside a plain pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wakegrid.functions import optics
from wakegrid.operators import cameras as C
from wakegrid.plans.vision import camera_list, camera_table


def test_best_pair_shuffles_the_rays_once_and_finds_the_wand(spark):
    cams = camera_table(spark, dist=(0.0,) * 5)
    ends = [(f, i, 0.01 * f, 0.02, -0.05 + 0.1 * i) for f in range(6) for i in (0, 1)]
    rows = spark.createDataFrame(ends, "frame long, idx int, px double, py double, pz double")
    rows = rows.withColumn("camera", F.explode(F.array(*[F.lit(c) for c in range(4)]))).where("frame <> 5 or camera = 1")
    seen = C.project(rows, cams).select("frame", "idx", "camera", F.col("u").alias("x"), F.col("v").alias("y"))
    seen = seen.unionByName(seen.where("frame = 2"))  # rows that are there twice
    best = C.best_pair(seen, cams, [], "frame", [3, 1, 0, 2], 0.1)
    plan = best._jdf.queryExecution().sparkPlan().toString()
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1, plan
    got = best.toPandas().sort_values("frame")
    # a frame seen by one camera has no pair
    assert got["frame"].tolist() == [0, 1, 2, 3, 4]
    assert np.allclose(got["length"], 0.1, atol=1e-6) and np.allclose(got["pz1"], 0.05, atol=1e-6)
    walls = {c["camera"]: c["plate_normal"][0] for c in camera_list()}
    assert all(walls[a] != walls[b] for a, b in zip(got["c1"], got["c2"]))


def test_point_between_two_rays_solves_the_least_squares_equations():
    rng = np.random.default_rng(0)
    o1, o2, d1, d2 = rng.normal(size=(4, 50, 3))
    d1, d2 = (d / np.linalg.norm(d, axis=1)[:, None] for d in (d1, d2))
    m1, m2 = (np.eye(3) - d[:, :, None] * d[:, None, :] for d in (d1, d2))
    want = np.linalg.solve(m1 + m2, np.einsum("nij,nj->ni", m1, o1)[:, :, None] + np.einsum("nij,nj->ni", m2, o2)[:, :, None])[:, :, 0]
    assert np.allclose(optics.between(o1, d1, o2, d2), want)
    assert np.isnan(optics.between(o1, d1, o2, d1)).all()


BY = ["run", "frame"]


def odd_pixels(spark):
    """Noisy pixels of twelve points with repeats, gaps, an unknown camera, missing keys and values that aren't numbers."""
    cams = camera_table(spark)
    points = spark.createDataFrame([(f % 2, f, 0.005 * f, 0.02 - 0.003 * f, -0.05) for f in range(12)], "run long, frame long, px double, py double, pz double")
    rows = points.withColumn("camera", F.explode(F.array(*[F.lit(c) for c in range(4)]))).where("frame <> 5 or camera = 1")
    noise = F.expr("(frame * 7 + camera * 5) % 11 - 5") * 0.1
    seen = C.project(rows, cams).select(*BY, "camera", (F.col("u") + noise).alias("x"), (F.col("v") - noise).alias("y"))
    moved = seen.where("frame = 4").withColumn("y", F.col("y") + 40)
    odd = "1L, 7L, 9, 10D, 10D", "1L, 7L, int(null), 10D, 10D", "0L, 8L, 0, double(null), 10D", "1L, 9L, 2, double('NaN'), 10D", "1L, null, 1, 10D, 10D", "1L, null, 2, 10D, 10D", "0L, 50L, 9, 10D, 10D"
    more = spark.sql(f"select * from values {', '.join(f'({o})' for o in odd)} as t(run, frame, camera, x, y)")
    return seen.unionByName(seen.where("frame = 2")).unionByName(moved).unionByName(more), cams


def step_by_step(obs, cams, cameras):
    points = C.triangulate(C.lines_of_sight(obs, cams), BY, cameras)
    return points, C.reprojection_errors(obs, points, cams, BY)


def same_rows(got, want, keys):
    got, want = (d.toPandas().sort_values(keys, na_position="last").reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) and len(got)
    for c in want:
        if want[c].dtype == object:
            assert got[c].tolist() == want[c].tolist()
        else:
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=1e-9, equal_nan=True), c


def test_reconstruct_shuffles_the_pixels_once(spark):
    obs, cams = odd_pixels(spark)
    for cameras in ([0, 1, 2, 3], [0, 2, 3], None):
        got = C.reconstruct(obs, cams, BY, 2, 2.0, cameras)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, plan
        points, errors = step_by_step(obs, cams, cameras)
        worst = errors.groupBy(*BY).agg(F.max("err").alias("max_err"), F.avg("err").alias("mean_err"))
        want = obs.groupBy(*BY).agg(F.countDistinct("camera").alias("cameras")).join(points, BY, "left").join(worst, BY, "left")
        want = want.withColumn("status", F.expr(
            "case when cameras < 2 then 'FEW_CAMERAS' when px is null or max_err is null then 'NO_POINT' when max_err > 2 then 'HIGH_ERROR' else 'OK' end"
        ))
        assert got.columns == want.columns
        same_rows(got, want, BY)
        assert {r["status"] for r in got.collect()} == {"OK", "HIGH_ERROR", "FEW_CAMERAS", "NO_POINT"}


def test_located_errors_are_those_of_the_single_steps(spark):
    obs, cams = odd_pixels(spark)
    for cameras in ([0, 1, 2, 3], None):
        got = C.located_errors(obs, cams, BY, cameras)
        plan = C.position_sigma(got, cams, ["frame"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan, plan
        _, errors = step_by_step(obs, cams, cameras)
        names = [*BY, "camera", "x", "y", "px", "py", "pz", "u", "v", "err"]
        assert got.columns == names
        same_rows(got, errors.select(*names).where("err is not null"), [*BY, "camera", "x", "y"])
        same_rows(C.position_sigma(got, cams, ["frame"]), C.position_sigma(errors, cams, ["frame"]), ["frame"])

"""No row vanishes without a word: short groups, missing points, late frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakegrid.operators import joins as J
from wakegrid.operators import quality as Q
from wakegrid.operators import sequence as W


def test_rows_of_short_curves_stay(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5), ("a", None)], "g string, x double")
    curve = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0), ("b", 0.0, 1.0)], "g string, tx double, y double")
    want = {("a", 0.5): 2.0, ("b", 0.5): None, ("c", 0.5): None, ("a", None): None}
    for found in (J.interp_linear(rows, "x", curve, "tx", ["y"], ["g"]), J.interp_pchip(rows, "x", curve, "tx", ["y"], ["g"])):
        assert {(r["g"], r["x"]): r["y_at"] for r in found.collect()} == want
    long = J.interp_long(rows.dropna(), "x", curve, "tx", ["y"], ["g"])
    assert {r["g"]: r["y"] for r in long.collect()} == {"a": 2.0, "b": None, "c": None}


def test_short_runs_come_back_unfiltered(spark):
    rows = [("long", i, float(np.sin(i))) for i in range(60)] + [("short", i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i bigint, v double")
    got = W.zero_phase_lowpass(df, ["g"], "i", "v", "low", 5.0, 100.0).collect()
    assert len(got) == 65
    assert all(r["filtered"] == (r["g"] == "long") for r in got)
    assert all(r["low"] == r["v"] for r in got if r["g"] == "short")


def test_gate_keeps_missing_points_and_refuses_late_frames(spark):
    rows = [(0, 0, 0.0, 0.0, 1.0, 1.0), (0, 1, None, 0.0, 1.0, 1.0), (0, 2, 0.1, 0.0, 1.0, 1.0)]
    pairs = spark.createDataFrame(rows, "camera int, frame bigint, x0 double, y0 double, x1 double, y1 double")
    got = {r["frame"]: r["accepted"] for r in Q.jump_gate(pairs, ["camera"], 5.0).collect()}
    assert got == {0: True, 1: False, 2: True}
    with pytest.raises(ValueError):
        Q.fold_jumps(np.array([[3.0, 0, 0, 0, 0], [3.0, 0, 0, 0, 0]]), None, 5.0, 5)
    with pytest.raises(ValueError):
        Q.fold_jumps(np.array([[3.0, 0, 0, 0, 0]]), np.array([7.0, 0, 0, 0, 0]), 5.0, 5)


def test_repeat_average(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), ("a", 1, 5.0)], "g string, i bigint, u double")
    got = {r["i"]: (r["n"], r["mean"]) for r in J.repeat_average(df, ["g"], "u").select("i", "n", F.col("mean")).collect()}
    assert got == {0: (2, 2.0), 1: (1, 5.0)}

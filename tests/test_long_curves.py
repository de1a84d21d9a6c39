"""Long curves and aligned repeats: work that grows with the rows, and values beside numpy's."""

from __future__ import annotations

import numpy as np
import pandas as pd

from wakegrid.operators import joins as J


def curve(n: int) -> pd.DataFrame:
    x = np.arange(n) + 0.25 * np.sin(np.arange(n))
    return pd.DataFrame({"g": 1, "x": x, "y": np.cos(0.01 * x)})


def test_no_window_of_a_long_curve_looks_ahead_to_its_last_row(spark):
    """Spark goes over all rows ahead again for each row of such a window."""
    nodes = spark.createDataFrame(curve(3000))
    asked = spark.createDataFrame(pd.DataFrame({"g": 1, "i": range(2000), "at": np.linspace(-1.0, 3001.0, 2000)}))
    found = J.interp_long(asked, "at", nodes, "x", ["y"], ["g"], slots=1)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    got = found.toPandas().sort_values("i")
    inner = got[(got["at"] > 0) & (got["at"] < 2998)]
    table = curve(3000)
    assert np.allclose(inner["y"], np.interp(inner["at"], table["x"], table["y"]))


def test_repeat_average_of_a_long_record(spark):
    """Every grid point has all repeats, and the plan has no window that looks ahead to the last row."""
    k = np.arange(2000)
    rows = pd.concat([pd.DataFrame({"g": 1, "rep": r, "t": k + 0.1 * (r - 1), "v": k * 0.5 + r}) for r in (1, 2, 3)])
    aligned = J.align_repeats(spark.createDataFrame(rows), ["g"], "rep", "t", ["v"])
    mean = J.repeat_average(aligned, ["g"], "v")
    assert "unboundedfollowing" not in mean._jdf.queryExecution().toString().lower()
    got = mean.toPandas().sort_values("i")
    want = np.mean([k * 0.5 + r - 0.05 * (r - 1) for r in (1, 2, 3)], axis=0)
    assert (got["n"] == 3).all() and np.allclose(got["mean"], want)

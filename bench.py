"""Time the headline queries and print one JSON line.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``.
Every query is evaluated completely into a sink that discards its rows: once
cold, then ``$BENCH_WARM`` times (default 2); ``queries`` has the median of the
warm runs, ``cold`` the first.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wakegrid.plans.catalog import QUERIES  # noqa: E402
from wakegrid.session import local_session  # noqa: E402

HEADLINE = (
    "a7_plane_average", "a4_bin_means", "a5_reynolds_stress", "a8_dispersive_flux", "a11_resolution_sweep",
    "w2_central_gradient", "w6_moving_mean", "j3_interp_pchip", "l1_velocity_fluctuation", "l2_lagrangian_autocorr",
    "l2b_autocorr_long_lags", "l5_eddy_diffusivity", "j10_knn", "e2_ftle", "e4_scatter_to_grid",
    "c2_triangulate", "c3_wand_qc", "c5_reprojection_rms", "f4_length_gate", "g3_pressure_poisson", "g8_welch_psd",
    "b1_xcorr", "m2_turbulence_by_height", "m9_power_by_direction", "m11_wake_row", "x1_temporal_background",
    "x4_local_maxima", "f7_mad_outliers",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    QUERIES["a1_uniform_bins"](spark, folder).write.format("noop").mode("overwrite").save()  # start the workers
    seconds, cold = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 + int(os.environ.get("BENCH_WARM", "2"))):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        cold[name], seconds[name] = round(runs[0], 3), round(median(runs[1:] or runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cold": cold,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

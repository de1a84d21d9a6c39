import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wakegrid.operators import binning as A
from wakegrid.operators import quality as Q
from wakegrid.operators.binning import Axis
from wakegrid.plans.catalog import ORACLES, QUERIES
from wakegrid.plans.streams import drain
from wakegrid.sources import tables as ST
from wakegrid.sources import tracks as S
from wakegrid.streaming import incremental as I

from test_sequence import sequential, walk


def test_read_tracks_converts_units_and_nan(spark, tmp_path):
    row = {f.name: 1000.0 for f in S.TRACK_SCHEMA.fields}
    rows = [{**row, "track_id": 7, "frame": f, "x": x} for f, x in ((10, 5.0), (13, float("nan")))]
    spark.createDataFrame(rows, S.TRACK_SCHEMA).write.parquet(str(tmp_path / "t"))
    got = S.read_tracks(spark, str(tmp_path / "t"), 600).orderBy("frame").collect()
    assert [r["t"] for r in got] == [0.0, pytest.approx(3 / 600)]
    assert got[0]["x"] == pytest.approx(0.005) and got[1]["x"] is None and got[1]["y"] == 1.0


def test_wide_tracks_and_index(spark):
    nan = float("nan")
    wide = spark.createDataFrame([(50, [1.0, nan, 3.0], [1.0, nan, 3.0], [0.0, nan, 0.0]), (9, [nan, 2.0], [nan, 2.0], [nan, 0.0])], "track_id long, x array<double>, y array<double>, z array<double>")
    long = S.melt_wide_tracks(wide, ["track_id"])
    assert sorted((r["track_id"], r["frame"], r["x"]) for r in long.collect()) == [(9, 1, 2.0), (50, 0, 1.0), (50, 2, 3.0)]
    idx = {(r["track_id"], r["frame"]): (r["column_index"], r["row_index"]) for r in S.index_tracks(long).collect()}
    assert idx == {(9, 1): (0, 1), (50, 0): (1, 0), (50, 2): (1, 2)}


def test_query_grid_order(spark):
    got = S.query_grid(spark, {"x": (0.0, 1.0, 2), "z": (5.0, 7.0, 3)}).orderBy("node").collect()
    assert [(r["x"], r["z"]) for r in got] == [(a, b) for a in (0.0, 1.0) for b in (5.0, 6.0, 7.0)]
    box = S.random_box(spark, 100, {"x": (2.0, 3.0)}).agg(F.min("x"), F.max("x")).first()
    assert 2.0 <= box[0] <= box[1] <= 3.0


def test_components(spark):
    df = spark.createDataFrame([(0, [float(v) for v in range(6)])], "t int, flat array<double>")
    got = S.label_components(df, ["t"], "flat", "field").collect()
    assert [(r["point"], r["component"], r["name"]) for r in got] == [(p, c, n) for p in (0, 1) for c, n in enumerate(("ux", "uy", "uz"))]
    with pytest.raises(ValueError):
        S.label_components(df, ["t"], "flat", "laplacian", "scalar")


def test_names_and_channels(spark):
    paths = spark.createDataFrame([("/a/run_1_b_c_delay=-2.5_p7_img0042.tif",), ("x.png",)], "p string")
    rows = paths.select(*[c.alias(n) for n, c in ST.filename_fields("p").items()]).collect()
    assert tuple(rows[0]) == (-2.5, "p7", 42) and tuple(rows[1]) == (None, None, None)
    wide = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "ts int, Cup_30m double, Cup_130m double, note double")
    got = {(r["signal"], r["height_m"]): r["value"] for r in ST.melt_channels(wide, "ts").collect()}
    assert got == {("Cup", 30): 1.0, ("Cup", 130): 2.0}


def test_scada_melt(spark):
    wide = spark.createDataFrame([(0, 1.0, 2.0, 3.0, float("nan"))], "ts int, a double, b double, c double, d double")
    got = {r["turbine"]: (r["dir"], r["power"]) for r in ST.melt_scada(wide, "ts", ["T1", "T2"], ["dir", "power"]).collect()}
    assert got == {"T1": (1.0, 2.0), "T2": (3.0, None)}
    with pytest.raises(ValueError):
        ST.melt_scada(wide, "ts", ["T1"], ["dir", "power"])


def test_reconcile(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 5.0, 1.0), (3, 0.0, 0.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.00001, None), (2, 5.1, 1.0)], "k int, x double, y double")
    got = {(r["k"], r["field"]) for r in ST.reconcile(a, b, ["k"], ["x", "y"]).collect()}
    assert got == {(2, "x"), (3, "x"), (3, "y")}


def test_streamed_moments_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.uniform(0, 1, (500, 2)), columns=["x", "u"])
    df = spark.createDataFrame(pdf).repartition(5)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    axes = [Axis("x", 0, 1, 4)]
    got = I.bin_moments_to_stats(drain(I.stream_bin_moments(stream, axes, ["u"]), "m", "complete", False), ["u"]).orderBy("ix").toPandas()
    want = A.with_bins(df, axes).groupBy("ix").agg(F.avg("u").alias("u"), F.var_pop("u").alias("uu")).orderBy("ix").toPandas()
    np.testing.assert_allclose(got[["u", "uu"]], want[["u", "uu"]])


def test_streamed_gate_equals_sequential(spark, tmp_path):
    pdf = walk(0, 200)
    ordered = pdf.sort_values("frame")
    parts = [ordered.iloc[k : k + 50] for k in range(0, len(ordered), 50)]
    for part in parts:  # one file per micro-batch, in order
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame(pdf).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(I.stream_jump_gate(stream, ["camera"], 20.0), "g", "append", True).toPandas()
    assert got.set_index("frame")["accepted"].to_dict() == sequential(pdf, 20.0)
    batch = Q.jump_gate(spark.createDataFrame(pdf), ["camera"], 20.0, size=16).toPandas()
    assert batch.set_index("frame")["accepted"].to_dict() == sequential(pdf, 20.0)


def loads(spark, pdf, path, size=60, blur=30, seed=1):
    """One file per micro-batch; rows are out of order by up to ``blur`` frames, also from file to file."""
    rng = np.random.default_rng(seed)
    mixed = pdf.iloc[np.argsort(pdf["frame"] + rng.uniform(0, blur, len(pdf)), kind="stable")]
    parts = [mixed.iloc[k : k + size] for k in range(0, len(mixed), size)]
    return [spark.createDataFrame(part).coalesce(1) for part in parts]


def gated(spark, schema, path, out, **options):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    rated = I.stream_jump_gate(stream, ["camera"], 20.0, **options)
    run = rated.writeStream.format("parquet").option("checkpointLocation", f"{path}/progress").option("path", f"{path}/{out}")
    query = run.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_streamed_gate_orders_late_frames_and_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "WAIT_BLOCK", 16)
    pdf = walk(0, 300)
    schema = spark.createDataFrame(pdf).schema
    files = loads(spark, pdf, tmp_path)
    for part in files[:2]:
        part.write.mode("append").parquet(str(tmp_path / "in"))
    first = gated(spark, schema, tmp_path, "out", slack=40)
    assert len([p for p in first.recentProgress if p["numInputRows"]]) == 2  # several micro-batches
    before = spark.read.parquet(str(tmp_path / "out")).count()
    assert 0 < before < 120  # the last frames wait
    for part in files[2:]:
        part.write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(int(pdf["camera"].iloc[0]), int(pdf["frame"].max()) + 40)], "camera long, frame long")
    missing = [c for c in schema.names if c not in ("camera", "frame")]
    end = end.select(*[F.col(f.name).cast(f.dataType) if f.name not in missing else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    gated(spark, schema, tmp_path, "out", slack=40)  # goes on from the progress folder
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(got) == len(pdf) and got.set_index("frame")["accepted"].to_dict() == sequential(pdf, 20.0)


def test_streamed_gate_raises_for_frames_beyond_the_slack(spark, tmp_path):
    pdf = walk(0, 300)
    for part in loads(spark, pdf, tmp_path, size=30, blur=100):
        part.write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="come late"):
        gated(spark, spark.createDataFrame(pdf).schema, tmp_path, "out", slack=2)


def test_silent_camera_is_released_by_its_timer(spark, tmp_path):
    import time

    pdf = walk(0, 50)
    spark.createDataFrame(pdf).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame(pdf).schema).parquet(str(tmp_path / "in"))
    rated = I.stream_jump_gate(stream, ["camera"], 20.0, slack=1000, patience_ms=1)
    run = rated.writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "progress")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table("silent").count() == len(pdf):
                break
            time.sleep(0.5)
    finally:
        run.stop()
    got = spark.table("silent").toPandas()
    assert got.set_index("frame")["accepted"].to_dict() == sequential(pdf, 20.0)


def test_streamed_moments_of_a_folder_of_part_files(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    table.repartition(70).write.parquet(str(tmp_path / "lineitem.parquet"))
    run = QUERIES["st1_stream_bin_moments"]
    key = ["ix", "iy", "iz"]
    parts = run(spark, str(tmp_path)).orderBy(*key).toPandas()
    whole = run(spark, "/root/testdata/sf0.001").orderBy(*key).toPandas()
    pd.testing.assert_frame_equal(parts, whole)


def test_jump_fold_equals_row_by_row():
    rng = np.random.default_rng(4)
    for trial in range(60):
        n = int(rng.integers(1, 200))
        rows = np.column_stack([np.cumsum(rng.integers(1, 4, n)), np.cumsum(rng.normal(scale=rng.choice([0.1, 2]), size=(n, 4)), axis=0)])
        rows[rng.random(n) < 0.2, 1:] += 40 * rng.normal(size=4)
        start = None if trial % 2 else np.array([0.0, *rng.normal(size=4)])
        state, want = start, []
        for row in rows:
            if state is not None:
                reach = 3.0 * min(row[0] - state[0], 5)
                d = row[1:] - state[1:]
                if d[0] ** 2 + d[1] ** 2 > reach**2 or d[2] ** 2 + d[3] ** 2 > reach**2:
                    want.append(False)
                    continue
            want.append(True)
            state = row
        got, end = Q.fold_jumps(rows, start, 3.0, 5)
        assert got.tolist() == want and (end is None) == (state is None) and (end is None or (end == state).all())


def test_registry_names_and_entry(spark):
    import __spark_entry__ as entry

    assert all(re.fullmatch(r"(st|[a-z])\d+[a-z]?_[a-z0-9_]+", n) for n in QUERIES)
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    # beside them only the text operators, which may be left out
    assert all(re.match(r"op\d+_|pipeline$", n) for n in set(entry.queries()) - set(QUERIES))
    df = entry.entry(spark)
    assert df.columns == ["iy", "bins", "u", "v", "w"] and df.count() > 0


INVENTORY = {"s": 17, "p": 18, "f": 12, "w": 16, "a": 21, "j": 15, "l": 9, "e": 11, "g": 12, "b": 7, "c": 13, "x": 11, "m": 14, "o": 8, "st": 2}


def test_every_operator_has_a_query():
    ids = {re.match(r"(st|[a-z])\d+", n).group(0) for n in QUERIES}
    missing = [f"{k}{i}" for k, n in INVENTORY.items() for i in range(1, n + 1) if f"{k}{i}" not in ids]
    assert missing == []

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wakegrid import core


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {
            "g": np.where(rng.random(900) < 0.5, "hot", rng.choice(list("abc"), 900)),
            "t": rng.integers(0, 400, 900),
            "id": np.arange(900),
            "v": rng.normal(size=900).round(2),
        }
    )
    return pdf, spark.createDataFrame(pdf).cache()


def numbered(pdf):
    out = pdf.sort_values(["g", "t", "id"])
    return out.assign(n=out.groupby("g").cumcount())


def test_ordinal_equals_rank_over_the_whole_group(events):
    pdf, df = events
    got = core.ordinal(df, ["g"], ["t", "id"], F.floor(F.col("t") / 7)).toPandas()
    want = numbered(pdf).set_index("id")["n"]
    assert (got.set_index("id")["n"].sort_index() == want.sort_index()).all()


def test_ordinal_without_group(events):
    pdf, df = events
    got = core.ordinal(df, [], ["t", "id"], F.floor(F.col("t") / 50)).toPandas().set_index("id")["n"]
    want = pdf.sort_values(["t", "id"]).reset_index(drop=True).reset_index().set_index("id")["index"]
    assert (got.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("size", [1, 3, 16, 4096])
def test_windowed_blocks_see_the_same_neighbours(events, spark, size):
    pdf, _ = events
    rows = numbered(pdf)
    df = spark.createDataFrame(rows)
    got = core.windowed(
        df, ["g"], "n", 2, 3,
        lambda r, w: r.withColumn("s", F.sum("v").over(w.rowsBetween(-2, 3))).withColumn("p", F.lag("v").over(w)),
        size,
    ).toPandas().sort_values(["g", "n"])
    want = df.withColumn("s", F.sum("v").over(Window.partitionBy("g").orderBy("n").rowsBetween(-2, 3))).withColumn(
        "p", F.lag("v").over(Window.partitionBy("g").orderBy("n"))
    ).toPandas().sort_values(["g", "n"])
    assert len(got) == len(want)
    np.testing.assert_allclose(got["s"], want["s"])
    np.testing.assert_allclose(got["p"].astype(float), want["p"].astype(float))


def test_running_totals_over_blocks(events, spark):
    rows = numbered(events[0])
    got = core.running(spark.createDataFrame(rows), ["g"], "n", {"c": F.col("v")}, 7).toPandas().sort_values(["g", "n"])
    np.testing.assert_allclose(got["c"], rows.sort_values(["g", "n"]).groupby("g")["v"].cumsum(), atol=1e-9)


def midpoint(values, p):
    v = np.sort(values)
    h = min(max(p * len(v) + 0.5, 1), len(v))
    k = int(np.floor(h))
    return v[k - 1] + (h - k) * (v[min(k, len(v) - 1)] - v[k - 1])


@pytest.mark.parametrize("slot", [4, 100_000])
@pytest.mark.parametrize("kind", ["smooth", "ties", "far"])
def test_exact_quantiles(spark, slot, kind):
    """Slot 4 forces several rounds of shrinking ranges; 100,000 closes all at once."""
    rng = np.random.default_rng(5)
    v = rng.lognormal(size=3000)
    if kind == "ties":
        v = np.floor(v * 3)
    if kind == "far":
        v[:5] = [1e300, -1e300, 1e-300, 0.0, 1e18]
    pdf = pd.DataFrame({"g": np.where(np.arange(3000) % 10 < 9, 0, 1), "v": v})
    probs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.9, "e": 1.0}
    got = core.exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs, slot=slot).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert got.loc[g, name] == pytest.approx(midpoint(part["v"].to_numpy(), p))


def test_quantiles_of_several_columns_without_groups(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"v": rng.normal(size=20_000), "w": rng.integers(0, 3, 20_000).astype(float), "empty": np.nan})
    df = spark.createDataFrame(pdf).withColumn("empty", F.lit(None).cast("double")).repartition(8)
    out = core.quantiles_of(df, [], {"v": {"v1": 0.1, "v2": 0.99}, "w": {"w1": 0.5}, "empty": {"none": 0.5}}, slot=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    got = out.first()
    assert got["v1"] == pytest.approx(midpoint(pdf["v"], 0.1)) and got["v2"] == pytest.approx(midpoint(pdf["v"], 0.99))
    assert got["w1"] == midpoint(pdf["w"], 0.5) and got["none"] is None
    assert core.quantiles_of(df.limit(0), ["w"], {"v": {"v1": 0.1}}).count() == 0


def test_numbered_without_a_one_task_window(spark):
    rng = np.random.default_rng(7)
    ids = np.unique(rng.integers(-(2**63), 2**63 - 1, 5000))
    df = spark.createDataFrame(pd.DataFrame({"id": ids})).repartition(7)
    out = core.numbered(df, ["id"], "n")
    got = out.toPandas().sort_values("id")
    assert (got["n"].to_numpy() == np.arange(len(ids))).all()
    assert core.numbered(df.limit(0), ["id"], "n").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = core.numbered(df, ["id"], "n").groupBy(F.spark_partition_id().alias("task")).count().toPandas()["count"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(held) > 1 and held.max() < 2 * len(ids) / len(held)  # ranges of like size, not one task


def test_quantile_rules(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 10]], "v double")
    one = lambda rule, p: core.exact_quantiles(df, [], "v", {"q": p}, rule).first()["q"]
    assert one("midpoint", 0.9) == pytest.approx(midpoint(np.array([1, 2, 3, 4, 10.0]), 0.9))
    assert one("linear", 0.9) == pytest.approx(np.percentile([1, 2, 3, 4, 10], 90))
    assert one("nearest", 0.9) == 10.0  # round(4.5) is 5
    with pytest.raises(ValueError):
        one("other", 0.5)


def test_attach_scalar_and_keyed(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    assert [r["m"] for r in core.attach(df, df.agg(F.avg("v").alias("m")), []).collect()] == [3.0] * 3
    keyed = core.attach(df, df.groupBy("g").agg(F.avg("v").alias("m")), ["g"])
    assert {(r["v"], r["m"]) for r in keyed.collect()} == {(1.0, 2.0), (3.0, 2.0), (5.0, 5.0)}

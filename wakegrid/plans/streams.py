"""Streaming twins run over the driver's tables until the input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, scratch_path
from ..streaming import incremental as ST
from .registry import query
from .views import GRID, grid_sql, spark_samples
from .vision import JUMP_REPORT, pairs


def drain(stream: DataFrame, name: str, mode: str, every: bool, path: str | None = None) -> DataFrame:
    """Run a stream over all available input and read what it wrote; with the same ``path`` it goes on from there.

    In complete mode each micro-batch replaces the table; in append mode the
    micro-batches are kept side by side.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)

    def save(batch: DataFrame, number: int) -> None:
        target = f"{path}/part={number}" if every else path
        batch.write.mode("overwrite").parquet(target)

    run = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}-progress")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(path)


class _Arriving:
    """Stands in for the tables: ``lineitem`` arrives as a stream of its part files.

    The table is a file or a folder of part files; the pattern fits both.
    """

    def __init__(self, t, table: str, files: int):
        self.spark = t.spark
        schema = getattr(t, table).schema
        reader = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True)
        setattr(self, table, reader.parquet(f"{t.folder}/{table}.parquet*"))


@query(
    "st1_stream_bin_moments", ints="ix iy iz n", reals="u uu",
    sql=f"select ix, iy, iz, count(*) as n, avg(u) as u, var_pop(u) as uu from {grid_sql()} g group by ix, iy, iz",
)
def _(t):
    moments = ST.stream_bin_moments(spark_samples(_Arriving(t, "lineitem", 64)), GRID, ["u"])
    return ST.bin_moments_to_stats(drain(moments, "moments", "complete", False), ["u"])


#: Frames by which rows may come out of order in the query's stream.
SLACK = 1000
#: More files than a load has, so that a load arrives as a whole.
LOAD_FILES = 1 << 30


@query("st2_stream_jump_gate", ints="camera total rejected", reals="pct", sql=JUMP_REPORT)
def _(t):
    """The pairs arrive in four loads by frame, each load in no order and reaching into the one before."""
    path = scratch_path(t.spark, "pairs")
    # read for the span, the cameras, each load and the totals
    table = cut(pairs(t).select("camera", *ST.JUMP_STATE))
    span = table.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    ends = table.select("camera").distinct().select("camera", F.lit(hi + SLACK).cast(table.schema["frame"].dataType).alias("frame"), *[F.lit(None).cast("double").alias(c) for c in ST.POSITIONS])
    blurred = F.col("frame") + F.pmod(F.xxhash64("frame"), F.lit(SLACK // 2))
    out = scratch_path(t.spark, "rated")
    for k in range(4):
        a, b = lo + (hi - lo) * k / 4, lo + (hi - lo) * (k + 1) / 4
        load = table.where(((blurred >= a) if k else F.lit(True)) & ((blurred < b) if k < 3 else F.lit(True)))
        (load.unionByName(ends) if k == 3 else load).write.mode("append").parquet(path)
        arriving = t.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", LOAD_FILES).parquet(path)
        rated = ST.stream_jump_gate(arriving, ["camera"], 60.0, slack=SLACK)
        # the part files of a load are one micro-batch; the next load goes on from the progress folder
        found = drain(rated, "rated", "append", True, out)
    kept = F.count(F.when(F.col("accepted"), 1))
    found = found.groupBy("camera").agg(kept.alias("kept"))
    totals = table.groupBy("camera").agg(F.count(F.lit(1)).alias("total"))
    return totals.join(found, "camera", "left").select(
        "camera", "total", (F.col("total") - F.coalesce("kept", F.lit(0))).alias("rejected"), (100.0 * F.coalesce("kept", F.lit(0)) / F.col("total")).alias("pct")
    )

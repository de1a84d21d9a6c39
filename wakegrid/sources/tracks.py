"""Track tables: reading, reshaping, indexing, query grids (S1-S3, S14, S15)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import attach, nan_to_null, numbered

_IMAGE = [f"img{c}_{a}" for c in range(1, 5) for a in "uv"]
_MOTION = ["x", "y", "z", "u", "v", "w", "ax", "ay", "az"]

#: 19 columns: ids, position, velocity, acceleration, four image positions.
TRACK_SCHEMA = T.StructType(
    [T.StructField("track_id", T.LongType()), T.StructField("frame", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in _MOTION + _IMAGE]
)


def read_tracks(
    spark: SparkSession, path: str, fps: float, scale: float = 1e-3, fmt: str = "parquet"
) -> DataFrame:
    """Typed long tracks in metres and seconds."""
    reader = spark.read.schema(TRACK_SCHEMA)
    raw = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return scale_tracks(nan_to_null(raw, _MOTION + _IMAGE), fps, scale, _MOTION)


def scale_tracks(
    df: DataFrame, fps: float, scale: float, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Unit change of the given columns and t = (frame - first frame) / fps."""
    first = df.groupBy(*by).agg(F.min("frame").alias("_first"))
    out = attach(df, first, by).withColumn("t", (F.col("frame") - F.col("_first")) / float(fps))
    return out.withColumns({c: F.col(c) * scale for c in columns}).drop("_first")


def melt_wide_tracks(df: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """One row per track with NaN-padded arrays to one row per sample; NaN rows are dropped."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("frame", "_s"))
    long = rows.select(
        *keys, F.col("frame").cast("bigint").alias("frame"), *[F.col("_s")[c].alias(c) for c in columns]
    )
    return nan_to_null(long, columns).dropna(subset=list(columns))


def index_tracks(df: DataFrame, track: str = "track_id", frame: str = "frame") -> DataFrame:
    """Arbitrary ids to 0..N-1 (column_index) and frames to offsets (row_index).

    Only the distinct ids are numbered, by ranges of ids.
    """
    ids = numbered(df.select(track).distinct(), [track], "column_index")
    first = df.agg(F.min(frame).alias("_first"))
    out = attach(df.join(ids, track), first, [])
    return out.withColumn("row_index", F.col(frame) - F.col("_first")).drop("_first")


def query_grid(spark: SparkSession, axes: Mapping[str, tuple[float, float, int]]) -> DataFrame:
    """Every node of evenly spaced axes, the last axis fastest, with its 0-based number.

    The node number is generated and split into axis positions, so the grid is
    partitioned from the start and needs no join.
    """
    total = 1
    for _, _, n in axes.values():
        total *= n
    out = spark.range(total).withColumnRenamed("id", "node")
    stride = total
    for name, (lo, hi, n) in axes.items():
        stride //= n
        i = F.floor(F.col("node") / stride) % n
        step = (hi - lo) / (n - 1) if n > 1 else 0.0
        out = out.withColumn(f"i{name}", i).withColumn(name, lo + F.col(f"i{name}") * step)
    return out


def random_box(spark: SparkSession, n: int, box: Mapping[str, tuple[float, float]], seed: int = 42) -> DataFrame:
    """n uniformly random points of a box."""
    out = spark.range(n).withColumnRenamed("id", "node")
    for k, (name, (lo, hi)) in enumerate(box.items()):
        out = out.withColumn(name, lo + F.rand(seed + k) * (hi - lo))
    return out


# Fixed component names of a vector or scalar query result.
COMPONENTS = {
    ("field", "vector"): ["ux", "uy", "uz"],
    ("gradient", "vector"): [f"du{i}d{j}" for i in "xyz" for j in "xyz"],
    ("hessian", "vector"): [f"d2u{i}d{j}d{k}" for i in "xyz" for j, k in ("xx", "xy", "xz", "yy", "yz", "zz")],
    ("laplacian", "vector"): ["grad2ux", "grad2uy", "grad2uz"],
    ("field", "scalar"): ["p"],
    ("gradient", "scalar"): ["dpdx", "dpdy", "dpdz"],
    ("hessian", "scalar"): [f"d2pd{j}d{k}" for j, k in ("xx", "xy", "xz", "yy", "yz", "zz")],
}


def label_components(
    df: DataFrame, keys: Sequence[str], values: str, operator: str, kind: str = "vector"
) -> DataFrame:
    """Flat result arrays to rows (keys, point, component, name, value)."""
    if (operator, kind) not in COMPONENTS:
        raise ValueError(f"no {operator} of a {kind}")
    names = COMPONENTS[operator, kind]
    n = len(names)
    flat = df.select(*keys, F.posexplode(values).alias("_p", "value"))
    component = F.col("_p") % n
    return flat.select(
        *keys,
        F.floor(F.col("_p") / n).alias("point"),
        component.cast("bigint").alias("component"),
        F.element_at(F.array(*[F.lit(c) for c in names]), (component + 1).cast("int")).alias("name"),
        F.col("value").cast("double").alias("value"),
    )

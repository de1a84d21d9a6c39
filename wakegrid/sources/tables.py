"""Observation, camera, wind and force tables: readers, writers, reshaping (S4-S13, S16, S17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import attach, col, nan_to_null
from ..functions.scalars import KM_PER_DEGREE
from ..operators.joins import frames_seen_by_all

OBSERVATION_SCHEMA = (
    "Frame INT, Camera INT, Status STRING, PointIdx INT, X DOUBLE, Y DOUBLE, Radius DOUBLE, Metric DOUBLE"
)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(OBSERVATION_SCHEMA).option("header", True).csv(path)
    named = raw.select(
        F.col("Frame").cast("bigint").alias("frame"),
        F.col("Camera").alias("camera"),
        F.col("Status").alias("status"),
        F.col("PointIdx").alias("idx"),
        F.col("X").alias("x"),
        F.col("Y").alias("y"),
        F.col("Radius").alias("radius"),
        F.col("Metric").alias("metric"),
    )
    return nan_to_null(named, ["x", "y", "radius", "metric"])


def observation_rows(obs: DataFrame, cameras: int, points: int = 2) -> DataFrame:
    """Complete frames in file layout; point 0 is the small ball."""
    kept = frames_seen_by_all(obs, cameras, points)
    status = F.when(F.col("idx") == 0, "Filtered_Small").otherwise("Filtered_Large")
    return kept.select(
        F.col("frame").alias("Frame"),
        F.col("camera").alias("Camera"),
        status.alias("Status"),
        F.col("idx").alias("PointIdx"),
        F.col("x").alias("X"),
        F.col("y").alias("Y"),
        F.col("radius").alias("Radius"),
        F.col("metric").alias("Metric"),
    )


def write_observations(obs: DataFrame, path: str, cameras: int, points: int = 2) -> None:
    """Write complete frames as CSV, ordered by frame, camera and point over the part files."""
    rows = observation_rows(obs, cameras, points)
    rows.orderBy("Frame", "Camera", "PointIdx").write.mode("error").option("header", True).csv(path)


# The file's last columns are the centre; its header differs from cx, cy only in
# case, so they get names of their own (columns are read by position).
_CAMERA_COLUMNS = (
    ["fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3"]
    + [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    + ["tx", "ty", "tz", "centre_x", "centre_y", "centre_z", "reproj_rms_px"]
)
CAMERA_SCHEMA = T.StructType(
    [T.StructField("cam_id", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in _CAMERA_COLUMNS]
)


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Flat camera table with arrays k (fx fy cx cy), dist, r, t and the centre -Rᵀt."""
    return camera_rows(spark.read.schema(CAMERA_SCHEMA).option("header", True).csv(path))


def camera_rows(raw: DataFrame) -> DataFrame:
    """Typed camera rows; a camera that occurs twice raises when the rows are read."""
    t = [F.col(f"t{a}") for a in "xyz"]
    centre = [
        -(F.col(f"r1{j}") * t[0] + F.col(f"r2{j}") * t[1] + F.col(f"r3{j}") * t[2]) for j in (1, 2, 3)
    ]
    rows = raw.select(
        F.col("cam_id").alias("camera"),
        F.array("fx", "fy", "cx", "cy").alias("k"),
        F.array("k1", "k2", "p1", "p2", "k3").alias("dist"),
        F.array(*[f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]).alias("r"),
        F.array(*t).alias("t"),
        F.array(*centre).alias("centre"),
        F.col("reproj_rms_px").alias("rms"),
    )
    names = [c for c in rows.columns if c != "camera"]
    one = rows.groupBy("camera").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*names)).alias("_s")
    )
    checked = F.when(F.col("_n") == 1, F.col("_s")).otherwise(
        F.raise_error(F.concat(F.lit("camera listed twice: "), F.col("camera").cast("string")))
    )
    return one.withColumn("_s", checked).select("camera", *[F.col("_s")[c].alias(c) for c in names])


def nested_documents(cameras: DataFrame, translation_scale: float = 1000.0) -> DataFrame:
    """One JSON document per camera with a nested rotation matrix; translation in millimetres."""
    rows = F.array(*[F.slice("r", 3 * i + 1, 3) for i in range(3)])
    doc = F.struct(
        F.col("camera").alias("id"),
        F.col("k").alias("K"),
        rows.alias("R"),
        F.transform("t", lambda v: v * translation_scale).alias("t"),
        F.col("dist").alias("distCoeffs"),
        F.col("rms").alias("reproj_rms_px"),
        F.col("centre").alias("C_world"),
    )
    return cameras.select("camera", F.to_json(doc).alias("doc"))


def write_nested(cameras: DataFrame, path: str) -> None:
    nested_documents(cameras).select("doc").write.mode("error").text(path)


_NESTED_SCHEMA = (
    "id INT, K ARRAY<DOUBLE>, R ARRAY<ARRAY<DOUBLE>>, t ARRAY<DOUBLE>, distCoeffs ARRAY<DOUBLE>,"
    " reproj_rms_px DOUBLE, C_world ARRAY<DOUBLE>"
)


def read_nested(spark: SparkSession, path: str, translation_scale: float = 1000.0) -> DataFrame:
    raw = spark.read.schema(_NESTED_SCHEMA).json(path)
    return raw.select(
        F.col("id").alias("camera"),
        F.col("K").alias("k"),
        F.col("distCoeffs").alias("dist"),
        F.flatten("R").alias("r"),
        F.transform("t", lambda v: v / translation_scale).alias("t"),
        F.col("C_world").alias("centre"),
        F.col("reproj_rms_px").alias("rms"),
    )


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tol: float = 1e-4) -> DataFrame:
    """Fields that differ by more than ``tol``, or are on one side only: (keys, field, a, b)."""
    left = a.select(*keys, F.struct(*[F.col(c).cast("double").alias(c) for c in columns]).alias("_a"))
    right = b.select(*keys, F.struct(*[F.col(c).cast("double").alias(c) for c in columns]).alias("_b"))
    both = left.join(right, list(keys), "full")
    pairs = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col("_a")[c].alias("a"), F.col("_b")[c].alias("b")) for c in columns]
    )
    rows = both.select(*keys, F.explode(pairs).alias("_f")).select(*keys, "_f.*")
    same = (F.abs(F.col("a") - F.col("b")) <= tol) | (F.col("a").isNull() & F.col("b").isNull())
    return rows.filter(~F.coalesce(same, F.lit(False)))


# ------------------------------------------------------------------ wind data


def melt_scada(df: DataFrame, ts: str, turbines: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Wide rows (ts, then the channels of each turbine in turn) to (ts, turbine, channels)."""
    data = [c for c in df.columns if c != ts]
    n = len(channels)
    if len(data) != n * len(turbines):
        raise ValueError("the table does not hold every channel of every turbine")
    items = [
        F.struct(
            F.lit(name).alias("turbine"),
            *[F.col(f"`{data[i * n + k]}`").cast("double").alias(c) for k, c in enumerate(channels)],
        )
        for i, name in enumerate(turbines)
    ]
    long = df.select(F.col(ts).alias("ts"), F.explode(F.array(*items)).alias("_r")).select("ts", "_r.*")
    return nan_to_null(long, channels)


def read_sites(spark: SparkSession, path: str, prefix: int = 3) -> DataFrame:
    raw = spark.read.schema("Name STRING, Latitude DOUBLE, Longitude DOUBLE").option("header", True).csv(path)
    return raw.select(
        short_name("Name", prefix).alias("name"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon")
    )


def short_name(name: str | Column, prefix: int) -> Column:
    """Name without its first ``prefix`` characters."""
    c = col(name)
    return F.substring(c, F.lit(prefix + 1), F.length(c))


def local_km(sites: DataFrame, order: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Offsets in kilometres from the first site; one factor for both axes."""
    origin = sites.agg(F.min_by(F.struct(lat, lon), order).alias("_o")).select(
        F.col("_o")[lat].alias("_lat"), F.col("_o")[lon].alias("_lon")
    )
    out = attach(sites, origin, [])
    return out.withColumns(
        {"x_km": (F.col(lat) - F.col("_lat")) * KM_PER_DEGREE, "y_km": (F.col(lon) - F.col("_lon")) * KM_PER_DEGREE}
    ).drop("_lat", "_lon")


def melt_channels(df: DataFrame, ts: str) -> DataFrame:
    """Columns named <signal>_<height>m to rows (ts, signal, height_m, value); the height matches exactly."""
    names = [c for c in df.columns if c != ts]
    long = df.select(ts, *names).unpivot([ts], names, "_name", "value")
    pattern = r"^(.*)_(\d+)m$"
    height = F.regexp_extract("_name", pattern, 2)
    return long.filter(height != "").select(
        F.col(ts),
        F.regexp_extract("_name", pattern, 1).alias("signal"),
        height.cast("int").alias("height_m"),
        F.col("value"),
    )


def record_at(df: DataFrame, ts: str, at) -> DataFrame:
    """The rows of one time stamp."""
    return df.filter(F.col(ts) == at)


def snapshot(scada: DataFrame, sites: DataFrame, at, turbine: str = "turbine") -> DataFrame:
    """One time step of all turbines with their positions."""
    return record_at(scada, "ts", at).join(sites, turbine)


def filename_fields(path: str | Column) -> dict[str, Column]:
    """Delay after '=', sixth '_' part, and last digit group of a file name."""
    c = col(path)
    name = F.element_at(F.split(c, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    digits = F.regexp_extract_all(stem, F.lit(r"(\d+)"), F.lit(1))
    delay = F.regexp_extract(stem, r"=(-?\d+(?:\.\d+)?)", 1)
    parts = F.split(stem, "_")
    return {
        "delay": F.when(delay != "", delay.cast("double")),
        "part6": F.when(F.size(parts) >= 6, F.get(parts, F.lit(5))),
        "frame_no": F.when(F.size(digits) > 0, F.element_at(digits, -1).cast("bigint")),
    }


def save_cases(df: DataFrame, path: str, case: str = "case_id") -> None:
    """One folder per case, so a case is read without touching the others."""
    df.write.mode("error").partitionBy(case).parquet(path)


PEAK_SCHEMA = (
    "scenario DOUBLE, encounter_location DOUBLE, circulation DOUBLE, cl1 DOUBLE, cl2 DOUBLE, r DOUBLE,"
    " cl1_se DOUBLE, cl2_se DOUBLE, peak_rms DOUBLE, noise_rms DOUBLE"
)


def read_peaks(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Peak-force summaries of several wings, tagged with the wing."""
    out = None
    for wing, path in paths.items():
        part = spark.read.schema(PEAK_SCHEMA).option("header", True).csv(path).withColumn("wing", F.lit(wing))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no wing given")
    return out

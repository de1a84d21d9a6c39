"""Domain views over the driver's tables, as Spark DataFrames and as SQL text.

Arithmetic that both engines can read is written once, as SQL text.  Numbering
is done with ``ordinal`` on Spark, so a hot user does not end in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import ordinal
from ..operators.binning import Axis, with_bins

# ------------------------------------------------------------------ grids

X8 = Axis("x", 0.0, 50.0, 8)
Y11 = Axis("y", -0.005, 0.105, 11)
Z3 = Axis("z", -0.005, 0.085, 3)
GRID = (X8, Y11, Z3)


def num(v: float) -> str:
    """A number as a DOUBLE literal in both dialects."""
    return f"({float(v)!r}e0)" if "e" not in repr(float(v)) else f"({float(v)!r})"


def bin_sql(c: str, lo: float, hi: float, n) -> str:
    inner = f"floor(({c} - {num(lo)}) * {n} / {num(hi - lo)}) + 1"
    return f"case when {c} >= {num(lo)} and {c} <= {num(hi)} then least({inner}, {n}) end"


def axis_sql(a: Axis) -> str:
    return f"{bin_sql(a.column, a.lo, a.hi, a.n)} as {a.name}"


def grid_sql(axes=GRID, source: str | None = None) -> str:
    """Samples with bin numbers, outside ones dropped."""
    cols = ", ".join(axis_sql(a) for a in axes)
    keep = " and ".join(f"{a.name} is not null" for a in axes)
    return f"(select * from (select *, {cols} from {source or SAMPLES} as src) as binned where {keep})"


# ------------------------------------------------------------------ tracks

_TRACK_COLUMNS = """
    user_id as track_id, value as x,
    cast(regexp_extract(props, '([0-9]+)', 1) as double) as y,
    hour(ts) + minute(ts) / 60e0 as z
"""
TRACKS = f"""(
    select {_TRACK_COLUMNS}, event_type,
           row_number() over (partition by user_id order by ts, event_id) - 1 as frame
    from events)"""
GAPPY = f"(select * from {TRACKS} as every_row where event_type <> 'error')"
DT = 0.01


def spark_tracks(t) -> DataFrame:
    numbered = ordinal(t.events, ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), "frame")
    return t.spark.sql(
        f"select {_TRACK_COLUMNS}, event_type, frame from {{rows}}", rows=numbered
    )


def spark_gappy(t) -> DataFrame:
    return t.tracks.filter(F.col("event_type") != "error")


# ----------------------------------------------------------------- samples

_SAMPLE_COLUMNS = """
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 10 as run, l_shipdate,
    l_quantity as x, l_discount as y, l_tax as z,
    l_extendedprice / 1e4 as u, l_quantity * (1 - l_discount) / 10e0 as v,
    l_extendedprice * l_tax / 1e4 as w
"""
SAMPLES = f"(select {_SAMPLE_COLUMNS} from lineitem)"


def spark_samples(t) -> DataFrame:
    return t.spark.sql(f"select {_SAMPLE_COLUMNS} from {{rows}}", rows=t.lineitem)


# -------------------------------------------------------------------- flow

FLOW = """(
    select vec_id as seed, label,
           cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z,
           cast(embedding[4] as double) as x1, cast(embedding[5] as double) as y1, cast(embedding[6] as double) as z1
    from embeddings)"""


def spark_flow(t) -> DataFrame:
    names = ("x", "y", "z", "x1", "y1", "z1")
    return t.embeddings.select(
        F.col("vec_id").alias("seed"),
        "label",
        *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate(names)],
    )


# ------------------------------------------------------------ observations

_OBS = """
    select o_orderkey as frame, o_orderkey % 10 as run, camera, idx,
           100e0 + (o_totalprice * (camera + 1 + 3 * idx)) % 400 as x,
           100e0 + (o_custkey * (camera + 2 + idx)) % 300 as y,
           10e0 - 4 * idx as radius,
           (o_totalprice % 100) / 100e0 + 1 - idx * 0.5e0 as metric
    from (select o_orderkey, o_custkey, floor(o_totalprice) as o_totalprice, camera, idx from {source}) as seen
    where (o_orderkey + camera) % 7 <> 0
"""
OBS = "(" + _OBS.format(
    source="orders, (select unnest([0, 1, 2, 3]) as camera), (select unnest([0, 1]) as idx)"
) + ")"
CAMERAS = (0, 1, 2, 3)


def spark_obs(t) -> DataFrame:
    wide = (
        t.orders.withColumn("camera", F.explode(F.array(*[F.lit(c) for c in CAMERAS])))
        .withColumn("idx", F.explode(F.array(F.lit(0), F.lit(1))))
    )
    return t.spark.sql(_OBS.format(source="{rows}"), rows=wide)


# ------------------------------------------------------------------- SCADA

_SCADA_RAW = """
    o_orderdate as ts, o_custkey % 15 as turbine,
    (o_orderkey * 37) % 360 + 0e0 as wind_dir,
    3 + (floor(o_totalprice) % 2000) / 100e0 as wind_speed,
    (floor(o_totalprice) % 150) / 10e0 as rpm,
    floor(o_totalprice) % 5000 - 100e0 as power,
    (o_orderkey * 37 + o_custkey) % 360 + 0e0 as yaw
"""
_SCADA_MEAN = """
    select ts, turbine, avg(wind_dir) as wind_dir, avg(wind_speed) as wind_speed,
           avg(rpm) as rpm, avg(power) as power, avg(yaw) as yaw
    from {source} as raw group by ts, turbine
"""
SCADA = "(" + _SCADA_MEAN.format(source=f"(select {_SCADA_RAW} from orders)") + ")"


def spark_scada(t) -> DataFrame:
    raw = t.spark.sql(f"select {_SCADA_RAW} from {{rows}}", rows=t.orders)
    return t.spark.sql(_SCADA_MEAN.format(source="{rows}"), rows=raw)


# ------------------------------------------------------------------ signal

_SIGNAL_COLUMNS = """
    event_type as case_id, value / 10e0 as u,
    cast(regexp_extract(props, '([0-9]+)', 1) as double) / 10e0 as v
"""
SIGNAL = f"""(
    select {_SIGNAL_COLUMNS},
           row_number() over (partition by event_type order by ts, event_id) - 1 as n
    from events)"""
FS = 100.0


def spark_signal(t) -> DataFrame:
    numbered = ordinal(t.events, ["event_type"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "n")
    return t.spark.sql(f"select {_SIGNAL_COLUMNS}, n from {{rows}}", rows=numbered)


# ------------------------------------------------------------------- tower

_TOWER_COLUMNS = """
    l_orderkey % 10 as record, l_linenumber * 15 as height,
    l_extendedprice / 1e4 as u, l_quantity / 10e0 as v, (l_discount - 0.05e0) * 10 as w,
    290e0 + 100 * l_tax + l_quantity / 25e0 as temp
"""
_TOWER_ORDER = "l_shipdate, l_orderkey, l_partkey, l_suppkey, l_extendedprice"
TOWER = f"""(
    select {_TOWER_COLUMNS},
           row_number() over (partition by l_orderkey % 10, l_linenumber order by {_TOWER_ORDER}) - 1 as n
    from lineitem)"""


def spark_tower(t) -> DataFrame:
    rows = t.lineitem.withColumn("_record", F.col("l_orderkey") % 10)
    numbered = ordinal(
        rows, ["_record", "l_linenumber"], _TOWER_ORDER.split(", "), F.date_trunc("month", "l_shipdate"), "n"
    )
    return t.spark.sql(f"select {_TOWER_COLUMNS}, n from {{rows}}", rows=numbered)


# ------------------------------------------------------------------ pixels

_PIXELS = """
    select l_orderkey % 4 as cam, l_suppkey % 8 as frame, l_partkey % 16 as row,
           cast(floor(l_orderkey / 4) as bigint) % 16 as col, cast(sum(l_quantity) as int) as value
    from {source} as raw
    group by l_orderkey % 4, l_suppkey % 8, l_partkey % 16, cast(floor(l_orderkey / 4) as bigint) % 16
"""
PIXELS = "(" + _PIXELS.format(source="lineitem") + ")"


def spark_pixels(t) -> DataFrame:
    return t.spark.sql(_PIXELS.format(source="{rows}"), rows=t.lineitem)


TWO_PI = num(2 * math.pi)

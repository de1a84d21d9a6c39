"""Joins of samples with bins, profiles, cameras and each other (J operators)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import attach, range_slots
from ..functions.scalars import angle_diff, stderr
from ..session import cut
from .binning import Axis, bin_means, with_bins


def attach_bin_mean(
    df: DataFrame, axes: Sequence[Axis], values: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Each sample with the mean of its bin (mean_<c>) and its deviation (<c>_p)."""
    keys = [*by, *[a.name for a in axes]]
    means = bin_means(df, axes, values, by).select(
        *keys, *[F.col(v).alias(f"mean_{v}") for v in values]
    )
    joined = with_bins(df, axes).join(means, keys)
    return joined.withColumns({f"{v}_p": F.col(v) - F.col(f"mean_{v}") for v in values})


# ------------------------------------------------------------- interpolation


def _intervals(table: DataFrame, by: Sequence[str], x: str, extra: Sequence[Column]) -> DataFrame:
    """One row per interval of a tabulated curve: x0, x1, position and size."""
    w = Window.partitionBy(*by).orderBy(x)
    whole = Window.partitionBy(*by)
    nodes = table.select(
        *by,
        F.col(x).alias("_x0"),
        F.lead(x).over(w).alias("_x1"),
        F.row_number().over(w).alias("_i"),
        F.count(F.lit(1)).over(whole).alias("_m"),
        F.min(x).over(whole).alias("_lo"),
        F.max(x).over(whole).alias("_hi"),
        *extra,
    )
    return nodes.filter(F.col("_x1").isNotNull())


def _lookup(df: DataFrame, by: Sequence[str], x: str, intervals: DataFrame, extrapolate: bool) -> DataFrame:
    """Join every row to the one interval that holds x.

    The curve's range is cut into twice as many equal cells as it has nodes; a
    row looks only at the intervals that touch its cell.  This is an equi-join
    on (group, cell), so it needs no pair of every row with every interval.
    """
    by = list(by)
    cells = 2 * F.col("_m")

    def cell(v: Column) -> Column:
        raw = F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells)
        return F.least(F.greatest(raw, F.lit(0)), (cells - 1).cast("bigint"))

    first, last = F.col("_i") == 1, F.col("_i") == F.col("_m") - 1
    spread = intervals.withColumn(
        "_cell", F.explode(F.sequence(cell(F.col("_x0")), cell(F.col("_x1"))))
    ).select(
        *by,
        "_cell",
        *[c for c in intervals.columns if c not in {*by, "_i", "_m", "_lo", "_hi"}],
        first.alias("_first"),
        last.alias("_last"),
    )
    ranges = intervals.groupBy(*by).agg(
        F.max("_m").alias("_m"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    rows = attach(df, ranges, by, "left")
    inside = F.col(x).between(F.col("_lo"), F.col("_hi"))
    if not extrapolate:
        rows = rows.withColumn("_x", F.when(inside, F.col(x)))
    else:
        rows = rows.withColumn("_x", F.col(x))
    rows = rows.withColumn("_cell", F.coalesce(cell(F.col("_x")), F.lit(0)))
    left, right = rows.alias("l"), spread.alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*by, "_cell"]]
    v = F.col("l._x")
    missing = v.isNull() & F.col("r._first")
    on.append(
        F.coalesce(
            (F.col("r._first") | (v >= F.col("r._x0"))) & (F.col("r._last") | (v < F.col("r._x1"))),
            missing,
        )
    )
    keep = [F.col(f"l.{c}") for c in [*df.columns, "_x"]]
    more = [F.col(f"r.{c}") for c in spread.columns if c not in {*by, "_cell", "_first", "_last"}]
    return left.join(right, on, "left").select(*keep, *more)


def interp_linear(
    df: DataFrame, x: str, table: DataFrame, tx: str, values: Sequence[str],
    by: Sequence[str] = (), extrapolate: bool = True, suffix: str = "_at",
) -> DataFrame:
    """Linear interpolation of tabulated curves; ends are continued or give NULL.

    Rows of groups with fewer than two nodes have no interval and get NULL.
    """
    w = Window.partitionBy(*by).orderBy(tx)
    clean = table.dropna(subset=[tx, *values])
    extra = [c for v in values for c in (F.col(v).alias(f"_a_{v}"), F.lead(v).over(w).alias(f"_b_{v}"))]
    found = _lookup(df, by, x, _intervals(clean, by, tx, extra), extrapolate)
    t = (F.col("_x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    out = [
        (F.col(f"_a_{v}") + t * (F.col(f"_b_{v}") - F.col(f"_a_{v}"))).alias(f"{v}{suffix}")
        for v in values
    ]
    return found.select(*df.columns, *out)


def pchip_slopes(table: DataFrame, by: Sequence[str], tx: str, value: str, name: str) -> DataFrame:
    """Shape-preserving node slopes of a small table, by windows over its nodes."""
    w = Window.partitionBy(*by).orderBy(tx)
    rise = F.lead(value).over(w) - F.col(value)
    work = table.withColumn("_h", F.lead(tx).over(w) - F.col(tx)).withColumn("_d", rise / F.col("_h"))
    work = work.withColumns(
        {
            "_hp": F.lag("_h").over(w),
            "_dp": F.lag("_d").over(w),
            "_hn": F.lead("_h").over(w),
            "_dn": F.lead("_d").over(w),
            "_hq": F.lag("_h", 2).over(w),
            "_dq": F.lag("_d", 2).over(w),
        }
    )
    h, d, hp, dp = (F.col(c) for c in ("_h", "_d", "_hp", "_dp"))
    w1, w2 = 2 * h + hp, h + 2 * hp
    interior = F.when(dp * d <= 0, 0.0).otherwise((w1 + w2) / (w1 / dp + w2 / d))

    def end(h0, d0, h1, d1):
        # two nodes only: the straight line
        raw = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        limited = F.when(F.signum(raw) != F.signum(d0), 0.0).when(
            (F.signum(d0) != F.signum(d1)) & (F.abs(raw) > 3 * F.abs(d0)), 3 * d0
        )
        return F.when(h1.isNull(), d0).otherwise(F.coalesce(limited, raw))

    at_start = end(h, d, F.col("_hn"), F.col("_dn"))
    at_end = end(hp, dp, F.col("_hq"), F.col("_dq"))
    slope = F.when(hp.isNull(), at_start).when(h.isNull(), at_end).otherwise(interior)
    return work.withColumn(name, slope).drop("_h", "_d", "_hp", "_dp", "_hn", "_dn", "_hq", "_dq")


def interp_pchip(
    df: DataFrame, x: str, table: DataFrame, tx: str, values: Sequence[str],
    by: Sequence[str] = (), extrapolate: bool = True, suffix: str = "_at",
) -> DataFrame:
    """Piecewise cubic, shape-preserving interpolation; the end cubics are continued."""
    nodes = table.dropna(subset=[tx, *values])
    for v in values:
        nodes = pchip_slopes(nodes, by, tx, v, f"_m_{v}")
    w = Window.partitionBy(*by).orderBy(tx)
    extra = [
        c
        for v in values
        for c in (
            F.col(v).alias(f"_a_{v}"),
            F.lead(v).over(w).alias(f"_b_{v}"),
            F.col(f"_m_{v}"),
            F.lead(f"_m_{v}").over(w).alias(f"_n_{v}"),
        )
    ]
    found = _lookup(df, by, x, _intervals(nodes, by, tx, extra), extrapolate)
    h = F.col("_x1") - F.col("_x0")
    s = F.col("_x") - F.col("_x0")
    out = []
    for v in values:
        a, m, n = F.col(f"_a_{v}"), F.col(f"_m_{v}"), F.col(f"_n_{v}")
        d = (F.col(f"_b_{v}") - a) / h
        c2 = (3 * d - 2 * m - n) / h
        c3 = (m - 2 * d + n) / (h * h)
        out.append((a + s * (m + s * (c2 + s * c3))).alias(f"{v}{suffix}"))
    return found.select(*df.columns, *out)


# ---------------------------------------------------------------- observations


def complete_frames(obs: DataFrame, by: Sequence[str], frame: str, cameras: int, points: int) -> DataFrame:
    """Frames with exactly one row for every (camera, point); a duplicate drops the frame."""
    per = obs.groupBy(*by, frame, "camera", "idx").agg(F.count(F.lit(1)).alias("_k"))
    return (
        per.groupBy(*by, frame)
        .agg(F.count(F.lit(1)).alias("_cells"), F.max("_k").alias("_most"))
        .filter((F.col("_cells") == cameras * points) & (F.col("_most") == 1))
        .select(*by, frame)
    )


def frames_seen_by_all(
    obs: DataFrame, cameras: int, points: int = 2, by: Sequence[str] = (), frame: str = "frame"
) -> DataFrame:
    """Observations of the complete frames."""
    return obs.join(complete_frames(obs, by, frame, cameras, points), [*by, frame], "left_semi")


def point_pairs(
    obs: DataFrame, by: Sequence[str], values: Sequence[str], index: str = "idx"
) -> DataFrame:
    """The two points of a group side by side: <c>0 and <c>1; incomplete pairs are dropped."""
    aggs = []
    for i in (0, 1):
        for c in values:
            aggs.append(F.max(F.when(F.col(index) == i, F.col(c))).alias(f"{c}{i}"))
    need = [f"{c}{i}" for i in (0, 1) for c in values]
    return obs.groupBy(*by).agg(*aggs).dropna(subset=need)


def camera_pairs(
    obs: DataFrame, by: Sequence[str], cameras: Sequence[int], values: Sequence[str]
) -> DataFrame:
    """Every two cameras c1 < c2 that saw the same point: (by, c1, c2, <v>_1, <v>_2).

    One aggregate puts the cameras of a point side by side; pairs come from the
    fixed camera list, so a point gives at most n(n-1)/2 rows without a self-join.
    """
    cameras = sorted(cameras)
    seen = obs.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("camera") == c, F.struct(*values))).alias(f"_p{c}")
            for c in cameras
        ]
    )
    pairs = [
        F.when(
            F.col(f"_p{a}").isNotNull() & F.col(f"_p{b}").isNotNull(),
            F.struct(
                F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"_p{a}").alias("p"), F.col(f"_p{b}").alias("q")
            ),
        )
        for k, a in enumerate(cameras)
        for b in cameras[k + 1 :]
    ]
    rows = seen.select(*by, F.explode(F.array_compact(F.array(*pairs))).alias("_r"))
    return rows.select(
        *by,
        F.col("_r.c1").alias("c1"),
        F.col("_r.c2").alias("c2"),
        *[F.col("_r.p")[v].alias(f"{v}_1") for v in values],
        *[F.col("_r.q")[v].alias(f"{v}_2") for v in values],
    )


def lagged_pairs(
    df: DataFrame, by: Sequence[str], index: str, values: Sequence[str], max_lag: int
) -> DataFrame:
    """Each row with the row ``lag`` positions later, for lag 0..max_lag.

    The lags are listed on the earlier side, which makes an equi-join on the
    position.  Meant for short lags; longer ones go to ``lagrangian.lag_sums``.
    """
    left = df.select(
        *by, F.col(index), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"),
        *[F.col(v).alias(f"{v}_0") for v in values],
    ).withColumn("_to", F.col(index) + F.col("lag"))
    right = df.select(*by, F.col(index).alias("_to"), *[F.col(v).alias(f"{v}_1") for v in values])
    return left.join(right, [*by, "_to"]).drop("_to")


def flow_map(
    df: DataFrame, by: Sequence[str], track: str, index: str, starts: Sequence[int], m: int,
    positions: Sequence[str] = ("x", "y", "z"), require_span: bool = False,
) -> DataFrame:
    """Start and end position of every track present at frames i0 and i0+m, for all i0 at once."""
    if m == 0:
        raise ValueError("zero-length window")
    where = F.struct(*positions)
    windows = F.array(*[F.lit(int(s)) for s in starts])
    i = F.col(index)
    lo, hi = F.least(F.col("i0"), F.col("i0") + m), F.greatest(F.col("i0"), F.col("i0") + m)
    needed = i.between(lo, hi) if require_span else (i == F.col("i0")) | (i == F.col("i0") + m)
    rows = df.dropna(subset=list(positions))
    if not require_span:
        ends = sorted({f for s in starts for f in (int(s), int(s) + m)})
        rows = rows.filter(i.isin(ends))
    found = (
        rows.withColumn("i0", F.explode(windows))
        .filter(needed)
        .groupBy(*by, "i0", track)
        .agg(
            F.max(F.when(i == F.col("i0"), where)).alias("_a"),
            F.max(F.when(i == F.col("i0") + m, where)).alias("_b"),
            F.count(F.lit(1)).alias("_k"),
        )
        .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    )
    if require_span:
        found = found.filter(F.col("_k") == abs(m) + 1)
    return found.select(
        *by,
        "i0",
        track,
        *[F.col("_a")[p].alias(p) for p in positions],
        *[F.col("_b")[p].alias(f"{p}1") for p in positions],
    )


def compare_profiles(
    bins: DataFrame, reference: DataFrame, axis: Axis, values: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Profile rows with the reference profile interpolated to their centres and the error."""
    rows = bins.withColumn("yc", axis.centre(F.col(axis.name)))
    both = interp_pchip(rows, "yc", reference, axis.column, values, by, suffix="_ref")
    return both.withColumns({f"err_{v}": F.col(v) - F.col(f"{v}_ref") for v in values})


def conditional_rows(
    df: DataFrame, direction: str, centre: float, half: float, row: Sequence[int],
    turbine: str = "turbine", farm_direction: str = "mean_dir",
) -> DataFrame:
    """Rows within ±half of a direction, and of the opposite one with the row reversed.

    Adds ``position`` (1 = upwind) and ``flipped``; only turbines of the row stay.
    """
    place = F.array_position(F.array(*[F.lit(int(t)) for t in row]), F.col(turbine).cast("int"))
    inside = df.withColumn("position", place).filter(F.col("position") > 0)
    d = F.col(farm_direction)
    near = F.abs(angle_diff(d, F.lit(float(centre)))) <= half
    far = F.abs(angle_diff(d, F.lit(float(centre) + 180.0))) <= half
    ahead = inside.filter(near).withColumn("flipped", F.lit(False))
    back = inside.filter(far).withColumn("flipped", F.lit(True))
    back = back.withColumn("position", len(row) + 1 - F.col("position"))
    return ahead.unionByName(back)


def align_repeats(
    df: DataFrame, by: Sequence[str], repeat: str, t: str, values: Sequence[str], first: int = 1
) -> DataFrame:
    """Resample every repeat to an even time grid spanning the first repeat.

    The grid has as many points as the first repeat has samples: (by, repeat, i, t, values).
    """
    # read for the grid, the repeats and the nodes
    df = cut(df.select(*by, repeat, t, *values))
    base = df.filter(F.col(repeat) == first).groupBy(*by).agg(
        F.min(t).alias("_a"), F.max(t).alias("_b"), F.count(F.lit(1)).alias("_n")
    )
    step = (F.col("_b") - F.col("_a")) / (F.col("_n") - 1)
    grid = base.filter(F.col("_n") > 1).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))
    ).select(*by, "i", (F.col("_a") + F.col("i") * step).alias("tc"))
    repeats = df.select(*by, repeat).distinct()
    wanted = grid.join(repeats, list(by))
    return interp_long(wanted, "tc", df, t, values, [*by, repeat])


def repeat_average(aligned: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, standard deviation and standard error of a value over the repeats at each grid point."""
    g = aligned.groupBy(*by, "i").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    return g.withColumn("se", stderr("std", "n"))


def interp_long(
    df: DataFrame, x: str, table: DataFrame, tx: str, values: Sequence[str], by: Sequence[str], suffix: str = "",
    slots: int | None = None,
) -> DataFrame:
    """``interp_linear`` for long curves (millions of nodes per group).

    Curve and queries are dealt together by ranges of (by, x) that hold about as
    many rows each, however the nodes crowd; queries of one x are told apart by a
    hash, so many of them don't gather in one range.  The last node before and the
    first node after each query are found inside its range or, beyond its borders,
    from one row per range.  Rows of groups with fewer than two nodes get NULL.
    """
    by = list(by)
    ranges = table.dropna(subset=[tx, *values]).groupBy(*by).agg(
        F.min(tx).alias("_lo"), F.max(tx).alias("_hi"), F.count(F.lit(1)).alias("_m")
    ).filter(F.col("_m") > 1)
    node = F.struct(F.col(tx).alias("x"), *[F.col(v) for v in values])
    others = [c for c in df.columns if c not in by]
    payload = F.struct(*others)
    nodes = attach(table.dropna(subset=[tx, *values]), ranges, by).select(
        *by, F.col(tx).alias("_x"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"),
        node.alias("_node"), F.lit(None).alias("_row"),
    )
    queries = df.select(
        *by, F.col(x).alias("_x"), F.lit(1).alias("_kind"), F.xxhash64(*others).alias("_tie"),
        F.lit(None).alias("_node"), payload.alias("_row"),
    )
    both = range_slots(nodes.unionByName(queries), [*by, "_x", "_kind", "_tie"], slots)
    nodes = both.filter(F.col("_kind") == 0)
    w = Window.partitionBy(*by, "_slot")
    order = [F.col(c) for c in ("_x", "_kind", "_node")]
    # Both windows run from their first row on: one that looks ahead to the last row
    # would go over the rest of the slot again for every row.
    back = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumns(
        {
            "_p": F.last("_node", ignorenulls=True).over(back),
            "_n": F.last("_node", ignorenulls=True).over(ahead),
        }
    )
    # Border nodes per slot: the two outermost ones, enough for end extrapolation too.
    first2 = _slot_edge(nodes, by, True)
    last2 = _slot_edge(nodes, by, False)
    edges = first2.join(last2, [*by, "_slot"])
    all_slots = near.filter(F.col("_kind") == 1).select(*by, "_slot").distinct().join(
        edges, [*by, "_slot"], "full"
    )
    s = Window.partitionBy(*by)
    prior = s.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    later = s.orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    reach = all_slots.select(
        *by,
        "_slot",
        F.last("_l0", ignorenulls=True).over(prior).alias("_before"),
        F.last("_f0", ignorenulls=True).over(later).alias("_after"),
    )
    head = _two_extreme(nodes, by, True)
    tail = _two_extreme(nodes, by, False)
    rows = near.filter(F.col("_kind") == 1).join(reach, [*by, "_slot"], "left")
    rows = attach(rows, attach(attach(ranges, head, by, "left"), tail, by, "left"), by, "left")
    p = F.coalesce("_p", "_before")
    n = F.coalesce("_n", "_after")
    a = F.when(F.col("_x") < F.col("_lo"), F.col("_h0")).when(F.col("_x") >= F.col("_hi"), F.col("_t1")).otherwise(p)
    b = F.when(F.col("_x") < F.col("_lo"), F.col("_h1")).when(F.col("_x") >= F.col("_hi"), F.col("_t0")).otherwise(n)
    rows = rows.withColumns({"_a": a, "_b": b})
    share = (F.col("_x") - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    return rows.select(
        *by,
        *[F.col("_row")[c].alias(c) for c in others],
        *[
            (F.col("_a")[v] + share * (F.col("_b")[v] - F.col("_a")[v])).alias(f"{v}{suffix}")
            for v in values
        ],
    )


def _slot_edge(nodes: DataFrame, by: Sequence[str], first: bool) -> DataFrame:
    pick = F.min if first else F.max
    return nodes.groupBy(*by, "_slot").agg(pick("_node").alias("_f0" if first else "_l0"))


def _two_extreme(nodes: DataFrame, by: Sequence[str], first: bool) -> DataFrame:
    """The two outermost nodes of every curve."""
    order = F.col("_x").asc() if first else F.col("_x").desc()
    w = Window.partitionBy(*by).orderBy(order)
    top = nodes.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
    names = ("_h0", "_h1") if first else ("_t0", "_t1")
    return top.groupBy(*by).agg(
        F.max(F.when(F.col("_r") == 1, F.col("_node"))).alias(names[0]),
        F.max(F.when(F.col("_r") == 2, F.col("_node"))).alias(names[1]),
    )


def band_of(value: str | Column, centres: Sequence[float], half: float) -> Column:
    """1-based number of the first band centre within ±half; NULL outside all bands."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(
        *[F.when(F.abs(v - float(c)) <= half, F.lit(i + 1)) for i, c in enumerate(centres)]
    )


def track_start_band(
    df: DataFrame, by: Sequence[str], index: str, value: str, centres: Sequence[float], half: float
) -> DataFrame:
    """Every row with the band its track starts in."""
    start = df.groupBy(*by).agg(F.min_by(value, index).alias("_y0"))
    start = start.withColumn("band", band_of("_y0", centres, half)).drop("_y0")
    return attach(df, start, by)

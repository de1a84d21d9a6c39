"""Operators along an ordered sequence: tracks, records, curves (W operators).

``index`` is always a non-negative integer position with at most one row per
group.  Where a neighbour means "the adjacent row", the index must be dense;
``compact`` or ``core.ordinal`` makes it so.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import BLOCK, attach, ordinal, running, top_k, windowed


def _next_is_adjacent(index: str, w) -> Column:
    return F.lead(index).over(w) == F.col(index) + 1


def forward_velocity(
    df: DataFrame, by: Sequence[str], index: str, positions: Sequence[str], rate: float, size: int = BLOCK
) -> DataFrame:
    """Forward difference at the mid-point, only between adjacent frames.

    Adds <c>_mid and v_<c> per position; the last sample of a run has no row.
    """

    def build(rows, w):
        cols = {"_ok": _next_is_adjacent(index, w)}
        for c in positions:
            nxt = F.lead(c).over(w)
            cols[f"{c}_mid"] = (F.col(c) + nxt) / 2
            cols[f"v_{c}"] = (nxt - F.col(c)) * rate
        return rows.withColumns(cols)

    return windowed(df, by, index, 0, 1, build, size).filter("_ok").drop("_ok")


def midpoint_position(
    df: DataFrame, by: Sequence[str], index: str, positions: Sequence[str], size: int = BLOCK
) -> DataFrame:
    """Replace positions by mid-points of adjacent samples; other columns stay those of the left one."""

    def build(rows, w):
        cols = {c: (F.col(c) + F.lead(c).over(w)) / 2 for c in positions}
        return rows.withColumns({**cols, "_ok": _next_is_adjacent(index, w)})

    return windowed(df, by, index, 0, 1, build, size).filter("_ok").drop("_ok")


def central_gradient(
    df: DataFrame,
    by: Sequence[str],
    index: str,
    columns: Sequence[str],
    spacing: float | str = 1.0,
    prefix: str = "d_",
    size: int = BLOCK,
) -> DataFrame:
    """Central differences inside, one-sided at the ends.

    ``spacing`` is a constant step or the name of a coordinate column.  A group
    with a single row has no gradient (NULL).
    """

    def build(rows, w):
        def ends(c: Column):
            before, after = F.lag(c).over(w), F.lead(c).over(w)
            return F.coalesce(after, c) - F.coalesce(before, c)

        if isinstance(spacing, str):
            step = ends(F.col(spacing))
        else:
            position = F.col(index).cast("double")
            step = ends(position) * float(spacing)
        return rows.withColumns(
            {f"{prefix}{c}": F.when(step != 0, ends(F.col(c)) / step) for c in columns}
        )

    return windowed(df, by, index, 1, 1, build, size)


def first_contiguous_segment(
    df: DataFrame, by: Sequence[str], index: str, min_length: int = 1, size: int = BLOCK
) -> DataFrame:
    """The leading run of consecutive frames of each group, if long enough.

    A run ends where the next frame is missing, so the first run is bounded by
    the smallest frame and the smallest run end: two aggregates, no ranking.
    """

    def build(rows, w):
        return rows.withColumn("_last", ~F.coalesce(_next_is_adjacent(index, w), F.lit(False)))

    marked = windowed(df.select(*by, index), by, index, 0, 1, build, size)
    limits = marked.groupBy(*by).agg(
        F.min(index).alias("_from"), F.min(F.when(F.col("_last"), F.col(index))).alias("_to")
    )
    limits = limits.filter(F.col("_to") - F.col("_from") + 1 >= min_length)
    return attach(df, limits, by).filter(F.col(index) <= F.col("_to")).drop("_from", "_to")


def compact(
    df: DataFrame, by: Sequence[str], index: str, required: Sequence[str], name: str = "n", size: int = BLOCK
) -> DataFrame:
    """Drop rows with missing values and number the rest from 0."""
    kept = df.dropna(subset=list(required))
    return ordinal(kept, by, [index], F.floor(F.col(index) / size), name)


def window_bounds(k: int) -> tuple[int, int]:
    """Rows before and after the centre of a k-row moving window."""
    if k < 1:
        raise ValueError("window must hold at least one row")
    return k // 2, (k - 1) // 2


def moving_mean(
    df: DataFrame, by: Sequence[str], index: str, columns: Sequence[str], k: int,
    prefix: str = "mm_", size: int = BLOCK,
) -> DataFrame:
    """Centred moving mean of k rows with shrinking ends."""
    before, after = window_bounds(k)

    def build(rows, w):
        frame = w.rowsBetween(-before, after)
        return rows.withColumns({f"{prefix}{c}": F.avg(c).over(frame) for c in columns})

    return windowed(df, by, index, before, after, build, size)


def fluctuation(df: DataFrame, by: Sequence[str], columns: Sequence[str], suffix: str = "_p") -> DataFrame:
    """Value minus the group mean."""
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    out = attach(df, means, by)
    out = out.withColumns({f"{c}{suffix}": F.col(c) - F.col(f"_m_{c}") for c in columns})
    return out.drop(*[f"_m_{c}" for c in columns])


def vertical_gradient(levels: DataFrame, by: Sequence[str], height: str, value: str, name: str) -> DataFrame:
    """d value / d height over a table of levels (one row per height)."""
    w = Window.partitionBy(*by).orderBy(height)

    def ends(c):
        return F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))

    step = ends(height)
    return levels.withColumn(name, F.when(step != 0, ends(value) / step))


def peak_region(df: DataFrame, by: Sequence[str], index: str, value: str, frac: float) -> DataFrame:
    """Mark the run above frac*max that holds the (first) maximum: column in_peak."""
    top = df.groupBy(*by).agg(
        F.max(value).alias("_max"),
        F.max_by(index, F.struct(F.col(value), -F.col(index))).alias("_at"),
    )
    rows = attach(df, top, by)
    low = ~F.coalesce(F.col(value) > frac * F.col("_max"), F.lit(False))
    edges = rows.groupBy(*by).agg(
        F.max(F.when(low & (F.col(index) < F.col("_at")), F.col(index))).alias("_lo"),
        F.min(F.when(low & (F.col(index) > F.col("_at")), F.col(index))).alias("_hi"),
    )
    inside = (
        ~low
        & (F.col("_lo").isNull() | (F.col(index) > F.col("_lo")))
        & (F.col("_hi").isNull() | (F.col(index) < F.col("_hi")))
    )
    return attach(rows, edges, by).withColumn("in_peak", inside).drop("_max", "_at", "_lo", "_hi")


def peak_rms(df: DataFrame, by: Sequence[str], index: str, value: str, frac: float) -> DataFrame:
    """RMS inside and outside the peak region, with the row counts."""
    square = F.col(value) * F.col(value)
    inside = F.col("in_peak")
    return peak_region(df, by, index, value, frac).groupBy(*by).agg(
        F.count(F.when(inside, square)).alias("n_peak"),
        F.count(F.when(~inside, square)).alias("n_rest"),
        F.sqrt(F.avg(F.when(inside, square))).alias("rms_peak"),
        F.sqrt(F.avg(F.when(~inside, square))).alias("rms_rest"),
    )


def cumulative_sum(
    df: DataFrame, by: Sequence[str], index: str, columns: Sequence[str], prefix: str = "cum_", size: int = BLOCK
) -> DataFrame:
    return running(df, by, index, {f"{prefix}{c}": F.col(c) for c in columns}, size)


def rank_points(df: DataFrame, by: Sequence[str], metric: str, radius: str, tie: str, k: int = 2) -> DataFrame:
    """The k best rows per group by metric, then numbered by descending radius."""
    best = top_k(df, by, [F.desc(metric), F.asc(tie)], k, "_r").drop("_r")
    w = Window.partitionBy(*by).orderBy(F.desc(radius), F.asc(tie))
    return best.withColumn("rank", F.row_number().over(w))


def first_below(
    df: DataFrame, by: Sequence[str], index: str, value: str, threshold: float,
    name: str = "first", inclusive: bool = False,
) -> DataFrame:
    """First index where the series falls below the threshold, else its last index."""
    v = F.col(value)
    hit = v <= threshold if inclusive else v < threshold
    return df.groupBy(*by).agg(
        F.coalesce(F.min(F.when(hit, F.col(index))), F.max(index)).alias(name)
    )


def trapezoid(
    df: DataFrame, by: Sequence[str], index: str, t: str, y: str, name: str,
    upto: str | None = None, size: int = BLOCK,
) -> DataFrame:
    """Trapezoid integral per group, optionally only up to the index in column ``upto``."""
    rows = df if upto is None else df.filter(F.col(index) <= F.col(upto))

    def build(r, w):
        width = F.col(t) - F.lag(t).over(w)
        return r.withColumn("_a", width * (F.col(y) + F.lag(y).over(w)) / 2)

    return windowed(rows, by, index, 1, 0, build, size).groupBy(*by).agg(
        F.coalesce(F.sum("_a"), F.lit(0.0)).alias(name)
    )


def cumulative_trapezoid(
    df: DataFrame, by: Sequence[str], index: str, t: str, y: str, name: str = "integral", size: int = BLOCK
) -> DataFrame:
    """Running trapezoid integral; 0 at the first row."""

    def build(r, w):
        width = F.col(t) - F.lag(t).over(w)
        return r.withColumn("_a", width * (F.col(y) + F.lag(y).over(w)) / 2)

    panels = windowed(df, by, index, 1, 0, build, size)
    return running(panels, by, index, {name: F.col("_a")}, size).drop("_a")


def detrend_linear(df: DataFrame, by: Sequence[str], x: str, columns: Sequence[str], suffix: str = "_d") -> DataFrame:
    """Subtract the least-squares line of the whole group."""
    aggs = []
    for c in columns:
        aggs += [F.regr_slope(c, x).alias(f"_s_{c}"), F.regr_intercept(c, x).alias(f"_i_{c}")]
    out = attach(df, df.groupBy(*by).agg(*aggs), by)
    out = out.withColumns(
        {f"{c}{suffix}": F.col(c) - (F.col(f"_s_{c}") * F.col(x) + F.col(f"_i_{c}")) for c in columns}
    )
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "si"])


def decimated(df: DataFrame, index: str, n: int) -> DataFrame:
    """Every n-th row of a dense index."""
    return df.filter(F.col(index) % n == 0)


def even_subsample(df: DataFrame, by: Sequence[str], index: str, m: int) -> DataFrame:
    """At most m evenly spaced rows of a dense 0-based index: round(linspace(1, N, m))."""
    if m < 2:
        raise ValueError("need at least two rows")
    counts = df.groupBy(*by).agg((F.max(index) + 1).alias("_n"))
    take = F.least(F.col("_n"), F.lit(m))
    position = 1 + F.col("_j") * (F.col("_n") - 1) / F.greatest(take - 1, F.lit(1))
    wanted = counts.withColumn("_j", F.explode(F.sequence(F.lit(0), (take - 1).cast("int")))).select(
        *by, (F.floor(position + 0.5) - 1).alias(index)
    )
    return df.join(wanted, [*by, index], "left_semi")


def rebase_first(
    df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], chord: float
) -> DataFrame:
    """Offsets from the group's first row in units of the chord, and their length."""
    first = df.groupBy(*by).agg(*[F.min_by(c, order).alias(f"_f_{c}") for c in columns])
    out = attach(df, first, by)
    out = out.withColumns({f"n_{c}": (F.col(c) - F.col(f"_f_{c}")) / chord for c in columns})
    total = sum((F.col(f"n_{c}") * F.col(f"n_{c}") for c in columns), F.lit(0.0))
    return out.withColumn("distance", F.sqrt(total)).drop(*[f"_f_{c}" for c in columns])


def rebase_mean_head(df: DataFrame, by: Sequence[str], index: str, value: str, n: int, name: str) -> DataFrame:
    """Minus (value - mean of the first n samples) of a dense 0-based index."""
    head = df.filter(F.col(index) < n).groupBy(*by).agg(F.avg(value).alias("_h"))
    return attach(df, head, by).withColumn(name, -(F.col(value) - F.col("_h"))).drop("_h")


def rebase_to_known(
    df: DataFrame, by: Sequence[str], order: str, value: str, known: float, name: str
) -> DataFrame:
    """Shift a curve so that its first point equals a known value."""
    first = df.groupBy(*by).agg(F.min_by(value, order).alias("_f"))
    return attach(df, first, by).withColumn(name, F.col(value) - F.col("_f") + known).drop("_f")


def minmax_rescale(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rescale columns to [0, 1] by the group's range; NULL for a constant column."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    out = attach(df, df.groupBy(*by).agg(*aggs), by)
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(c, F.when(span != 0, (F.col(c) - F.col(f"_lo_{c}")) / span))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in ("lo", "hi")])


# ------------------------------------------------------- zero-phase low-pass


def butterworth_sections(order: int, fc: float, fs: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) of an even-order low-pass."""
    if order % 2 or not 0 < fc < fs / 2:
        raise ValueError("need an even order and 0 < fc < fs/2")
    warped = math.tan(math.pi * fc / fs)
    sections = []
    for k in range(order // 2):
        damping = 2 * math.sin(math.pi * (2 * k + 1) / (2 * order))
        a0 = 1 + damping * warped + warped * warped
        g = warped * warped / a0
        sections.append((g, 2 * g, g, 2 * (warped * warped - 1) / a0, (1 - damping * warped + warped * warped) / a0))
    return np.array(sections)


def _state_space(sections: np.ndarray):
    """One linear system (A, B, C, D) for the whole cascade."""
    m = 2 * len(sections)
    a, b = np.zeros((m, m)), np.zeros(m)
    through_state, through_input = np.zeros(m), 1.0
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        i = 2 * k
        out_state = b0 * through_state
        out_state[i] += 1.0
        out_input = b0 * through_input
        a[i] = b1 * through_state - a1 * out_state
        a[i, i + 1] += 1.0
        b[i] = b1 * through_input - a1 * out_input
        a[i + 1] = b2 * through_state - a2 * out_state
        b[i + 1] = b2 * through_input - a2 * out_input
        through_state, through_input = out_state, out_input
    return a, b, through_state, through_input


class _Cascade:
    """Vectorised filtering of a block from a given start state."""

    STEP = 64

    def __init__(self, sections: np.ndarray):
        a, b, c, d = _state_space(sections)
        s, m = self.STEP, len(b)
        self.a, self.m = a, m
        self.steady = np.linalg.solve(np.eye(m) - a, b)
        self.observe, self.reach = np.empty((s, m)), np.empty((s, m))
        impulse = np.empty(s)
        row, state = c.copy(), b.copy()
        for i in range(s):
            self.observe[i] = row
            impulse[i] = d if i == 0 else c @ self.reach[i - 1]
            self.reach[i] = state
            row, state = row @ a, a @ state
        lag = np.subtract.outer(np.arange(s), np.arange(s))
        self.toeplitz = np.where(lag >= 0, impulse[np.abs(lag)], 0.0)
        self.a_step = np.linalg.matrix_power(a, s)

    def run(self, x: np.ndarray, state: np.ndarray):
        """Filtered block and the state after its last sample."""
        s = self.STEP
        whole, rest = divmod(len(x), s)
        out = np.empty(len(x))
        if whole:
            chunks = x[: whole * s].reshape(whole, s)
            driven = chunks @ self.reach[::-1]
            states = np.empty((whole, self.m))
            for k in range(whole):
                states[k] = state
                state = self.a_step @ state + driven[k]
            out[: whole * s] = (chunks @ self.toeplitz.T + states @ self.observe.T).ravel()
        if rest:
            tail = x[whole * s :]
            out[whole * s :] = self.toeplitz[:rest, :rest] @ tail + self.observe[:rest] @ state
            state = np.linalg.matrix_power(self.a, rest) @ state + tail @ self.reach[:rest][::-1]
        return out, state


def _one_pass(df: DataFrame, by: list[str], sections: np.ndarray, size: int) -> DataFrame:
    """Filter (by, e, x) along e, starting from the steady state of the first value."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    key_schema = "".join(f"`{c}` {fields[c]}, " for c in by)
    rows = df.withColumn("_block", F.floor(F.col("e") / size))
    m = 2 * len(sections)

    def keys_of(pdf, n):
        return {c: [pdf[c].iloc[0]] * n for c in by}

    def block_state(pdf):
        cascade = _Cascade(sections)
        x = pdf.sort_values("e")["x"].to_numpy()
        start = cascade.steady * x[0] if pdf["_block"].iloc[0] == 0 else np.zeros(m)
        _, state = cascade.run(x, start)
        return type(pdf)(
            {**keys_of(pdf, 1), "_block": [pdf["_block"].iloc[0]], "_len": [len(x)], "_z": [state]}
        )

    summary = rows.groupBy(*by, "_block").applyInPandas(
        block_state, f"{key_schema}_block bigint, _len int, _z array<double>"
    )

    def chain(pdf):
        cascade = _Cascade(sections)
        pdf = pdf.sort_values("_block")
        full = np.linalg.matrix_power(cascade.a, size)
        state, starts = np.zeros(m), []
        for z in pdf["_z"]:
            starts.append(state)
            state = full @ state + np.asarray(z)
        return type(pdf)({**keys_of(pdf, len(pdf)), "_block": pdf["_block"].to_numpy(), "_s": starts})

    starts = summary.groupBy(*by).applyInPandas(chain, f"{key_schema}_block bigint, _s array<double>")

    def filter_block(key, left, right):
        cascade = _Cascade(sections)
        left = left.sort_values("e")
        x = left["x"].to_numpy()
        start = cascade.steady * x[0] if left["_block"].iloc[0] == 0 else np.asarray(right["_s"].iloc[0])
        y, _ = cascade.run(x, start)
        return type(left)({**keys_of(left, len(left)), "e": left["e"].to_numpy(), "x": y})

    return (
        rows.groupBy(*by, "_block")
        .cogroup(starts.groupBy(*by, "_block"))
        .applyInPandas(filter_block, f"{key_schema}e bigint, x double")
    )


def zero_phase_lowpass(
    df: DataFrame, by: Sequence[str], index: str, value: str, name: str,
    fc: float, fs: float, order: int = 6, size: int = BLOCK,
) -> DataFrame:
    """Forward-backward Butterworth low-pass of every run.

    The filter is linear, so blocks of a run are filtered on their own from a
    start state that is chained over one small row per block; long runs are
    spread over the cluster and the result is that of one sequential pass.
    The ends are extended by 3*order point-reflected samples.  Runs that are no
    longer than that come back unfiltered, with ``filtered`` false.
    """
    by = list(by)
    sections = butterworth_sections(order, fc, fs)
    pad = 3 * order
    ends = df.groupBy(*by).agg(
        (F.max(index) + 1).alias("_n"),
        F.min_by(value, index).alias("_first"),
        F.max_by(value, index).alias("_end"),
    )
    lengths, ends = ends.select(*by, "_n"), ends.filter(F.col("_n") > pad)
    i, n, v = F.col(index), F.col("_n"), F.col(value)
    rows = attach(df.select(*by, index, value), ends, by)
    copies = F.array(
        F.struct((i + pad).alias("e"), v.alias("x")),
        F.when((i >= 1) & (i <= pad), F.struct((pad - i).alias("e"), (2 * F.col("_first") - v).alias("x"))),
        F.when(
            (i <= n - 2) & (i >= n - 1 - pad),
            F.struct((2 * (n - 1) - i + pad).alias("e"), (2 * F.col("_end") - v).alias("x")),
        ),
    )
    extended = rows.select(*by, "_n", F.explode(F.array_compact(copies)).alias("_r")).select(
        *by, "_n", F.col("_r.e").cast("bigint").alias("e"), F.col("_r.x").alias("x")
    )
    forward = _one_pass(extended.drop("_n"), by, sections, size)
    flipped = attach(forward, ends.select(*by, "_n"), by).select(
        *by, (F.col("_n") + 2 * pad - 1 - F.col("e")).alias("e"), "x"
    )
    backward = _one_pass(flipped, by, sections, size)
    done = attach(backward, ends.select(*by, "_n"), by).select(
        *by, (F.col("_n") + pad - 1 - F.col("e")).alias(index), F.col("x").alias(name)
    )
    out = attach(df.join(done, [*by, index], "left"), lengths, by)
    return out.withColumns({name: F.coalesce(name, F.when(F.col("_n") <= pad, F.col(value))), "filtered": F.col("_n") > pad}).drop("_n")

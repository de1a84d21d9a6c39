"""Filters and quality gates (F operators)."""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import BLOCK, attach, exact_quantiles, quantiles_of
from ..session import cut


def valid_samples(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every given column is present."""
    return df.dropna(subset=list(columns))


def min_track_length(df: DataFrame, by: Sequence[str], n: int = 10) -> DataFrame:
    """Rows of groups with at least n rows."""
    long = df.groupBy(*by).count().filter(F.col("count") >= n).select(*by)
    return df.join(long, list(by), "left_semi")


def per_camera(values: Mapping[int, float], camera: str = "camera") -> Column:
    """A per-camera setting as an expression; NULL for other cameras."""
    items = [x for k, v in values.items() for x in (F.lit(int(k)), F.lit(float(v)))]
    return F.element_at(F.create_map(*items), F.col(camera).cast("int"))


def length_gate(pairs: DataFrame, lo: float | Column, hi: float | Column) -> DataFrame:
    """Rows of side-by-side points whose distance lies in [lo, hi]; adds ``length``."""
    length = F.sqrt(F.pow(F.col("x0") - F.col("x1"), 2) + F.pow(F.col("y0") - F.col("y1"), 2))
    return with_gate(pairs.withColumn("length", length), (F.col("length") >= lo) & (F.col("length") <= hi))


def with_gate(df: DataFrame, condition: Column) -> DataFrame:
    """Column ``accepted``; a missing input is a rejection."""
    return df.withColumn("accepted", F.coalesce(condition, F.lit(False)))


def gate_report(gated: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, rejections and percentage accepted per group."""
    kept = F.count(F.when(F.col("accepted"), 1))
    total = F.count(F.lit(1))
    return gated.groupBy(*by).agg(
        total.alias("total"), (total - kept).alias("rejected"), (100.0 * kept / total).alias("pct")
    )


JUMP_STATE = ("frame", "x0", "y0", "x1", "y1")
#: Times that ranges are folded again with the state their predecessor has got.
ROUNDS = 2


def within_jump(state: np.ndarray, rows: np.ndarray, max_jump: float, max_gap: int) -> np.ndarray:
    """Whether each row (frame, x0, y0, x1, y1) is within reach of a state, or of the state beside it."""
    d = rows - state
    reach = max_jump * np.minimum(d[:, 0], max_gap)
    far = np.maximum(d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2], d[:, 3] * d[:, 3] + d[:, 4] * d[:, 4])
    return ~(far > reach * reach)


#: Rows after a violation that are looked at one by one before longer stretches are compared at once.
NEAR = 64


def fold_jumps(rows: np.ndarray, state, max_jump: float, max_gap: int):
    """Accept or reject rows (frame, x0, y0, x1, y1) in order from the last accepted row.

    Rows that follow an accepted row within reach are accepted in one stroke up to
    the first violation; from there the next row within reach is looked for among
    the next rows in plain numbers, then in growing stretches.  The loop runs once
    for each violation, and where violations are many a turn takes a few numbers.
    """
    n = len(rows)
    accepted = np.zeros(n, bool)
    if n > 1 and (np.diff(rows[:, 0]) <= 0).any() or n and state is not None and rows[0, 0] <= state[0]:
        raise ValueError("frames come late or twice; a gate needs them in order")
    if not n:
        return accepted, state
    # rows that their predecessor's state would reject
    breaks = (np.flatnonzero(~within_jump(rows[:-1], rows[1:], max_jump, max_gap)) + 1).tolist()
    listed = rows.tolist() if breaks or state is not None else []

    def next_within(state, at: int) -> int:
        frame, x0, y0, x1, y1 = state
        for k in range(at, min(at + NEAR, n)):
            f, a0, b0, a1, b1 = listed[k]
            gap, a0, b0, a1, b1 = f - frame, a0 - x0, b0 - y0, a1 - x1, b1 - y1
            reach = max_jump * (gap if gap < max_gap else max_gap)
            one, two = a0 * a0 + b0 * b0, a1 * a1 + b1 * b1
            far = one if one > two or one != one else two
            if not far > reach * reach:
                return k
        at, step = at + NEAR, 4 * NEAR
        while at < n:
            found = np.flatnonzero(within_jump(np.asarray(state, float), rows[at : at + step], max_jump, max_gap))
            if len(found):
                return at + int(found[0])
            at, step = at + step, step * 4
        return n

    at = 0 if state is None else next_within([float(v) for v in state], 0)
    last = None
    while at < n:
        k = bisect.bisect_right(breaks, at)
        end = breaks[k] if k < len(breaks) else n
        accepted[at:end] = True
        last = end - 1
        at = next_within(listed[last], end) if end < n else n
    return accepted, state if last is None else rows[last]


def jump_gate(
    pairs: DataFrame, by: Sequence[str], max_jump: float, max_gap: int = 5, size: int = BLOCK
) -> DataFrame:
    """Reject a frame if either point moved too far from the *last accepted* frame.

    Acceptance depends on everything before it, but folds started from different
    states soon agree.  Rows are dealt by ranges of (by, frame) and sorted there, at
    least ``size`` to a range and no more ranges than shuffle partitions.  All ranges
    are folded at the same time, in Arrow batches; only the first group of a range can
    go on from an earlier one, so what is looked at across ranges is one state for
    each.  A range inside one group is folded again when the state its predecessor
    ends with differs from the one it started with; after ``ROUNDS`` of that, ranges
    that still differ (a state that rejects range after range) are folded in order,
    streamed through a task.  The number of jobs doesn't depend on the data, and the
    result equals one sequential pass.
    """
    by = list(by)
    names = [*by, "frame", *[c for c in pairs.columns if c not in {*by, "frame"}]]
    here = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in JUMP_STATE]
    every = cut(pairs.select(*names, functools.reduce(Column.__and__, here).alias("_placed")))
    rows = every.where("_placed").drop("_placed")
    most = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, min(most, rows.count() // size))
    dealt = rows.repartitionByRange(slots, *by, "frame").sortWithinPartitions(*by, "frame")
    dealt = cut(dealt.withColumn("_slot", F.spark_partition_id()))
    needed = dealt.select(*by, *JUMP_STATE, "_slot")

    def walk(batches: Iterable[pa.RecordBatch], starts: Mapping[int, list]) -> Iterator[tuple]:
        """Each stretch of one group in one range: batch, first row, one behind its last, verdicts, state."""
        at, state, late = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in JUMP_STATE])
            slot = batch.column("_slot").to_numpy()
            new = slot[1:] != slot[:-1]
            for c in by:
                code = batch.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                new = new | (code[1:] != code[:-1])
            begins = [0, *(np.flatnonzero(new) + 1).tolist()]
            for a, b in zip(begins, [*begins[1:], len(values)], strict=True):
                now = (int(slot[a]), tuple(batch.column(c)[a].as_py() for c in by))
                if now != at:
                    state = starts.get(now[0]) if at is None or at[0] != now[0] else None
                    late = None
                if late is not None and values[a, 0] <= late:
                    raise ValueError("frames come late or twice; a gate needs them in order")
                at, late = now, values[b - 1, 0]
                ok, state = fold_jumps(values[a:b], state, max_jump, max_gap)
                yield batch, a, b, ok, state

    kinds = {f.name: f.dataType for f in pairs.schema.fields}
    firsts, lasts = [[f"_{side}{i}" for i in range(len(by))] for side in "fl"]
    ends_schema = T.StructType(
        [T.StructField("_slot", T.IntegerType()), *[T.StructField(n, kinds[c]) for side in (firsts, lasts) for n, c in zip(side, by, strict=True)]]
        + [T.StructField("_end", T.ArrayType(T.DoubleType()))]
    )

    def ends_from(starts: Mapping[int, list]):
        """For each range its first and last group and the state it ends with."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def row() -> pa.RecordBatch:
                end = pa.array([None if state is None else [float(v) for v in state]], pa.list_(pa.float64()))
                return pa.record_batch([pa.array([slot], pa.int32()), *first, *last, end], names=ends_schema.names)

            slot = first = last = state = None
            for batch, a, b, _, end in walk(batches, starts):
                number = batch.column("_slot")[a].as_py()
                if number != slot:
                    if slot is not None:
                        yield row()
                    slot, first = number, [batch.column(c).slice(a, 1) for c in by]
                last, state = [batch.column(c).slice(b - 1, 1) for c in by], end
            if slot is not None:
                yield row()

        return run

    def key(row, side: list[str]) -> tuple:
        return tuple(row[c] for c in side)

    # one row for each range
    found = sorted(needed.mapInArrow(ends_from({}), ends_schema).collect(), key=lambda r: r["_slot"])
    ends = {r["_slot"]: r["_end"] for r in found}
    before = {r["_slot"]: p["_slot"] for p, r in zip(found, found[1:], strict=False) if key(p, lasts) == key(r, firsts)}
    inner = [r["_slot"] for r in found if r["_slot"] in before and key(r, firsts) == key(r, lasts)]
    started: dict[int, list | None] = dict.fromkeys(ends)

    def changed() -> dict[int, list]:
        return {s: ends[before[s]] for s in inner if ends[before[s]] != started[s]}

    for _ in range(ROUNDS):
        todo = changed()
        if not todo:
            break
        again = needed.where(F.col("_slot").isin(list(todo))).mapInArrow(ends_from(todo), ends_schema).collect()
        started |= todo
        ends |= {r["_slot"]: r["_end"] for r in again}
    todo = changed()
    if todo:
        # from the first range of a group that differs on, in order
        rest, open_at = [], None
        for s in inner:
            if s in todo or before[s] == open_at:
                rest.append(s)
                open_at = s
        heads = {s: ends[before[s]] for s in rest if before[s] not in rest}
        part = needed.where(F.col("_slot").isin(rest))
        part = (part.repartition(*by) if by else part.coalesce(1)).sortWithinPartitions(*by, "frame")

        def in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = dict(heads)
            for batch, a, _, _, end in walk(batches, known):
                slot = batch.column("_slot")[a].as_py()
                # the range after this one goes on from here
                known[after.get(slot)] = None if end is None else [float(v) for v in end]
                yield pa.record_batch([pa.array([slot], pa.int32()), pa.array([known[after.get(slot)]], pa.list_(pa.float64()))], names=["_slot", "_end"])

        after = {before[s]: s for s in rest}
        states = part.mapInArrow(in_order, "_slot int, _end array<double>").withColumn("_at", F.monotonically_increasing_id())
        ends |= {r["_slot"]: r["_end"] for r in states.groupBy("_slot").agg(F.max_by("_end", "_at").alias("_end")).collect()}
    known = {s: ends[p] for s, p in before.items()}

    def verdicts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, ok, _ in walk(batches, known):
            part = batch.slice(a, b - a)
            yield pa.record_batch([*[part.column(c) for c in names], pa.array(ok)], names=[*names, "accepted"])

    # a pair without a position is rejected and moves no state
    judged = dealt.mapInArrow(verdicts, T.StructType([*[T.StructField(c, kinds[c]) for c in names], T.StructField("accepted", T.BooleanType())]))
    return judged.unionByName(every.where(~F.col("_placed")).drop("_placed").withColumn("accepted", F.lit(False)))


def brightness_ratio_gate(pairs: DataFrame, min_ratio: float | Column, dark: float = 1e-6) -> DataFrame:
    """Accept frames whose bright/dim ratio is large enough; adds ``ratio``."""
    ratio = F.when(F.col("dim") >= dark, F.col("bright") / F.col("dim"))
    return with_gate(pairs.withColumn("ratio", ratio), F.col("ratio") >= min_ratio)


def brightness_report(gated: DataFrame, by: Sequence[str]) -> DataFrame:
    return gated.groupBy(*by).agg(
        F.count("ratio").alias("n"),
        F.avg("ratio").alias("mean"),
        F.stddev_samp("ratio").alias("std"),
        F.min("ratio").alias("least"),
        F.count(F.when(~F.col("accepted"), 1)).alias("rejected"),
    )


def mad_outliers(
    df: DataFrame, value: str, by: Sequence[str] = (), k: float = 3.0, floor: float = 0.0
) -> DataFrame:
    """Accept values within max(k * 1.4826 * MAD, floor) of the median."""
    centre = exact_quantiles(df, by, value, {"_median": 0.5})
    rows = attach(df, centre, by).withColumn("_dev", F.abs(F.col(value) - F.col("_median")))
    spread = exact_quantiles(rows, by, "_dev", {"_mad": 0.5})
    limit = F.greatest(k * 1.4826 * F.col("_mad"), F.lit(float(floor)))
    gated = with_gate(attach(rows, spread, by), F.col("_dev") <= limit)
    return gated.withColumnRenamed("_median", "median").withColumnRenamed("_mad", "mad").drop("_dev")


def reprojection_gate(errors: DataFrame, by: Sequence[str], error: str, max_px: float) -> DataFrame:
    """Groups whose largest reprojection error is acceptable."""
    worst = errors.groupBy(*by).agg(
        F.max(error).alias("worst"), F.count(error).alias("cameras")
    )
    return worst.filter(F.col("worst") <= max_px)


def min_cameras(obs: DataFrame, by: Sequence[str], camera: str = "camera", n: int = 2) -> DataFrame:
    """Rows of points seen by at least n cameras."""
    seen = obs.groupBy(*by).agg(F.countDistinct(camera).alias("_c")).filter(F.col("_c") >= n)
    return obs.join(seen.select(*by), list(by), "left_semi")


def plausible_power(power: str | Column) -> Column:
    """Negative power is missing."""
    p = F.col(power) if isinstance(power, str) else power
    return F.when(p >= 0, p)


def min_samples(bins: DataFrame, n: int, count: str = "n") -> DataFrame:
    return bins.filter(F.col(count) >= n)


def cv_flag(df: DataFrame, value: str, by: Sequence[str] = (), limit: float = 0.15) -> DataFrame:
    """Coefficient of variation and whether it suggests contamination."""
    stats = df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    cv = F.when(F.col("mean") != 0, F.col("std") / F.col("mean"))
    return stats.withColumn("cv", cv).withColumn(
        "contaminated", F.coalesce(F.col("cv") > limit, F.lit(False))
    )


def percentile_trim(
    df: DataFrame, columns: Sequence[str], lo: float = 1, hi: float = 99, by: Sequence[str] = ()
) -> DataFrame:
    """Rows inside the box spanned by two exact percentiles of every column."""
    cuts = quantiles_of(df, by, {c: {f"_lo_{c}": lo / 100, f"_hi_{c}": hi / 100} for c in columns})
    out = attach(df, cuts, by)
    for c in columns:
        out = out.filter(F.col(c).between(F.col(f"_lo_{c}"), F.col(f"_hi_{c}")))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in ("lo", "hi")])

"""Structured Streaming twins of two batch operators (ST1, ST2)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.binning import Axis, with_bins
from ..operators.quality import JUMP_STATE, fold_jumps


def stream_bin_moments(
    samples: DataFrame, axes: Sequence[Axis], values: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Running count, mean and variance per bin of arriving track chunks.

    Spark's variance keeps count, mean and summed squared deviations, so nothing cancels.

    The state holds one row per occupied bin.  Use ``complete`` or ``update`` mode;
    ``bin_moments_to_stats`` turns a result into means and variances.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for v in values:
        aggs += [F.avg(v).alias(f"s_{v}"), F.var_pop(v).alias(f"q_{v}")]
    return with_bins(samples, axes).groupBy(*by, *[a.name for a in axes]).agg(*aggs)


def bin_moments_to_stats(moments: DataFrame, values: Sequence[str]) -> DataFrame:
    """Means under the values' names and variances under doubled names."""
    out = {}
    for v in values:
        out |= {v: F.col(f"s_{v}"), f"{v}{v}": F.col(f"q_{v}")}
    return moments.withColumns(out).drop(*[f"{k}_{v}" for v in values for k in "sq"])


#: Frames of a camera that wait under one key of its state.
WAIT_BLOCK = 4096
#: Rows of a camera that are put in order together; more of them in one micro-batch go to its state first.
TOGETHER = 1 << 21
#: Rows that are handed on together, at least.
GIVEN = 1 << 16
POSITIONS = JUMP_STATE[1:]


class JumpGate(StatefulProcessor):
    """State of one camera: its last accepted row, its clock, and rows that wait for their turn.

    Rows wait in blocks of ``WAIT_BLOCK`` frames.  Those of a micro-batch are gathered up
    to a bound, put in order once and folded block by block with what waited; a block of
    the state is read and written once for each such gathering, not for each Arrow batch.
    The clock is the largest frame seen less ``slack``.
    """

    def __init__(self, by: Sequence[str], max_jump: float, max_gap: int, slack: int, patience_ms: int | None):
        self.by, self.max_jump, self.max_gap, self.slack, self.patience_ms = list(by), max_jump, max_gap, slack, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", ", ".join(f"{c} double" for c in JUMP_STATE))
        self.clock = handle.getValueState("clock", "seen double, folded double")
        self.waiting = handle.getMapState("waiting", "block long", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, folded = self.clock.get() if self.clock.exists() else (-np.inf, -np.inf)
        fresh, many = [], 0
        for chunk in rows:
            seen = max(seen, float(chunk["frame"].max()))
            chunk = chunk.dropna(subset=list(POSITIONS))  # a row without a position only moves the clock
            values = chunk[list(JUMP_STATE)].to_numpy(float)
            if len(values) and values[:, 0].min() <= folded:
                raise ValueError("frames come late or twice; allow more slack")
            fresh.append(values)
            many += len(values)
            if many > TOGETHER:
                self.wait(in_blocks(fresh))
                fresh, many = [], 0
        yield from self.release(key, seen - self.slack, seen, folded, in_blocks(fresh))
        if self.patience_ms is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A camera that has been silent for long: nothing is waited for any more."""
        seen, folded = self.clock.get()
        yield from self.release(key, seen, seen, folded, {})

    def wait(self, blocks: dict[int, np.ndarray]) -> None:
        for block, values in blocks.items():
            self.put(block, np.concatenate([self.held(block), values]))

    def held(self, block: int) -> np.ndarray:
        if not self.waiting.containsKey((block,)):
            return np.zeros((0, len(JUMP_STATE)))
        return np.frombuffer(bytes(self.waiting.getValue((block,))[0])).reshape(-1, len(JUMP_STATE))

    def put(self, block: int, values: np.ndarray) -> None:
        self.waiting.updateValue((block,), (values.tobytes(),))

    def release(self, key, upto: float, seen: float, folded: float, fresh: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
        """Fold the waiting and the fresh rows with frames up to ``upto``, block by block; the others wait."""
        state = np.array(self.last.get(), float) if self.last.exists() else None
        known = {int(k[0]) for k in self.waiting.keys()}
        frames, verdicts = [], []
        for block in sorted(known | fresh.keys()):
            values = fresh.get(block)
            if block * WAIT_BLOCK > upto:
                if values is not None:
                    self.wait({block: values})
                continue
            if block in known:
                values = self.held(block) if values is None else np.concatenate([self.held(block), values])
                values = values[np.argsort(values[:, 0], kind="stable")]
                self.waiting.removeKey((block,))
            ready = values[:, 0] <= upto
            if not ready.all():
                self.put(block, values[~ready])
            values = values[ready]
            accepted, state = fold_jumps(values, state, self.max_jump, self.max_gap)
            frames.append(values[:, 0])
            verdicts.append(accepted)
            if sum(map(len, frames)) >= GIVEN:
                yield self.rated(key, frames, verdicts)
                frames, verdicts = [], []
        if frames:
            yield self.rated(key, frames, verdicts)
        if state is not None:
            self.last.update(tuple(float(v) for v in state))
        self.clock.update((seen, max(folded, upto)))

    def rated(self, key, frames: list[np.ndarray], verdicts: list[np.ndarray]) -> pd.DataFrame:
        frame = np.concatenate(frames)
        out = {c: [v] * len(frame) for c, v in zip(self.by, key)}
        return pd.DataFrame({**out, "frame": frame, "accepted": np.concatenate(verdicts)})

    def close(self) -> None:
        pass


def in_blocks(chunks: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Rows by block of ``WAIT_BLOCK`` frames, in order."""
    values = np.concatenate(chunks) if chunks else np.zeros((0, len(JUMP_STATE)))
    if not len(values):
        return {}
    values = values[np.argsort(values[:, 0], kind="stable")]
    blocks = np.floor_divide(values[:, 0], WAIT_BLOCK).astype(np.int64)
    at = np.flatnonzero(np.diff(blocks)) + 1
    return {int(blocks[a]): values[a:b] for a, b in zip([0, *at.tolist()], [*at.tolist(), len(values)], strict=True)}


def stream_jump_gate(
    pairs: DataFrame, by: Sequence[str], max_jump: float, max_gap: int = 5, slack: int = 0, patience_ms: int | None = None
) -> DataFrame:
    """Jump gate over a stream: (by, frame, accepted), each row once, in append mode.

    Frames of a camera may arrive up to ``slack`` frames out of order, within a
    micro-batch and across micro-batches; they wait in the camera's state until the
    camera has been seen ``slack`` frames later.  A frame that comes later than that,
    or twice, raises.  A row without a position isn't rated: it only tells how far
    the camera is, so one at the end with a frame ``slack`` later releases what still
    waits.  With ``patience_ms`` a camera that is silent for that long is released too.
    """
    by = list(by)
    fields = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    output = "".join(f"`{c}` {fields[c]}, " for c in by) + "frame double, accepted boolean"
    rows = pairs.dropna(subset=["frame"]).select(*by, *JUMP_STATE)
    mode = "None" if patience_ms is None else "processingTime"
    rated = rows.groupBy(*by).transformWithStateInPandas(JumpGate(by, max_jump, max_gap, slack, patience_ms), output, "append", mode)
    return rated.withColumn("frame", F.col("frame").cast(fields["frame"]))

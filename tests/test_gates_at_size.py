"""Jump gates: how often state and rows are looked at, and verdicts beside a row-by-row pass."""

from __future__ import annotations

import numpy as np
import pandas as pd

from wakegrid.operators import quality as Q
from wakegrid.streaming import incremental as I


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Blocks(dict):
    writes = 0

    def containsKey(self, k):  # noqa: N802
        return k in self

    def getValue(self, k):  # noqa: N802
        return self[k]

    def updateValue(self, k, v):  # noqa: N802
        self.writes += 1
        self[k] = v

    def removeKey(self, k):  # noqa: N802
        del self[k]


class Handle:
    def __init__(self):
        self.blocks = Blocks()

    def getValueState(self, *_):  # noqa: N802
        return Value()

    def getMapState(self, *_):  # noqa: N802
        return self.blocks


def drift(n: int, seed: int = 2) -> np.ndarray:
    rng = np.random.default_rng(seed)
    rows = np.column_stack([np.cumsum(rng.integers(1, 4, n)), np.cumsum(rng.normal(size=(n, 4)), axis=0)])
    rows[rng.random(n) < 0.3, 1:] += 60.0
    return rows


def test_stream_state_is_not_written_for_every_arrow_batch():
    rows = drift(6000)
    handle, gate = Handle(), I.JumpGate(["camera"], 3.0, 5, 100, None)
    gate.init(handle)
    mixed = np.random.default_rng(0).permutation(rows)
    chunks = [pd.DataFrame(part, columns=list(Q.JUMP_STATE)) for part in np.array_split(mixed, 200)]
    end = pd.DataFrame([[rows[-1, 0] + 100, *[np.nan] * 4]], columns=list(Q.JUMP_STATE))
    got = pd.concat([*gate.handleInputRows((1,), iter(chunks), None), *gate.handleInputRows((1,), iter([end]), None)])
    assert handle.blocks.writes <= len(np.unique(rows[:, 0] // I.WAIT_BLOCK))
    assert got["frame"].tolist() == rows[:, 0].tolist()
    assert got["accepted"].tolist() == Q.fold_jumps(rows, None, 3.0, 5)[0].tolist()


def test_rows_beyond_the_bound_wait_in_the_state(monkeypatch):
    monkeypatch.setattr(I, "TOGETHER", 500)
    monkeypatch.setattr(I, "WAIT_BLOCK", 64)
    rows = drift(3000)
    gate = I.JumpGate(["camera"], 3.0, 5, 0, None)
    gate.init(Handle())
    chunks = [pd.DataFrame(p, columns=list(Q.JUMP_STATE)) for p in np.array_split(np.random.default_rng(0).permutation(rows), 30)]
    got = pd.concat(list(gate.handleInputRows((1,), iter(chunks), None)))
    assert got["accepted"].tolist() == Q.fold_jumps(rows, None, 3.0, 5)[0].tolist() and len(got) == len(rows)


def test_many_violations_take_no_comparison_of_stretches_each(monkeypatch):
    calls, plain = [], Q.within_jump
    monkeypatch.setattr(Q, "within_jump", lambda *a: calls.append(1) or plain(*a))
    n = 5000
    rows = np.column_stack([np.arange(n), *[np.where(np.arange(n) % 2, 90.0, 0.0)] * 4]).astype(float)
    ok, _ = Q.fold_jumps(rows, None, 3.0, 5)
    assert ok.tolist() == (np.arange(n) % 2 == 0).tolist() and len(calls) < 10


def test_a_state_that_rejects_range_after_range(spark):
    """The fold of a range depends on one far earlier, in two cameras and in none."""
    n = 400
    frames = np.arange(n) * 2
    jump = np.where(np.arange(n) > 30, 500.0 + np.arange(n) * 0.1, 0.0)
    one = pd.DataFrame({"camera": 1, "frame": frames, "x0": jump, "y0": 0.0, "x1": jump, "y1": 0.0, "note": "a"})
    two = pd.DataFrame({"camera": 2, "frame": frames, **dict(zip(("x0", "y0", "x1", "y1"), drift(n)[:, 1:].T)), "note": "b"})
    two.loc[5, "x0"] = None
    both = pd.concat([one, two])
    for by in (["camera"], []):
        table = both if by else one
        got = Q.jump_gate(spark.createDataFrame(table), by, 3.0, size=16).toPandas()
        assert len(got) == len(table) and set(got.columns) == {*table.columns, "accepted"}
        for _, part in table.groupby("camera"):
            kept = part.dropna()
            want = dict(zip(kept["frame"], Q.fold_jumps(kept[list(Q.JUMP_STATE)].to_numpy(float), None, 3.0, 5)[0]))
            mine = got[got["camera"] == part["camera"].iloc[0]]
            assert {f: a for f, a in zip(mine["frame"], mine["accepted"])} == {f: bool(want.get(f, False)) for f in part["frame"]}

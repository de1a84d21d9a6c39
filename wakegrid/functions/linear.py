"""Closed-form 3x3 algebra as column expressions and batched numpy helpers."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def solve3(a: Mapping[str, Column], b: tuple[Column, Column, Column], tol: float = 1e-12):
    """Solve a symmetric 3x3 system by Cramer's rule; NULL when nearly singular.

    ``a`` holds xx, xy, xz, yy, yz, zz.
    """
    xx, xy, xz, yy, yz, zz = (a[k] for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
    c_xx, c_xy, c_xz = yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy
    c_yy, c_yz, c_zz = xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy
    det = xx * c_xx + xy * c_xy + xz * c_xz
    scale = F.pow((xx + yy + zz) / 3, 3)
    ok = F.abs(det) > tol * scale
    bx, by, bz = b
    return (
        F.when(ok, (c_xx * bx + c_xy * by + c_xz * bz) / det),
        F.when(ok, (c_xy * bx + c_yy * by + c_yz * bz) / det),
        F.when(ok, (c_xz * bx + c_yz * by + c_zz * bz) / det),
    )


def symmetric3(rows: np.ndarray) -> np.ndarray:
    """(n, 6) with xx, xy, xz, yy, yz, zz to (n, 3, 3)."""
    out = np.empty((len(rows), 3, 3))
    for k, (i, j) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
        out[:, i, j] = out[:, j, i] = rows[:, k]
    return out

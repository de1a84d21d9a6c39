"""Finite-time Lyapunov exponents, node fields and ridges (E operators).

Node fields are sparse tables (by, i, j, k, value) with 0-based node numbers.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import attach, exact_quantiles
from ..functions.linear import symmetric3
from ..session import cut
from .binning import Axis
from .joins import flow_map
from .neighbours import knn, radius_neighbours

XYZ = ("x", "y", "z")
NODE = ("i", "j", "k")


def key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{k}` {types[k]}, " for k in keys)


def deformation_gradient(
    flow: DataFrame, by: Sequence[str], seed: str, k: int | None = 12, radius: float | None = None,
    cond_tol: float = 1e-3,
) -> DataFrame:
    """Least-squares flow-map gradient of every seed: largest stretch ``smax`` and whether it is ``valid``.

    ``flow`` has start x, y, z and end x1, y1, z1.  Fifteen sums over the
    neighbours describe the fit; the 3x3 algebra runs on whole batches.  Seeds
    with fewer than four neighbours, or flat neighbourhoods, are not valid.
    """
    by = list(by)
    ends = [f"{c}1" for c in XYZ]
    if radius is not None:
        pairs = radius_neighbours(
            flow.select(*by, seed, *XYZ), flow.select(*by, F.col(seed), *XYZ, *ends), by, XYZ, radius,
            seed, seed, ends, include_self=False,
        )
    else:
        pairs = knn(flow, by, seed, XYZ, k, ends)
    own = flow.select(*by, seed, *[F.col(e).alias(f"_own_{e}") for e in ends])
    pairs = pairs.join(own, [*by, seed])
    start = [F.col(f"n_{c}") - F.col(c) for c in XYZ]
    end = [F.col(f"n_{e}") - F.col(f"_own_{e}") for e in ends]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, j in itertools.combinations_with_replacement(range(3), 2):
        aggs.append(F.sum(start[i] * start[j]).alias(f"_a{i}{j}"))
    for i in range(3):
        for j in range(3):
            aggs.append(F.sum(end[i] * start[j]).alias(f"_b{i}{j}"))
    sums = pairs.groupBy(*by, seed).agg(*aggs)
    seeds = flow.select(*by, seed, *XYZ).join(sums, [*by, seed], "left")
    a_cols = [f"_a{i}{j}" for i, j in itertools.combinations_with_replacement(range(3), 2)]
    b_cols = [f"_b{i}{j}" for i in range(3) for j in range(3)]
    keys = [*by, seed, *XYZ]

    def stretch(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            a = symmetric3(pdf[a_cols].to_numpy(float))
            b = pdf[b_cols].to_numpy(float).reshape(-1, 3, 3)
            n = pdf["_n"].fillna(0).to_numpy()
            usable = (n >= 4) & np.isfinite(a).all((1, 2))
            eig = np.zeros((len(pdf), 3))
            eig[usable] = np.linalg.eigvalsh(a[usable])
            good = usable & (eig[:, 0] > (cond_tol**2) * eig[:, 2]) & (eig[:, 0] > 0)
            smax = np.full(len(pdf), np.nan)
            if good.any():
                f = np.linalg.solve(a[good], np.swapaxes(b[good], 1, 2))
                smax[good] = np.linalg.svd(f, compute_uv=False)[:, 0]
            out = pdf[keys].copy()
            out["smax"], out["valid"] = smax, good & (smax > 0)
            yield out

    raw = seeds.mapInPandas(stretch, key_schema(flow, keys) + "smax double, valid boolean")
    return raw.withColumn("smax", F.when(F.col("valid"), F.col("smax")))


def ftle(
    flow: DataFrame, by: Sequence[str], seed: str, window: float, k: int | None = 12,
    radius: float | None = None, cond_tol: float = 1e-3,
) -> DataFrame:
    """Exponent ln(smax)/|T| per seed; NULL where the gradient was rejected."""
    if window == 0:
        raise ValueError("zero-length window")
    g = deformation_gradient(flow, by, seed, k, radius, cond_tol)
    return g.withColumn("sigma", F.log("smax") / abs(float(window)))


def ftle_counts(field: DataFrame, by: Sequence[str], value: str | None = None) -> DataFrame:
    """Seeds, accepted and rejected seeds per window, and the mean of ``value`` if named."""
    kept = F.count(F.when(F.col("valid"), 1))
    total = F.count(F.lit(1))
    mean = [F.avg(value).alias(value)] if value else []
    return field.groupBy(*by).agg(total.alias("seeds"), kept.alias("kept"), (total - kept).alias("rejected"), *mean)


def ftle_windows(
    tracks: DataFrame, by: Sequence[str], track: str, index: str, starts: Sequence[int], m: int, dt: float,
    k: int | None = 12, radius: float | None = None, cond_tol: float = 1e-3, require_span: bool = False,
) -> DataFrame:
    """Exponents for many start frames in one job; the sign of m picks forward or backward."""
    flow = flow_map(tracks, by, track, index, starts, m, XYZ, require_span)
    return ftle(flow, [*by, "i0"], track, m * dt, k, radius, cond_tol)


# ------------------------------------------------------------------ node fields


def node_position(axes: Sequence[Axis]) -> list[Column]:
    """Coordinates of nodes i, j, k: each axis has n nodes from lo to hi."""
    return [a.lo + F.col(n) * ((a.hi - a.lo) / (a.n - 1)) for a, n in zip(axes, NODE)]


def scatter_to_grid(
    points: DataFrame, by: Sequence[str], value: str, axes: Sequence[Axis], h: float
) -> DataFrame:
    """Scattered values on the nodes of a grid: inverse-distance weights of the points within h.

    A node counts as covered when at least four points lie around it in at least
    four of its eight octants; other nodes have no row.  (The mesh interpolation
    of a single machine is replaced by this local rule.)
    """
    by = list(by)
    steps = [(a.hi - a.lo) / (a.n - 1) for a in axes]
    spread = points.dropna(subset=[value])
    # Every point lists the nodes within h along each axis: no join is needed.
    for a, n, s in zip(axes, NODE, steps):
        first = F.greatest(F.ceil((F.col(a.column) - h - a.lo) / s), F.lit(0))
        last = F.least(F.floor((F.col(a.column) + h - a.lo) / s), F.lit(a.n - 1).cast("bigint"))
        spread = spread.filter(first <= last).withColumn(n, F.explode(F.sequence(first, last)))
    delta = [F.col(a.column) - p for a, p in zip(axes, node_position(axes))]
    d2 = sum((d * d for d in delta), F.lit(0.0))
    near = spread.withColumn("_d2", d2).filter(F.col("_d2") <= h * h)
    octant = sum((F.when(d >= 0, 2**i).otherwise(0) for i, d in enumerate(delta)), F.lit(0))
    weight = 1.0 / (F.col("_d2") + 1e-12 * h * h)
    covered = near.groupBy(*by, *NODE).agg(
        F.count(F.lit(1)).alias("seeds"),
        F.bit_count(F.bit_or(F.pow(F.lit(2.0), octant).cast("int"))).alias("_octants"),
        (F.sum(weight * F.col(value)) / F.sum(weight)).alias(value),
    )
    return covered.filter((F.col("seeds") >= 4) & (F.col("_octants") >= 4)).drop("_octants")


def ensemble_mean(fields: DataFrame, by: Sequence[str], value: str, min_count: int = 1) -> DataFrame:
    """Mean over windows per node; nodes seen in fewer than min_count windows are dropped."""
    return (
        fields.groupBy(*by, *NODE)
        .agg(F.avg(value).alias(value), F.count(value).alias("windows"))
        .filter(F.col("windows") >= min_count)
    )


FACES = tuple((a, s) for a in range(3) for s in (-1, 1))


def _shifted(axis: int, step: int) -> list[Column]:
    return [(F.col(n) + (step if i == axis else 0)).alias(n) for i, n in enumerate(NODE)]


def _inside(shape: Sequence[int]) -> Column:
    ok = F.lit(True)
    for n, size in zip(NODE, shape):
        ok = ok & F.col(n).between(0, size - 1)
    return ok


def _to_faces(field: DataFrame, by: Sequence[str], carry: Sequence[Column]) -> DataFrame:
    """Each node's values sent to itself and its six face neighbours."""
    targets = F.array(
        F.struct(F.lit(0).alias("face"), *[F.col(n).alias(n) for n in NODE]),
        *[F.struct(F.lit(1).alias("face"), *_shifted(a, s)) for a, s in FACES],
    )
    return field.select(*by, *carry, F.explode(targets).alias("_t")).select(
        *by, "_t.*", *[F.col(f"`{name}`") for name in field.select(*carry).columns]
    )


def erode6(field: DataFrame, by: Sequence[str]) -> DataFrame:
    """Nodes present together with all six face neighbours (border nodes never are)."""
    votes = _to_faces(field, by, [F.lit(1).alias("one")])
    return votes.groupBy(*by, *NODE).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 7).drop("_n")


def fill_gaps6(
    field: DataFrame, by: Sequence[str], value: str, shape: Sequence[int], passes: int = 8
) -> DataFrame:
    """Fill missing nodes by repeated means of present face neighbours; leftovers get the global mean.

    Each pass is one aggregate over nodes sent to their neighbours.  Lineage is
    cut through a reliable checkpoint after every pass.
    """
    by = list(by)
    known = cut(field.select(*by, *NODE, F.col(value).cast("double").alias(value)))
    total = math.prod(shape)
    mean = known.groupBy(*by).agg(F.avg(value).alias("_mean"))
    groups = known.select(*by).distinct().count() if by else 1
    for _ in range(passes):
        if known.count() >= total * groups:
            break
        sent = _to_faces(known, by, [F.col(value).alias("_v")]).filter(_inside(shape))
        known = cut(
            sent.groupBy(*by, *NODE).agg(
                F.coalesce(F.max(F.when(F.col("face") == 0, F.col("_v"))), F.avg("_v")).alias(value)
            )
        )
    return fill_nodes(known, by, shape, value, mean)


def all_nodes(field: DataFrame, by: Sequence[str], shape: Sequence[int]) -> DataFrame:
    """Every node of the grid, for every group."""
    if by:
        nodes = field.select(*by).distinct()
    else:
        nodes = field.sparkSession.range(1).drop("id")
    for n, size in zip(NODE, shape):
        nodes = nodes.withColumn(n, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))))
    return nodes


def fill_nodes(field: DataFrame, by: Sequence[str], shape: Sequence[int], value: str, mean: DataFrame) -> DataFrame:
    dense = all_nodes(field, by, shape).join(field, [*by, *NODE], "left")
    return attach(dense, mean, by).withColumn(value, F.coalesce(value, "_mean")).drop("_mean")


def gaussian_kernel(sigma: float, half: int) -> list[float]:
    w = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-half, half + 1)]
    return [v / sum(w) for v in w]


def smooth_axis(
    field: DataFrame, by: Sequence[str], nodes: Sequence[str], axis: str, size: int, value: str, kernel: Sequence[float]
) -> DataFrame:
    """Weighted sum along one axis of a dense field; the border value is repeated outside.

    A node sends its value, weighted, to the nodes within reach.  A border node
    also stands in for all missing nodes beyond it, so its weights are summed.
    """
    half = len(kernel) // 2
    i = F.col(axis)
    weights = F.array(*[F.lit(float(w)) for w in kernel])

    def total(first: Column, last: Column) -> Column:
        """Sum of kernel weights for offsets first..last (clamped)."""
        lo, hi = F.greatest(first, F.lit(-half)), F.least(last, F.lit(half))
        part = F.when(hi >= lo, F.slice(weights, (lo + half + 1).cast("int"), (hi - lo + 1).cast("int")))
        return F.coalesce(F.aggregate(part, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))

    targets = F.sequence(F.greatest(i - half, F.lit(0)), F.least(i + half, F.lit(size - 1).cast("bigint")))
    sent = field.withColumn("_to", F.explode(targets))
    offset = i - F.col("_to")
    weight = (
        F.when(F.lit(size) == 1, F.lit(1.0))
        .when(i == 0, total(F.lit(-half).cast("bigint"), offset))
        .when(i == size - 1, total(offset, F.lit(half).cast("bigint")))
        .otherwise(F.element_at(weights, (offset + half + 1).cast("int")))
    )
    others = [n for n in nodes if n != axis]
    return sent.groupBy(*by, *others, F.col("_to").alias(axis)).agg(F.sum(weight * F.col(value)).alias(value))


def gaussian_smooth(
    field: DataFrame, by: Sequence[str], value: str, shape: Sequence[int], sigma: float, half: int | None = None,
    nodes: Sequence[str] = NODE,
) -> DataFrame:
    """Separable Gaussian smoothing of a dense field."""
    kernel = gaussian_kernel(sigma, math.ceil(2 * sigma) if half is None else half)
    out = field.select(*by, *nodes, value)
    for axis, size in zip(nodes, shape):
        out = smooth_axis(out, by, nodes, axis, size, value, kernel)
    return out


def _axis_gradient(field: DataFrame, by: Sequence[str], columns: Sequence[str], axis: int, size: int, step: float, tag: str) -> DataFrame:
    """Central difference along one axis of a dense field, one-sided at the ends.

    A node contributes to its neighbours only (and to itself at an end), so the
    difference is one aggregate and no line of nodes is brought together.
    """
    n = NODE[axis]
    i = F.col(n)
    if size < 2:
        return field.withColumns({f"{tag}{c}": F.lit(0.0) for c in columns})

    def weight_at(target: Column) -> Column:
        span = F.when((target == 0) | (target == size - 1), step).otherwise(2 * step)
        ahead = F.when(target == size - 1, target).otherwise(target + 1)
        behind = F.when(target == 0, target).otherwise(target - 1)
        return (F.when(i == ahead, 1.0).otherwise(0.0) - F.when(i == behind, 1.0).otherwise(0.0)) / span

    targets = F.sequence(F.greatest(i - 1, F.lit(0)), F.least(i + 1, F.lit(size - 1).cast("bigint")))
    others = [c for c in NODE if c != n]
    carried = [c for c in field.columns if c not in {*by, *NODE}]
    sent = field.withColumn("_to", F.explode(targets))
    here = i == F.col("_to")
    w = weight_at(F.col("_to"))
    return sent.groupBy(*by, *others, F.col("_to").alias(n)).agg(
        *[F.max(F.when(here, F.col(c))).alias(c) for c in carried],
        *[F.sum(w * F.col(c)).alias(f"{tag}{c}") for c in columns],
    )


def grid_gradient_hessian(
    field: DataFrame, by: Sequence[str], value: str, axes: Sequence[Axis]
) -> DataFrame:
    """Gradient gx, gy, gz and Hessian hxx, hxy, hxz, hyy, hyz, hzz of a dense node field."""
    out = field.select(*by, *NODE, value)
    steps = [(a.hi - a.lo) / (a.n - 1) if a.n > 1 else 1.0 for a in axes]
    for d in range(3):
        out = _axis_gradient(out, by, [value], d, axes[d].n, steps[d], f"g{XYZ[d]}_")
    out = out.withColumnsRenamed({f"g{c}_{value}": f"g{c}" for c in XYZ})
    for d in range(3):
        firsts = [f"g{c}" for c in XYZ[: d + 1]]
        out = _axis_gradient(out, by, firsts, d, axes[d].n, steps[d], f"h{XYZ[d]}_")
    return out.withColumnsRenamed({f"h{XYZ[d]}_g{c}": f"h{c}{XYZ[d]}" for d in range(3) for c in XYZ[: d + 1]})


def ridge_points(
    derivs: DataFrame, interior: DataFrame, by: Sequence[str], value: str,
    floor_pct: float = 90.0, concave_pct: float = 50.0, align_tol: float = 0.2,
) -> DataFrame:
    """Nodes on ridges: high value, strongly concave across, gradient along the ridge.

    ``interior`` lists the covered nodes.  Both thresholds are exact percentiles.
    """
    by = list(by)
    valid = derivs.join(interior.select(*by, *NODE), [*by, *NODE], "left_semi")
    floor = exact_quantiles(valid, by, value, {"_floor": floor_pct / 100})
    cand = attach(valid, floor, by).filter(F.col(value) > F.col("_floor")).drop("_floor")
    h_cols = ["hxx", "hxy", "hxz", "hyy", "hyz", "hzz"]
    keys = [*by, *NODE, value]

    def smallest_pair(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            eig, vec = np.linalg.eigh(symmetric3(pdf[h_cols].to_numpy(float)))
            g = pdf[["gx", "gy", "gz"]].to_numpy(float)
            size = np.sqrt((g * g).sum(1)) + np.finfo(float).eps
            out = pdf[keys].copy()
            out["lam"] = eig[:, 0]
            out["align"] = np.abs((g * vec[:, :, 0]).sum(1)) / size
            yield out

    pairs = cand.mapInPandas(smallest_pair, key_schema(derivs, keys) + "lam double, align double")
    pairs = pairs.withColumn("_concave", F.when(F.col("lam") < 0, -F.col("lam")))
    cutoff = exact_quantiles(pairs, by, "_concave", {"_cut": concave_pct / 100})
    ridge = (F.col("_concave") > F.col("_cut")) & (F.col("align") < align_tol)
    return attach(pairs, cutoff, by).filter(ridge).drop("_concave", "_cut")


def level_percentiles(field: DataFrame, by: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """Exact percentiles of a field, one column p<level> each."""
    return exact_quantiles(field, by, value, {f"p{level:g}": level / 100 for level in levels})

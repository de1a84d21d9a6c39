"""Centroid clustering in whole numbers, with a rotated lower bound that skips most distances.

Vectors of ``dims`` finite components become whole numbers floor(scale * x).  The
first centroids are the vectors with the smallest SHA-256 of ``seed``:vec_id; a round
assigns every vector to its nearest centroid and moves centroids to the floor of the
mean of their vectors.

* **Rotation.**  The principal axes come from the sums of products over all vectors
  (dims * (dims + 1) / 2 numbers).  A vector is stored with its first ``leading``
  rotated coordinates and the norm of what they leave out.
* **Filter.**  The squared distance of two vectors is at least that of their leading
  coordinates plus the squared difference of the norms left out.  A vector is measured
  exactly against the centroid with the least bound, and after that only against
  centroids whose bound, less a margin for rounding, does not exceed that distance.
* **Check.**  Survivors are measured in 64-bit whole numbers, so which axes were
  chosen, and in which order sums were taken, does not change a result.

The driver holds the rotation, at most ``k`` centroids and, for a round, their sums:
k * dims numbers whatever the number of vectors.  Sums are made in the tasks first.

Vectors of another length, null, or with a null or non-finite component drop out, as
rows without a vec_id do; other columns are not read.  Rows that repeat a vec_id are
vectors each; equal hashes are ordered by the components.  Ties of distance go to the
smaller centroid.  Fewer than ``k`` vectors: as many centroids.  An empty table gives
an empty result.  Components that reach 2**27 / scale raise, as squared distances
would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept

STORED = "vec_id long, cells binary, leads binary, rest double"
#: Vectors that are measured together.
TOGETHER = 4096


def whole_numbers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of usable vectors and their components as whole numbers."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float)
    rows = np.flatnonzero(lengths == dims)
    first = (np.cumsum(lengths) - lengths)[rows]
    found = values[first[:, None] + np.arange(dims)]
    finite = np.isfinite(found).all(axis=1)
    cells = np.floor(scale * found[finite])
    if np.abs(cells).max(initial=0) >= 1 << 27:
        raise ValueError(f"components from {(1 << 27) / scale} have no squared distance of 64 bits")
    return rows[finite], cells.astype(np.int32)


def products(dims: int, scale: int):
    """Sums over a task's vectors: their number, components and products of components, as (cell, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            _, cells = whole_numbers(batch.column(1), dims, scale)
            one = np.column_stack([np.ones(len(cells)), cells])
            total += one.T @ one
        cell = np.flatnonzero(np.triu(np.ones_like(total)).ravel())
        yield pa.record_batch([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "value"])

    return run


class Rotation:
    """The first principal axes and the mean."""

    def __init__(self, sums: np.ndarray, leading: int):
        n = max(sums[0, 0], 1.0)
        self.mean = sums[0, 1:] / n
        spread = sums[1:, 1:] / n - np.outer(self.mean, self.mean)
        self.axes = np.linalg.eigh(spread)[1][:, ::-1][:, :leading].copy()

    def of(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading rotated coordinates and the norm of the rest."""
        centred = cells - self.mean
        leads = centred @ self.axes
        rest = centred - leads @ self.axes.T
        return leads, np.sqrt((rest * rest).sum(axis=1))


def rotation(vectors: DataFrame, dims: int, scale: int, leading: int) -> Rotation:
    sent = vectors.mapInArrow(products(dims, scale), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    sums = np.zeros((dims + 1) ** 2)
    for r in sent.collect():
        sums[r["cell"]] = r["value"]
    upper = np.triu(sums.reshape(dims + 1, dims + 1))
    return Rotation(upper + np.triu(upper, 1).T, leading)


def store(held: Broadcast, dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = whole_numbers(batch.column(1), dims, scale)
            leads, rest = held.value.of(cells)
            columns = [batch.column(0).take(pa.array(rows)), pa.array([x.tobytes() for x in cells], pa.binary()), pa.array([x.tobytes() for x in leads], pa.binary()), pa.array(rest, pa.float64())]
            yield pa.record_batch(columns, names=["vec_id", "cells", "leads", "rest"])

    return run


def matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def nearest(cells: np.ndarray, leads: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turned: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid, its squared distance, and how many distances were measured."""
    heads, tails = turned.of(centroids)
    bound = ((leads[:, None, :] - heads[None, :, :]) ** 2).sum(axis=2) + (rest[:, None] - tails[None, :]) ** 2
    # far more than rounding can change in the sums of squares of either vector
    size = (leads**2).sum(axis=1) + rest**2 + 1.0
    most = (heads**2).sum(axis=1).max() + (tails**2).max()
    margin = 1e-9 * (size + most + (turned.mean**2).sum())

    def measured(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return ((cells[i].astype(np.int64) - centroids[j]) ** 2).sum(axis=1)

    every = np.arange(len(cells))
    first = bound.argmin(axis=1)
    known = measured(every, first)
    open_ = bound - margin[:, None] <= known[:, None]
    open_[every, first] = False
    i, j = np.nonzero(open_)
    more = measured(i, j)
    cluster, distance = first.astype(np.int64), known.copy()
    # of each vector the least distance, ties to the smaller number
    order = np.lexsort((j, more, i))
    i, j, more = i[order], j[order], more[order]
    lead = np.ones(len(i), bool)
    lead[1:] = i[1:] != i[:-1]
    i, j, more = i[lead], j[lead], more[lead]
    better = (more < distance[i]) | ((more == distance[i]) & (j < cluster[i]))
    cluster[i[better]], distance[i[better]] = j[better], more[better]
    return cluster, distance, len(cells) + len(order)


def assigned(held: Broadcast, dims: int, leading: int):
    """Batches of stored vectors with (ids, cells, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]):
        centroids, turned = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                cells = matrix(part.column(1), np.int32, dims)
                leads = matrix(part.column(2), float, leading)
                cluster, distance, _ = nearest(cells, leads, part.column(3).to_numpy(), centroids, turned)
                yield part.column(0), cells, cluster, distance

    return run


def sum_up(held: Broadcast, dims: int, leading: int):
    """A task's number of vectors and sums of components for each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(held.value[0])
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, cells, cluster, _ in assigned(held, dims, leading)(batches):
            n += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, cells.astype(np.int64))
        own = np.flatnonzero(n)
        columns = [pa.array(np.repeat(own, dims)), pa.array(np.tile(np.arange(dims), len(own))), pa.array(np.repeat(n[own], dims)), pa.array(total[own].ravel())]
        yield pa.record_batch(columns, names=["cluster", "dim", "n", "total"])

    return run


def label(held: Broadcast, dims: int, leading: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in assigned(held, dims, leading)(batches):
            yield pa.record_batch([ids, pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2", leading: int = 12) -> DataFrame:
    """A row per usable row of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    turned = rotation(rows, dims, scale, leading)
    stored = kept(rows.mapInArrow(store(spark.sparkContext.broadcast(turned), dims, scale), STORED), "rotated")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = stored.select(drawn.alias("drawn"), "cells").orderBy("drawn", "cells").limit(k).collect()
    centroids = np.array([np.frombuffer(r["cells"], np.int32) for r in first], np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((centroids, turned))
        sent = stored.mapInArrow(sum_up(held, dims, leading), "cluster long, dim long, n long, total long")
        moved = centroids.copy()
        for r in sent.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            moved[r["cluster"], r["dim"]] = r["total"] // r["n"]
        if (moved == centroids).all():
            break
        centroids = moved
    held = spark.sparkContext.broadcast((centroids, turned))
    found = kept(stored.mapInArrow(label(held, dims, leading), "vec_id long, cluster int, distance long"), "clusters")
    own = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(own.values())
    described = spark.createDataFrame([(c, s, whole, digest(centroids[c])) for c, s in own.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(described), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

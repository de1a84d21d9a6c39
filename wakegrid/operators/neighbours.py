"""Exact spatial neighbour joins on hashed cells (J9, J10)."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _cell(columns: Sequence[str], size: Column | float) -> Column:
    return F.struct(*[F.floor(F.col(c) / size).alias(f"c{i}") for i, c in enumerate(columns)])


def _distance2(columns: Sequence[str]) -> Column:
    return sum((F.pow(F.col(f"l.{c}") - F.col(f"r.{c}"), 2) for c in columns), F.lit(0.0))


def radius_neighbours(
    left: DataFrame, right: DataFrame, by: Sequence[str], columns: Sequence[str], radius: float,
    left_id: str, right_id: str, carry: Sequence[str] = (), include_self: bool = True,
) -> DataFrame:
    """All (left, right) pairs within ``radius``: by, left id and position, right id, ``n_<c>``, dist.

    Space is cut into cells as wide as the radius.  Each right row is listed in
    the cells it can be reached from, the cells its ball touches, and met by an equi-join;
    ``carry`` names further right columns (prefix ``n_``).  Crowded cells are
    split by the adaptive skew join.
    """
    by = list(by)
    reach = F.array(
        *[
            F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(offset)])
            for offset in itertools.product((-1, 0, 1), repeat=len(columns))
        ]
    )

    def touched(o):
        """Whether the ball around the row reaches the cell at this offset."""
        gap = F.lit(0.0)
        for i, c in enumerate(columns):
            part = F.pmod(F.col(c), F.lit(float(radius)))
            side = F.when(o[f"o{i}"] < 0, part).when(o[f"o{i}"] > 0, radius - part).otherwise(0.0)
            gap = gap + side * side
        return gap <= radius * radius * (1 + 1e-9)

    spread = right.withColumn("_o", F.explode(F.filter(reach, touched)))
    spread = spread.withColumn(
        "_cell",
        F.struct(*[(F.floor(F.col(c) / radius) + F.col("_o")[f"o{i}"]).alias(f"c{i}") for i, c in enumerate(columns)]),
    )
    l = left.withColumn("_cell", _cell(columns, radius)).alias("l")
    r = spread.select(*by, "_cell", right_id, *columns, *carry).alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*by, "_cell"]]
    on.append(_distance2(columns) <= radius * radius)
    if not include_self:
        on.append(F.col(f"l.{left_id}") != F.col(f"r.{right_id}"))
    return l.join(r, on).select(
        *[F.col(f"l.{c}") for c in left.columns],
        F.col(f"r.{right_id}").alias(f"n_{right_id}"),
        *[F.col(f"r.{c}").alias(f"n_{c}") for c in [*columns, *carry]],
        F.sqrt(_distance2(columns)).alias("dist"),
    )


#: Points of one cell of the space tree that are compared with each other in one batch.
CELL_POINTS = 2048
#: Parts into which a full cell is cut along its widest side.
PARTS = 16
#: Points, or queries of one cell, that a task takes together.
BUNDLE = 8192


def _types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def space_cells(points: DataFrame, by: Sequence[str], columns: Sequence[str], most: int = CELL_POINTS) -> tuple[DataFrame, DataFrame, int]:
    """Cells of at most ``most`` points, however the points lie.

    A round cuts every fuller cell along its widest side at sampled quantiles of its
    points (and at its middle), so the number of rounds follows the logarithm of the
    number of points, and neither a far outlier nor a dense pile matters.  Returns
    the points with their ``_cell``, all cells (by, _cell, _parent, _inner, _n and
    the points' box _lo*, _hi*) and the number of rounds.  Of one place there must be
    at most ``most`` / 4 points.
    """
    by = list(by)
    keys = [*by, "_cell"]
    cells, settled, rounds = None, None, 0
    rows = points.withColumn("_cell", F.lit("0"))
    while True:
        rows = cut(rows)
        box = [e for i, c in enumerate(columns) for e in (F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}"))]
        own = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *box))
        own = own.withColumns({"_inner": F.col("_n") > most, "_parent": F.regexp_replace("_cell", r"\.?[0-9]+$", "")})
        cells = own if cells is None else cells.unionByName(own)
        if not own.where("_inner").head(1):
            return (rows if settled is None else settled.unionByName(rows)), cells, rounds
        rounds += 1
        small = rows.join(own.where("not _inner").select(*keys), keys, "left_semi")
        settled = small if settled is None else settled.unionByName(small)
        widths = [F.col(f"_hi{i}") - F.col(f"_lo{i}") for i in range(len(columns))]
        widest = F.greatest(*widths) if len(widths) > 1 else widths[0]
        axis = F.lit(0)
        for i in reversed(range(len(columns))):
            axis = F.when(widths[i] == widest, F.lit(i)).otherwise(axis)
        low, high = (functools.reduce(lambda a, i: F.when(F.col("_axis") == i, F.col(f"_{e}{i}").cast("double")).otherwise(a), range(len(columns)), F.lit(0.0)) for e in ("lo", "hi"))
        middle = low + (high - low) / 2
        full = own.where("_inner").withColumn("_axis", axis).select(*keys, "_axis", F.when(middle < high, middle).otherwise(low).alias("_middle"))
        along = functools.reduce(lambda a, ic: F.when(F.col("_axis") == ic[0], F.col(ic[1]).cast("double")).otherwise(a), enumerate(columns), F.lit(0.0))
        shares = [i / PARTS for i in range(1, PARTS)]
        placed = rows.join(full, keys).withColumn("_along", along)
        cuts = placed.groupBy(*keys).agg(F.percentile_approx("_along", shares, 50 * PARTS).alias("_cuts"), F.max("_middle").alias("_middle"))
        cuts = cuts.select(*keys, F.array_union("_cuts", F.array("_middle")).alias("_cuts"))
        part = F.size(F.filter("_cuts", lambda c: c < F.col("_along")))
        parted = placed.join(cuts, keys).withColumn("_cell", F.concat("_cell", F.lit("."), part.cast("string")))
        rows = parted.select(*points.columns, "_cell")


def _nearest(asked: np.ndarray, offered: np.ndarray, k: int, reach: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, squared distance) of each query's k nearest points within reach; earlier points win ties.

    With ``own`` the queries are the points, and a point isn't its own neighbour.
    """
    found: list[tuple] = []
    step = max(1, (1 << 20) // max(1, len(offered)))
    for at in range(0, len(asked), step):
        d2 = np.zeros((len(asked[at : at + step]), len(offered)))
        for i in range(asked.shape[1]):
            gap = asked[at : at + step, i, None] - offered[None, :, i]
            d2 += gap * gap
        if own:
            d2[np.arange(len(d2)), at + np.arange(len(d2))] = np.inf
        limit = np.full(len(d2), np.inf) if len(offered) <= k else np.partition(d2, k - 1, axis=1)[:, k - 1]
        limit = np.minimum(limit, reach[at : at + step] ** 2 * (1 + 1e-12))
        q, p = np.nonzero((d2 <= limit[:, None]) & np.isfinite(d2))
        found.append((q + at, p, d2[q, p]))
    q, p, d2 = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    order = np.lexsort((p, d2, q))
    q, p, d2 = q[order], p[order], d2[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], p[rank < k], d2[rank < k]


def knn(
    points: DataFrame, by: Sequence[str], ident: str, columns: Sequence[str], k: int,
    carry: Sequence[str] = (), most: int = CELL_POINTS,
) -> DataFrame:
    """The k nearest other points of every point; ties go to the lower id.

    Points are parted into cells of at most ``most`` points (``space_cells``).  Within
    a cell all are compared in Arrow batches, which also bounds how far a point's k
    nearest can be; the point then visits the other cells whose box is that near,
    found by going down the tree of cells, one equi-join for each level.  Of points at
    the same place only the k+1 lowest ids can be neighbours; the others of a pile
    take theirs from it, so piles of copies do not multiply.  A group of n <= k points
    gives n - 1 neighbours each.  Points without a position have no neighbours.
    """
    by, columns, carry = list(by), list(columns), list(carry)
    most = max(most, 4 * (k + 1))
    kinds = _types(points)
    points = points.select(*by, ident, *columns, *carry).dropna(subset=columns)
    spot = [*by, *columns]
    piles = cut(points.groupBy(*spot).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > k + 1).select(*spot))
    lowest = None
    candidates = points
    if piles.head(1):
        first = Window.partitionBy(*spot).orderBy(ident)
        piled = points.join(piles, spot, "left_semi")
        lowest = cut(piled.withColumn("_copy", F.row_number().over(first)).where(F.col("_copy") <= k + 1))
        candidates = points.join(piles, spot, "left_anti").unionByName(lowest.drop("_copy"))
    placed, cells, rounds = space_cells(candidates, by, columns, most)

    own = [*by, ident, *columns]
    theirs = [f"n_{c}" for c in [ident, *columns, *carry]]
    fields = [f"`{c}` {kinds[c]}" for c in own] + [f"`n_{c}` {kinds[c]}" for c in [ident, *columns, *carry]]

    def pairs(asked: pd.DataFrame, offered: pd.DataFrame, reach: np.ndarray, same: bool):
        """Neighbour rows, the number of each row's query and its squared distance."""
        q, p, d2 = _nearest(asked[columns].to_numpy(float), offered[columns].to_numpy(float), k, reach, same)
        left = asked[own].iloc[q].reset_index(drop=True)
        right = offered[[ident, *columns, *carry]].iloc[p].reset_index(drop=True)
        right.columns = theirs
        return pd.concat([left, right], axis=1), q, d2

    def inside(bundle: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, cell in bundle.groupby([*by, "_cell"], sort=False, dropna=False):
            cell = cell.sort_values(ident, kind="stable")
            rows, q, d2 = pairs(cell, cell, np.full(len(cell), np.inf), True)
            found = np.bincount(q, minlength=len(cell))
            # a query that found fewer than k here may find them anywhere
            reach = np.full(len(cell), np.inf)
            reach[q] = np.sqrt(d2)  # the last of a query is its farthest
            reach[found < k] = np.inf
            rows["dist"], rows["_reach"], rows["_cell"] = np.sqrt(d2), reach[q], cell["_cell"].iloc[0]
            rows["_first"] = np.diff(q, prepend=-1) != 0
            out.append(rows)
            if (found == 0).any():  # alone in its cell: a query without a row of its own
                lone = cell.iloc[np.flatnonzero(found == 0)]
                named = lone[[ident, *columns, *carry]].set_axis(theirs, axis=1)
                out.append(pd.concat([lone[own], named], axis=1).assign(dist=-1.0, _reach=np.inf, _cell=cell["_cell"].iloc[0], _first=True))
        return pd.concat(out)

    total = cells.where("not _inner").agg(F.sum("_n").alias("n")).first()["n"] or 0
    bundles = max(1, -(-total // BUNDLE))
    near = placed.withColumn("_bundle", F.pmod(F.xxhash64(*by, "_cell"), F.lit(bundles)))
    near = near.groupBy("_bundle").applyInPandas(inside, ", ".join([*fields, "dist double", "_reach double", "_cell string", "_first boolean"]))
    found = [*own, *theirs, "dist"]
    if rounds:
        near = cut(near)
        visits = _visits(near.where("_first").select(*own, "_reach", "_cell"), cells, by, columns, rounds)
        near = near.select(*found).unionByName(_visited(visits, placed, by, ident, columns, fields, pairs))
    w = Window.partitionBy(*by, ident).orderBy("dist", f"n_{ident}")
    best = near.where("dist >= 0").select(*found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if lowest is not None:
        # who isn't among a pile's lowest ids has the k lowest of them as its neighbours
        rest = points.join(piles, spot, "left_semi").join(lowest.select(*by, ident), [*by, ident], "left_anti").select(*own)
        offered = lowest.where(F.col("_copy") <= k).select(*spot, F.col("_copy").alias("rank"), *[F.col(c).alias(f"n_{c}") for c in [ident, *columns, *carry]])
        best = best.unionByName(rest.join(offered, spot).select(*own, *theirs, F.lit(0.0).alias("dist"), "rank"))
    return best


def _visits(queries: DataFrame, cells: DataFrame, by: list[str], columns: list[str], rounds: int) -> DataFrame:
    """Queries beside every other cell without parts whose box lies within their reach, from the root downwards."""
    box = [f"_{e}{i}" for i in range(len(columns)) for e in ("lo", "hi")]
    children = cells.select(*by, F.col("_parent").alias("_at"), F.col("_cell").alias("_to"), "_inner", *box)
    going = queries.withColumn("_at", F.lit("0"))
    arrived = None
    for _ in range(rounds):
        gap = F.lit(0.0)
        for i, c in enumerate(columns):
            side = F.greatest(F.col(f"_lo{i}") - F.col(c), F.col(c) - F.col(f"_hi{i}"), F.lit(0)).cast("double")
            gap = gap + side * side
        met = going.join(children, [*by, "_at"]).where(gap <= F.col("_reach") * F.col("_reach") * (1 + 1e-12))
        leaves = met.where(~F.col("_inner") & (F.col("_to") != F.col("_cell"))).select(*queries.drop("_cell").columns, F.col("_to").alias("_cell"))
        arrived = leaves if arrived is None else arrived.unionByName(leaves)
        going = met.where("_inner").select(*queries.columns, F.col("_to").alias("_at"))
    return cut(arrived)


def _visited(visits: DataFrame, placed: DataFrame, by: list[str], ident: str, columns: list[str], fields: list[str], pairs) -> DataFrame:
    """Neighbours that the visited cells offer.  The visitors of a cell are dealt over as many tasks as they need."""
    keys = [*by, "_cell", "_share"]
    shares = visits.groupBy(*by, "_cell").agg(F.ceil(F.count(F.lit(1)) / BUNDLE).alias("_shares"))
    asked = visits.join(shares, [*by, "_cell"]).withColumn("_share", F.pmod(F.xxhash64(ident), F.col("_shares"))).drop("_shares")
    offered = placed.join(shares, [*by, "_cell"]).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))).drop("_shares")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(ident, kind="stable")
        rows, _, d2 = pairs(left, right, left["_reach"].to_numpy(float), False)
        return rows.assign(dist=np.sqrt(d2))

    return asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(meet, ", ".join([*fields, "dist double"]))

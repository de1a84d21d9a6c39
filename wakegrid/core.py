"""Building blocks that keep ordered and grouped work distributed.

A track, camera or record may hold a large share of all rows, so nothing here
puts one whole group into one task.  Ordered work is cut into blocks of the
order key; the blocks of a hot group are spread over the cluster like any other
rows, and only one small row per block is looked at across blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .session import cut

#: Consecutive order positions handled together by one window partition.
BLOCK = 65536


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """NaN means "missing" in the sources; NULL lets aggregates skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Put per-group values (one row per ``by``) beside every row.

    Without keys the values come from a one-row table, read as a scalar subquery.
    """
    if by:
        return df.join(stats, list(by), how)
    row = stats.select(F.struct(*stats.columns).alias("_s")).scalar()
    values = [c for c in stats.columns]
    return df.withColumn("_s", row).select(
        *df.columns, *[F.col("_s")[c].alias(c) for c in values]
    )


def ordinal(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    slot: Column,
    name: str = "n",
) -> DataFrame:
    """0-based position of each row in its group, without one task per group.

    ``slot`` is a coarse, monotone function of the first order column (an hour,
    65536 frames, a price band).  Rows are numbered inside (group, slot) and
    shifted by the row count of the group's earlier slots.
    """
    by = list(by)
    work = df.withColumn("_slot", slot)
    counts = work.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        *by, "_slot", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy(*by, "_slot").orderBy(*order)
    numbered = work.join(base, by + ["_slot"])
    return numbered.withColumn(
        name, F.row_number().over(inside) - 1 + F.col("_base")
    ).drop("_slot", "_base")


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "n") -> DataFrame:
    """0-based position of each row in the order of the whole table, without a task that sees more than a range.

    Rows are dealt by ranges that Spark samples from the order columns, sorted there
    and written; a range's first position is the number of rows in earlier ranges.
    Only one row per range is looked at across ranges, so the values may be any
    (64-bit hashes, dates, crowded or far apart).  Rows that are equal in all order
    columns stay in one range: give the columns that tell them apart.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id Spark gives holds the range's number above 33 bits for the place in it
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    # one row for each range: its number is that of the shuffle's partitions
    out = placed.withColumn("_part", part).join(F.broadcast(base), "_part")
    return out.select(*df.columns, (place + F.col("_base")).alias(name))


def range_slots(df: DataFrame, order: Sequence[str | Column], slots: int | None = None, name: str = "_slot") -> DataFrame:
    """The rows, written, with the number of the range they were dealt to.

    Ranges follow the order columns and are cut at sampled rows, so they hold about
    as many rows each wherever the values crowd.  Without ``slots`` there are as many
    as shuffle partitions.
    """
    dealt = df.repartitionByRange(slots, *order) if slots else df.repartitionByRange(*order)
    return cut(dealt.withColumn(name, F.spark_partition_id()))


def windowed(
    df: DataFrame,
    by: Sequence[str],
    index: str,
    before: int,
    after: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    size: int = BLOCK,
) -> DataFrame:
    """Evaluate a row window that looks ``before`` back and ``after`` ahead.

    ``index`` is a non-negative integer order with at most one row per value.
    Each block of ``size`` positions also receives its border rows, so windows
    over (group, block) see the same neighbours as one over the whole group.
    """
    size = max(size, before + after + 1)
    i = F.col(index)
    first = F.greatest(F.floor((i - after) / size), F.lit(0))
    last = F.floor((i + before) / size)
    copies = df.withColumn("_block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*by, "_block").orderBy(index)
    return build(copies, w).filter(F.floor(i / size) == F.col("_block")).drop("_block")


def running(
    df: DataFrame,
    by: Sequence[str],
    index: str,
    sums: Mapping[str, Column],
    size: int = BLOCK,
) -> DataFrame:
    """Running totals along ``index`` within each group, block by block."""
    by = list(by)
    work = df.withColumn("_block", F.floor(F.col(index) / size))
    totals = work.groupBy(*by, "_block").agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()]
    )
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *by,
        "_block",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums],
    )
    inside = Window.partitionBy(*by, "_block").orderBy(index).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = work.join(base, by + ["_block"])
    out = out.withColumns(
        {n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_b_{n}") for n, c in sums.items()}
    )
    return out.drop("_block", *[f"_b_{n}" for n in sums])


def _rank_position(rule: str, p: float, n: Column) -> Column:
    if rule == "midpoint":  # position p*n + 1/2, clamped to [1, n]
        return F.least(F.greatest(n * p + 0.5, F.lit(1.0)), n.cast("double"))
    if rule == "linear":  # position 1 + (n-1)*p
        return (n - 1) * p + 1.0
    if rule == "nearest":  # the round(p*n)-th value
        return F.greatest(F.floor(n * p + 0.5), F.lit(1)).cast("double")
    raise ValueError(f"unknown quantile rule {rule!r}")


#: Values of one group that are looked at together when its ranks are read off.
SLOT = 4096
#: Shares at which a range of values is cut in a round of the selection.
CUTS = tuple(i / 256 for i in range(257))


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    rule: str = "midpoint",
    slot: int = SLOT,
) -> DataFrame:
    """Exact quantiles of one column per group: one row of ``by`` plus a column per prob."""
    return quantiles_of(df, by, {value: probs}, rule, slot)


def quantiles_of(
    df: DataFrame,
    by: Sequence[str],
    wanted: Mapping[str, Mapping[str, float]],
    rule: str = "midpoint",
    slot: int = SLOT,
) -> DataFrame:
    """Exact quantiles of several columns per group, by selection on shrinking ranges.

    ``wanted`` gives for each column the names and probabilities of its quantiles;
    the result has one row of ``by`` with a column for each name.  Every wanted rank
    starts with the whole range of its group.  A round cuts the open ranges at a
    sketch's quantiles, counts the values below, at, between and above the two cuts
    around the rank, and keeps the part that holds the rank, so a sketch that is off
    costs a round and never a wrong number.  A range is closed when it holds one
    value or at most ``slot`` rows; only those are gathered and sorted.  Counting is
    done in the tasks first, so one group may hold all rows.
    """
    by = list(by)
    names = [(c, name, p) for c, probs in wanted.items() for name, p in probs.items()]
    if not names:
        raise ValueError("no probabilities given")
    if not all(0 <= p <= 1 for _, _, p in names):
        raise ValueError("probabilities lie in [0, 1]")
    columns = list(wanted)
    cells = [F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]
    rows = df.select(*by, F.explode(F.array(*cells)).alias("_e")) if len(cells) > 1 else df.select(*by, cells[0].alias("_e"))
    rows = cut(rows.select(*by, F.col("_e.c").alias("_c"), F.col("_e.v").alias("_v")).where("_v is not null"))
    keys = [*by, "_c"]
    # the wanted ranks of a column are numbered alike in all groups; a column with fewer leaves places unused
    most = max(len(probs) for probs in wanted.values())

    def position(i: int) -> Column:
        """Position of the column's i-th wanted rank among its ``_n`` values, from 1."""
        found = F.lit(None).cast("double")
        for c, probs in wanted.items():
            if i < len(probs):
                p = list(probs.values())[i]
                found = F.when(F.col("_c") == c, _rank_position(rule, p, F.col("_n"))).otherwise(found)
        return found

    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    places = []
    for i in range(most):
        h = position(i)
        places.append(F.struct(h.alias("h"), F.floor(h).alias("k"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("_n").alias("inside")))
    state = cut(whole.select(*keys, "_n", F.array(*places).alias("_s")))

    def open_at(i: int) -> Column:
        s = F.col("_s")[i]
        return s["h"].isNotNull() & (s["lo"] < s["hi"]) & (s["inside"] > slot)

    some_open = functools.reduce(Column.__or__, [open_at(i) for i in range(most)])
    while state.where(some_open).head(1):
        closed, todo = state.where(~some_open), state.where(some_open)
        state = cut(_narrowed(rows, keys, by, todo, most, open_at).unionByName(closed))

    # what is left of a range is sorted; the next value is the least beyond it
    v = F.col("_v")
    beside = _beside(rows, state, keys, by)
    lists, nexts = [], []
    for i in range(most):
        s = F.col("_s")[i]
        lists.append(F.array_sort(F.collect_list(F.when((s["lo"] < s["hi"]) & v.between(s["lo"], s["hi"]), v))).alias(f"_in{i}"))
        nexts.append(F.min(F.when(v > s["hi"], v)).alias(f"_next{i}"))
    gathered = beside.groupBy(*keys).agg(*lists, *nexts).join(state, keys)

    def value_at(i: int) -> Column:
        s, inside = F.col("_s")[i], F.col(f"_in{i}")
        at = s["k"] - s["below"]
        a = F.when(s["lo"] < s["hi"], F.get(inside, (at - 1).cast("int"))).otherwise(s["lo"])
        within = F.when(s["lo"] < s["hi"], F.get(inside, at.cast("int"))).otherwise(s["lo"])
        b = F.when(at < s["inside"], within).otherwise(F.coalesce(f"_next{i}", a))
        return a + (s["h"] - s["k"]) * (b - a)

    found = gathered.select(*keys, *[value_at(i).alias(f"_x{i}") for i in range(most)])
    order = {c: list(probs) for c, probs in wanted.items()}
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_c") == c, F.col(f"_x{order[c].index(name)}"))).alias(name) for c, name, _ in names])


def _beside(rows: DataFrame, state: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Each value with its group's state.  Without groups there is one row of state for each column."""
    return rows.join(state if by else F.broadcast(state), keys)


def _narrowed(rows: DataFrame, keys: list[str], by: list[str], todo: DataFrame, most: int, open_at: Callable[[int], Column]) -> DataFrame:
    """One round of ``quantiles_of``: the open ranges of ``todo``, each cut around its rank."""
    v = F.col("_v")
    s = [F.col("_s")[i] for i in range(most)]
    held = [open_at(i) & v.between(s[i]["lo"], s[i]["hi"]) for i in range(most)]
    beside = _beside(rows, todo, keys, by)
    sketch = beside.groupBy(*keys).agg(
        *[F.percentile_approx(F.when(held[i], v), list(CUTS), 10 * len(CUTS)).alias(f"_q{i}") for i in range(most)]
    ).join(todo, keys)
    last = len(CUTS) - 1

    def around(i: int, step: int) -> Column:
        share = (s[i]["k"] - s[i]["below"]) / s[i]["inside"] * last
        return F.get(F.col(f"_q{i}"), F.least(F.greatest(F.floor(share) + step, F.lit(0)), F.lit(last)).cast("int"))

    aimed = sketch.select(*keys, "_n", "_s", *[around(i, -1).alias(f"_a{i}") for i in range(most)], *[around(i, 2).alias(f"_b{i}") for i in range(most)])
    aimed = cut(aimed)
    counts = []
    for i in range(most):
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        parts = {"lt": v < a, "eqa": v == a, "mid": (v > a) & (v < b), "eqb": (v == b) & (b > a), "gt": v > b}
        for name, part in parts.items():
            counts += [F.count(F.when(held[i] & part, 1)).alias(f"_{name}{i}"), F.min(F.when(held[i] & part, v)).alias(f"_{name}_lo{i}"), F.max(F.when(held[i] & part, v)).alias(f"_{name}_hi{i}")]
    counted = _beside(rows, aimed, keys, by).groupBy(*keys).agg(*counts).join(aimed, keys)

    def chosen(i: int) -> Column:
        """The part that holds the rank, with the number of values before it."""
        below, choices = s[i]["below"], []
        for name in ["lt", "eqa", "mid", "eqb", "gt"]:
            upto = below + F.col(f"_{name}{i}")
            choices.append((s[i]["k"] <= upto, F.struct(s[i]["h"].alias("h"), s[i]["k"].alias("k"), F.col(f"_{name}_lo{i}").alias("lo"), F.col(f"_{name}_hi{i}").alias("hi"), below.alias("below"), F.col(f"_{name}{i}").alias("inside"))))
            below = upto
        found = choices[-1][1]
        for holds, part in reversed(choices[:-1]):
            found = F.when(holds, part).otherwise(found)
        return F.when(open_at(i), found).otherwise(s[i])

    return counted.select(*keys, "_n", F.array(*[chosen(i) for i in range(most)]).alias("_s"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each task's share first."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def small_table(df: DataFrame, limit: int = 1 << 20) -> list:
    """Rows of a table whose size is bounded by a parameter, checked here."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"expected at most {limit} rows")
    return rows

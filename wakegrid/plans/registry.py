"""How a registered query states its result and its SQL twin.

Both sides name the same output columns once: whole numbers are cast to BIGINT
and reals are rounded the same way, so a difference in summation order does not
show.  The rounding is floor(x * 10^d + 0.500037) / 10^d because built-in
``round`` treats decimal halves differently in different engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from . import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HALF = 0.500037


def rounded(c: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(c.cast("double") * scale + HALF) / scale


def rounded_sql(expr: str, digits: int) -> str:
    scale = f"{10**digits}e0"
    return f"floor(cast({expr} as double) * {scale} + {HALF}e0) / {scale}"


class Tables:
    """The driver's tables and the domain views over them, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        build = getattr(views, f"spark_{name}", None)
        return build(self) if build else self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, ints: str = "", reals: str = "", texts: str = "", digits: int = 4, sql: str | None = None):
    """Register a query; ``sql`` is the body its twin selects the same columns from."""
    whole, real, text = ints.split(), reals.split(), texts.split()

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = build(Tables(spark, folder))
            return df.select(
                *[F.col(c) for c in text],
                *[F.col(c).cast("bigint").alias(c) for c in whole],
                *[rounded(F.col(c), digits).alias(c) for c in real],
            )

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            columns = [
                *text,
                *[f"cast({c} as bigint) as {c}" for c in whole],
                *[f"{rounded_sql(c, digits)} as {c}" for c in real],
            ]
            ORACLES[name] = f"select {', '.join(columns)} from ({sql}) as result"
        return build

    return register

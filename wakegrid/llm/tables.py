"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, tune


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_by(df: DataFrame, column: str, name: str) -> DataFrame:
    """``kept`` with the rows in buckets of ``column``, as many as shuffle partitions: grouping by it, with others, moves nothing."""
    spark, made = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column)
    writer.option("path", scratch_path(spark, name)).option("compression", "zstd").saveAsTable(made, format="parquet")
    return spark.table(made)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, what a query shuffles is deleted when the query ends, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that this package wrote to the shared folder and no longer reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of a batch that goes to Python; with the batch's copies a task stays small whatever the texts' length.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tune(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read, whatever else ``docs`` holds; rows without an id have no name to report under and drop out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def bucket_count(rows: int, each: int, least: int = 1) -> int:
    """Buckets of about ``each`` rows, so that their number follows the data."""
    return max(least, -(-rows // each))

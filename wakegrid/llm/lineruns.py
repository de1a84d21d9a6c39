"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without white space at its ends and with A-Z in lower
case; keys of at least ``shortest`` code points count.  A key found in at least
``least`` documents loses all its lines but those of the largest doc_id.

1. **Lines.**  One pass over the texts writes the 128-bit hashes and places of the
   long lines, dealt into ``batches`` ranges of doc_id, the largest ids first.
2. **Runs.**  A batch is reduced to one row for each key (documents, largest
   doc_id).  It is merge-anti-joined with the runs' settled keys, those with
   ``least`` documents in one run: their last holder is known and more of them
   changes nothing, so a line that stands everywhere is recorded in a few runs
   only.  What is left becomes a run: a table bucketed and sorted by the hash, so
   that later joins and merges read it without a shuffle.
3. **Levels.**  Two runs of a level are merged into one run of the next, so there
   are few runs and a row is written again as often as the number of batches
   doubles.  At the end all runs are merged, and keys with ``least`` documents stay.
4. **Texts.**  The places of lines to drop become a string of marks beside the
   document's lines, in time linear in their number.

Batches part the documents by id, so documents are counted once each, also when a
doc_id stands in several rows (with different texts too: each row is split on its
own, its key counts once).  Hot lines: rows are counted by key and document
before they are counted by key, and the join of the lines with the keys is a plain
equi-join, which adaptive execution broadcasts or splits.

Null and empty texts are one empty line.  Rows without a doc_id drop out; other
columns are not read.  An empty table gives an empty result.  A text of any
length is handled as one value by Spark, with its lines as one array.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .tables import forget, id_and_text, kept

#: The contract's white space and letters.
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """``line`` without white space at both ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(WHITE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text, version): rows of one doc_id with different texts differ in ``version``."""
    texts = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return texts.withColumn("version", F.xxhash64("text"))


def long_lines(texts: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, version, place, h1, h2) of the lines whose key has ``shortest`` code points or more."""
    lines = texts.select("doc_id", "version", F.posexplode(split_lines("text")).alias("place", "line"))
    lines = lines.where(F.char_length("line") >= shortest).withColumn("key", line_key(F.col("line")))
    lines = lines.where(F.char_length("key") >= shortest)
    hashes = [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")]
    return lines.select("doc_id", "version", "place", *hashes)


class LineRuns:
    """Levelled sorted runs (h1, h2, docs, last) in the shared folder.

    ``add`` takes batches of lines with falling doc_ids: an id below all of the
    batches before.  ``least`` documents settle a key.
    """

    def __init__(self, spark: SparkSession, least: int, buckets: int | None = None):
        self.spark, self.least = spark, least
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []

    def written(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, name)
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for name in self.levels if name]

    def drop(self, names: list[str]) -> None:
        for name in names:
            path = self.spark.sql(f"describe formatted {name}").where("col_name = 'Location'").head()["data_type"]
            self.spark.sql(f"drop table {name}")
            forget(self.spark, path)

    def merged(self, newer: str, older: str) -> DataFrame:
        """One row for each key of two runs.  Both lie in the same buckets, so the join reads them without a shuffle."""
        a = self.spark.table(newer).select(*KEY, F.col("docs").alias("docs_a"), F.col("last").alias("last_a"))
        b = self.spark.table(older).select(*KEY, F.col("docs").alias("docs_b"), F.col("last").alias("last_b"))
        docs = F.coalesce("docs_a", F.lit(0)) + F.coalesce("docs_b", F.lit(0))
        return a.hint("merge").join(b, KEY, "full").select(*KEY, docs.alias("docs"), F.greatest("last_a", "last_b").alias("last"))

    def add(self, lines: DataFrame) -> None:
        """Record a batch (doc_id, h1, h2)."""
        once = lines.groupBy("doc_id", *KEY).agg(F.lit(1).alias("one"))
        own = once.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
        for run in self.runs():
            settled = run.where(F.col("docs") >= self.least).select(*KEY)
            own = own.join(settled.hint("merge"), KEY, "left_anti")
        self.place(self.written(own), 0)

    def place(self, name: str, level: int) -> None:
        """Put a run into a level; two runs of a level are merged into one of the next."""
        if level == len(self.levels):
            self.levels.append(None)
        held, self.levels[level] = self.levels[level], name
        if held:
            self.levels[level] = None
            self.place(self.merge(name, held), level + 1)

    def merge(self, newer: str, older: str) -> str:
        made = self.written(self.merged(newer, older))
        self.drop([newer, older])
        return made

    def common(self) -> DataFrame:
        """Written table (h1, h2, last) of the keys with ``least`` documents; the runs are dropped."""
        names = [name for name in self.levels if name]
        whole = names[0]
        for name in names[1:]:
            whole = self.merge(whole, name)
        found = kept(self.spark.table(whole).where(F.col("docs") >= self.least).select(*KEY, "last"), "common-lines")
        self.drop([whole])
        self.levels = []
        return found


def batch_number(docs: DataFrame, batches: int) -> Column:
    """Number of a doc_id's range, 0 for the largest ids; the ranges hold about as many rows each."""
    shares = [k / batches for k in range(1, batches)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 1000).alias("bounds")).head()["bounds"] if shares else []
    number = F.lit(0)
    for bound in bounds or []:
        number = number + (F.col("doc_id") <= bound).cast("int")
    return number


def dropped_places(texts: DataFrame, shortest: int, least: int, batches: int) -> DataFrame:
    """(doc_id, version, places): sorted places of the lines that a text loses."""
    spark = texts.sparkSession
    lines = long_lines(texts, shortest).withColumn("batch", batch_number(texts.select("doc_id"), batches))
    path = scratch_path(spark, "long-lines")
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, least)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    lost = lines.join(runs.common(), KEY).where(F.col("doc_id") != F.col("last"))
    return lost.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("place")).alias("places"))


def without(lines: Column, places: Column) -> Column:
    """The lines at other places, joined by line feeds."""
    before = lambda i: F.when(i > 0, F.get(places, i - 1)).otherwise(-1)
    marks = F.transform(places, lambda p, i: F.concat(F.repeat(F.lit("0"), p - before(i) - 1), F.lit("1")))
    marks = F.split(F.concat_ws("", marks), "")
    return F.array_join(F.zip_with(lines, marks, lambda line, mark: F.when(F.coalesce(mark, F.lit("0")) != "1", line)), "\n")


def dedup_lines(docs: DataFrame, shortest: int = 40, least: int = 5, batches: int = 6) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_lines, n_dropped and kept_text."""
    texts = texts_of(docs)
    found = texts.join(dropped_places(texts, shortest, least, batches), ["doc_id", "version"], "left")
    lines = split_lines("text")
    return found.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(without(lines, F.col("places"))).alias("kept_text"),
    )

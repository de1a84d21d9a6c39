"""From raw documents to packed training sequences, stage by stage.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the next stage's docs.  ``run`` writes what each stage returns to the
shared folder and reads it again, so a stage that is lost is begun from files.

All stages but the last return the columns of ``documents``.  Rows without a
doc_id drop out in the first stage; null texts count as empty and stay.  A row
that repeats a doc_id stays as often as its document does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakegrid.llm.decontam import clean
from wakegrid.llm.jaccard import jaccard_components
from wakegrid.llm.labelled import fold
from wakegrid.llm.packing import pack_documents
from wakegrid.llm.queries import tokenizer_path
from wakegrid.llm.substring import dedup_substrings
from wakegrid.llm.tables import kept, table
from wakegrid.llm.toxicity import score_toxicity, train_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OTHERS = ["lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects (0.5 or more) go."""
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    model = train_toxicity(docs, labels)
    whole = docs.withColumn("body", F.col("text"))
    return score_toxicity(whole, model, ["body", *OTHERS]).where("score < 0.5").select("doc_id", F.col("body").alias("text"), *OTHERS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    found = jaccard_components(docs)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that an earlier document has go; texts that lose nothing stay as they are."""
    whole = docs.withColumn("body", F.col("text"))
    found = dedup_substrings(whole, carry=["body", *OTHERS])
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("body"))
    length = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", length.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: The classifier of the first stage can't be written as SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

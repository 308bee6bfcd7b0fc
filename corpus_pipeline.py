"""From raw documents to training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept: toxic documents
go, one document of each near-duplicate group stays (five-word shingles, Jaccard 0.8 or more), personal
data and the terms that reveal it are rewritten, sources are mixed to their targets (a document taken
twice is two rows, one not taken is none), and what is left is packed into sequences. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modesift.llm import op2_pii, op3_pack, op4_toxicity, op7_jaccard, op9_mix
from modesift.llm.common import Scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 1/2 or more."""
    model = op4_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op4_toxicity.score(docs, *model).where("toxicity__score < 0.5").drop("toxicity__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group."""
    return op7_jaccard.keep_one(docs, width=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites personal data; n_chars follows the text."""
    out = op2_pii.sanitise(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that the mix takes a document."""
    taken = op9_mix.mix(docs).where("mix__copies > 0")
    return taken.withColumn("mix__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix__copies")))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document: doc_id, piece, bin_id, position, n_words, bin_words."""
    return op3_pack.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]
#: Scores, near-duplicate groups and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.write(docs)
    return docs

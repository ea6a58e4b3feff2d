"""From raw documents to packed training sequences: quality, near-duplicates, privacy, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. run() writes each stage's result as Parquet in the shared folder and reads it back; what a stage no longer
needs is deleted.

Defined cases, for every stage: no rows in give no rows out; a null text counts as an empty one and stays null where the
stage keeps it; null ids, languages and sources are values like others; repeated rows are rows of their own, of which
near-duplicates keep one; texts of any length are read as a whole; further columns, whatever they are called, come through
all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankflow.llm.common import drop, stored
from rankflow.llm.mixing import sample
from rankflow.llm.packing import pack
from rankflow.llm.privacy import mask
from rankflow.llm.quality import keep_good
from rankflow.llm.queries import vocabulary
from rankflow.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: a score of 0.7 or more. Without usable labels all scores are equal; an empty text has a score too."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id (null: smallest), then fingerprint, then text. All empty texts are one class."""
    return keep_one(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, and n_chars made to fit. Every row stays; of overlapping spans the longer one that starts first is named."""
    return mask(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by calibrated probabilities, which only a row's class and id decide: equal rows stay or go together."""
    return sample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences; an empty text is one piece that holds the end id."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("privacy", privacy), ("mixing", mixing), ("packing", packing)]
#: SQL can't express the classifier, the fingerprints or the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)

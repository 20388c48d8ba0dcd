"""The corpus pipeline: five stages, each on what its predecessor kept.

A stage is called with (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each to the shared folder as Parquet and reads it again for the next.  All but the
last return the columns of ``documents``.  Rows with nulls, empty texts and repeated
rows are treated as the operator of each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm.decontam import keep_clean
from batchlens.llm.neardup import keep_one
from batchlens.llm.packing import pack
from batchlens.llm.pii import replace_entities
from batchlens.llm.quality import keep_good
from batchlens.llm.queries import byte_bpe, table
from batchlens.sources.shared import run_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the quality rules go; thresholds come from the labels of those that are there."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return keep_one(docs, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and credentials are replaced in the texts."""
    replaced = replace_entities(docs, key="example-key").withColumn("n_chars", F.length("text").cast("bigint"))
    return replaced.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences."""
    return pack(docs, byte_bpe(), capacity=2048, end_id=0)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("surrogates for personal data", surrogates),
    ("best-fit packing", packing),
]

ORACLE_SQL = None  # no stage but the last could be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = run_folder(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Token counts through a cache of digests.

A count is stored under two digests: that of the content and that of the
tokenizer file, so a new version of a tokenizer finds nothing stale.  Texts whose
digest is not stored are encoded once each, however many copies there are, and
appended to the cache; then all rows are joined to it.  A text is normalised
before it is digested only in ways that leave the count alone (null becomes
empty); whatever else a tokenizer normalises is part of its version.

Null texts count as empty.  Rows with equal texts get equal counts.  An empty
table leaves the cache as it was.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.llm.common import file_exists, map_slices, settle
from batchlens.llm.tokens import encoder

CACHE = "tokenizer string, digest binary, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def count_tokens(texts: DataFrame, tokenizer: str) -> DataFrame:
    """``digest, n_tokens`` from ``digest, _text``."""

    def work(digests: list, bodies: list) -> pa.RecordBatch:
        counts = [len(ids) // 4 for ids in encoder(tokenizer).encode(bodies)]
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], names=["d", "n"])

    return map_slices(texts, ["digest", "_text"], work, "digest binary, n_tokens bigint")


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; ``cache`` is a Parquet folder all executors reach."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", body.alias("_text")).withColumn("digest", F.unhex(F.sha2("_text", 256)))
    narrow = settle(rows.select("doc_id", "digest", F.octet_length("_text").cast("bigint").alias("n_bytes")))
    misses = rows.groupBy("digest").agg(F.first("_text").alias("_text"))
    if file_exists(spark, cache):
        stored = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
        misses = misses.join(stored, "digest", "left_anti")
    fresh = count_tokens(misses, tokenizer).select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
    fresh.write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
    known = known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may append the same digest
    return narrow.join(known, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

"""Helpers the operators share: batches of rows, keys of contents, the session's shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.sources import shared

SLICE_ROWS, SLICE_CHARS = 256, 1 << 20


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; the shuffles it took are removed at once.

    Nothing reads them again, and else they would stay on the executors' disks until
    the driver happens to collect its garbage.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return shared.settle(df.select("*"))  # a plan takes up the setting when it is made
    finally:
        conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, with the sizes of its files.

    For long chains of joins.  A checkpoint keeps the size that was estimated for its plan, a
    product over all joins before it: after some twenty steps such numbers have millions of
    digits and fill the driver's memory.
    """
    spark = df.sparkSession
    path, before = shared.run_folder(spark, "step"), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def content_key(text: str | Column = "text") -> Column:
    """16 bytes that stand for a text, null for a null text; equal for equal texts only, as far as MD5 goes."""
    return F.unhex(F.md5(F.col(text) if isinstance(text, str) else text))


def map_slices(
    df: DataFrame, columns: Sequence[str], work: Callable[..., pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``work(*lists)`` for a few hundred rows or a million characters at a time.

    A batch as Spark cuts it holds up to 10,000 rows of any length, which as
    Python objects would not fit a worker; the slices bound that by their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                done = work(*(c.to_pylist() for c in piece.columns))
                if done is not None:
                    yield done

    return df.select(*columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = [0] * batch.num_rows
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            lengths = pa.compute.binary_length(column).fill_null(0).to_pylist()
            sizes = [a + b for a, b in zip(sizes, lengths)]
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > SLICE_CHARS or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


def file_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)

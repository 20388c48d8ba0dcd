"""The shared folder in which lineage is cut.

A cluster names it in ``spark.checkpoint.dir``.  Files there outlive the
executors that wrote them, so a lost executor costs a re-read and not the
recomputation of everything upstream.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOT_ROWS, _MOST_LOTS = 1 << 24, 3  # rows that are exchanged at a time, unless that takes more lots than this


def _shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="batchlens-")


def run_folder(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{_shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Plans made in here have their shuffles removed as soon as they have run.

    Else the files stay on the executors' disks until the driver happens to collect its garbage.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the files.

    For results that several later jobs read, or whose rows carry positions
    that must not be computed a second time.  The shuffles it took are removed.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_root(df.sparkSession))
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan takes up the setting when it is made


def _by_column(df: DataFrame) -> bool:
    """Whether parquet can hold this table."""
    kinds = df.schema.simpleString().lower()
    names = [c.lower() for c in df.columns]
    return bool(names) and len(set(names)) == len(names) and not any(k in kinds for k in ("void", "interval", "variant"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder: as ``settle``, for large tables, or of which later jobs read some columns.

    A checkpoint holds whole rows, uncompressed, and each job over it reads all of them.
    """
    return stored_in_lots(df.sparkSession, 1, lambda _: df)


def lots_for(n_rows: int) -> int:
    return min(_MOST_LOTS, max(1, ceil(n_rows / _LOT_ROWS)))


def lot_of(lots: int, lot: int, cols: Sequence[str | Column]) -> Column:
    """Whether a row belongs to this of ``lots``, by the hash of ``cols``."""
    return F.lit(True) if lots == 1 else F.pmod(F.xxhash64(*cols), F.lit(lots)) == lot


def stored_in_lots(spark: SparkSession, lots: int, part: Callable[[int], DataFrame]) -> DataFrame:
    """One table of the shared folder out of ``part(0)``, ``part(1)``, …, made one after the other.

    What a part exchanges is removed before the next one begins, so the disks hold one lot's
    shuffles at a time.
    """
    path = run_folder(spark, "table")
    for lot in range(lots):
        with shuffles_removed(spark):
            df = part(lot).select("*")
            if not _by_column(df):
                return reduce(DataFrame.unionByName, [settle(part(k)) for k in range(lots)])
            df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``stored`` or ``stored_in_lots`` has made and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("table-"):
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

"""How many attributes were tested in each batch, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.functions import percent_label, present_count
from batchlens.operators.roles import COUNTER


def non_null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the number of values in each column."""
    return df.agg(*[F.count(f"`{c}`").alias(c) for c in cols])


def drop_empty_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop the columns (of ``cols``, or of all) that hold no value at all."""
    cols = list(cols or df.columns)
    counts = non_null_counts(df, cols).first().asDict()
    return df.drop(*[c for c in cols if counts[c] == 0])


def with_test_count(df: DataFrame, cols: Sequence[str], name: str = COUNTER) -> DataFrame:
    return df.withColumn(name, present_count(cols))


def with_coverage(df: DataFrame, total: int, counter: str = COUNTER) -> DataFrame:
    """Imputed tests and the shares of original and imputed ones."""
    share = F.col(counter) / F.lit(float(total))
    return df.withColumns(
        {
            "imputed_tests": (F.lit(total) - F.col(counter)).cast("int"),
            "share_original": share,
            "share_imputed": F.lit(1.0) - share,
        }
    )


def prune_low_coverage(df: DataFrame, frac: float = 0.6, counter: str = COUNTER) -> DataFrame:
    """Keep rows whose counter reaches ``frac`` of the largest counter."""
    best = df.agg(F.max(counter)).scalar()
    return df.filter(F.col(counter) >= F.lit(frac) * best)


def prune_report(df: DataFrame, frac: float = 0.6, counter: str = COUNTER) -> DataFrame:
    """One row: the threshold, and rows before, after and dropped, in a single pass.

    Rows are counted per counter value first, which leaves at most one row per
    possible counter for the comparison with the maximum.
    """
    sizes = df.groupBy(counter).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy().agg(
        F.max(counter).alias("max_tests"),
        F.collect_list(F.struct(F.col(counter).alias("tests"), "n")).alias("sizes"),
    )
    threshold = F.lit(frac) * F.col("max_tests")
    total = lambda arr: F.aggregate(arr, F.lit(0).cast("bigint"), lambda acc, s: acc + s["n"])
    return sizes.select(
        F.col("max_tests").cast("bigint").alias("max_tests"),
        threshold.alias("threshold"),
        total(F.col("sizes")).alias("rows_before"),
        total(F.filter("sizes", lambda s: s["tests"] >= threshold)).alias("rows_after"),
    ).withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


def coverage_distribution(df: DataFrame, total: int, counter: str = COUNTER) -> DataFrame:
    """Batches per coverage level with the heights of a stacked bar, largest group first."""
    grouped = df.groupBy(counter).agg(F.count(F.lit(1)).alias("batch_count"))
    return (
        with_coverage(grouped, total, counter)
        .withColumns(
            {
                "height_original": F.col("share_original") * F.lit(float(total)),
                "height_imputed": F.col("share_imputed") * F.lit(float(total)),
            }
        )
        .orderBy(F.desc("batch_count"), counter)
    )


def coverage_percent(df: DataFrame, total: int, counter: str = COUNTER) -> DataFrame:
    """Batches per coverage level with the level as a percentage; the counter stays the key."""
    return (
        df.groupBy(counter)
        .agg(F.count(F.lit(1)).alias("batch_count"))
        .withColumn("percent", percent_label(F.col(counter), total))
        .orderBy(counter)
    )

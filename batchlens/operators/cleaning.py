"""Exact decimals: parse, impute, recover precision, round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from batchlens.functions import DECIMAL, decimal_places, exact_double, parse_decimal, round_half_up
from batchlens.operators.quantiles import median_values


def to_decimal(df: DataFrame, cols: Sequence[str], kind: str = DECIMAL) -> DataFrame:
    """Blanks to null, everything else to an exact decimal."""
    return df.withColumns({c: parse_decimal(F.col(f"`{c}`"), kind) for c in cols})


def to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    double = lambda c: exact_double(F.col(f"`{c}`")) if isinstance(df.schema[c].dataType, DecimalType) else F.col(f"`{c}`").cast("double")
    return df.withColumns({c: double(c) for c in cols})


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill gaps of decimal columns with their exact median; a column without values stays empty."""
    medians = median_values(df, cols)
    return df.withColumns(
        {
            c: F.coalesce(F.col(f"`{c}`"), F.lit(medians[c]).cast(df.schema[c].dataType))
            for c in cols
            if medians[c] is not None
        }
    )


def decimal_type(df: DataFrame, col: str) -> str:
    """The column's own decimal type; the usual one for columns of other types."""
    kind = df.schema[col].dataType
    return kind.simpleString() if isinstance(kind, DecimalType) else DECIMAL


def precision_table(df: DataFrame, col: str) -> DataFrame:
    """Every value of one column with the decimal places it uses."""
    return df.filter(F.col(f"`{col}`").isNotNull()).select(
        F.col(f"`{col}`").alias("value"), decimal_places(F.col(f"`{col}`"), decimal_type(df, col)).alias("places")
    )


def mode_smallest(df: DataFrame, by: Sequence[str], col: str, name: str = "mode") -> DataFrame:
    """The most frequent value of ``col`` per group, the smallest one on a tie.

    Counting comes first, so the choice is made among distinct values only.
    """
    counted = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    best = Window.partitionBy(*by).orderBy(F.desc("_n"), col)
    return (
        counted.withColumn("_place", F.row_number().over(best))
        .filter("_place = 1")
        .select(*by, F.col(col).alias(name))
    )


def column_precision(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Usual number of decimal places of each column, at least 1; null for an empty column."""
    places = df.select(*[decimal_places(F.col(f"`{c}`"), decimal_type(df, c)).alias(c) for c in cols])
    modes = mode_smallest(places.unpivot([], list(cols), "attribute", "places"), ["attribute"], "places")
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "position int, attribute string")
    return (
        names.join(F.broadcast(modes), "attribute", "left")  # one row per column
        .select("attribute", F.when(F.col("mode").isNotNull(), F.greatest("mode", F.lit(1))).alias("places"))
    )


def normalize_precision(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Round each column half-up to its usual precision; also returns (attribute, places)."""
    rows = column_precision(df, cols).collect()  # one small number per column
    places = {r["attribute"]: r["places"] for r in rows}
    rounded = df.withColumns(
        {c: round_half_up(F.col(f"`{c}`"), places[c], decimal_type(df, c)) for c in cols if places[c] is not None}
    )
    summary = df.sparkSession.createDataFrame(
        [(c, places[c]) for c in cols], "attribute string, places int"
    )
    return rounded, summary

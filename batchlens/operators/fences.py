"""Interquartile fences: which attributes of a row lie outside, and what that makes the row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.operators.quantiles import quantile_values

UNIVARIATE = "Univariate deviation"
MULTIVARIATE = "Multivariate deviation"


@dataclass(frozen=True)
class Fences:
    """Lower and upper bound per attribute; None where a column has no values."""

    bounds: dict[str, tuple[float | None, float | None]]

    def outside(self, col: str, missing: bool = False) -> Column:
        """Strictly beyond a bound.  ``missing`` is the answer for a missing value."""
        low, high = self.bounds[col]
        beyond = (F.col(f"`{col}`") < F.lit(low)) | (F.col(f"`{col}`") > F.lit(high))
        return F.coalesce(beyond, F.lit(missing))


def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> Fences:
    """Q1 − k·IQR and Q3 + k·IQR of every column, over the whole table."""
    q = quantile_values(df, cols, [0.25, 0.75])
    bounds = {}
    for c in cols:
        q1, q3 = q[c, 0.25], q[c, 0.75]
        bounds[c] = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return Fences(bounds)


def fence_table(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """(attribute, lower, upper)."""
    bounds = iqr_fences(df, cols, k).bounds
    return df.sparkSession.createDataFrame(
        [(c, *bounds[c]) for c in cols], "attribute string, lower double, upper double"
    )


def with_constants(df: DataFrame, fences: Fences) -> DataFrame:
    """Each row with the bounds of every attribute beside it."""
    added = {}
    for c, (low, high) in fences.bounds.items():
        added[f"{c}_lower"], added[f"{c}_upper"] = F.lit(low).cast("double"), F.lit(high).cast("double")
    return df.withColumns(added)


def fence_mask(df: DataFrame, fences: Fences, keep_cols: Sequence[str]) -> DataFrame:
    """One state per attribute: ``inside`` (bounds included), ``outside`` or ``missing``."""
    def state(c: str) -> Column:
        return (
            F.when(F.col(f"`{c}`").isNull(), "missing")
            .when(fences.outside(c), "outside")
            .otherwise("inside")
            .alias(c)
        )

    return df.select(*keep_cols, *[state(c) for c in fences.bounds])


def deviation_type(fences: Fences, exempt: str | None = None) -> Column:
    """Multivariate when every attribute is inside, or only the exempt one is outside; else univariate.

    The exempt attribute is the last one unless named.  A missing value counts
    as outside here.
    """
    cols = list(fences.bounds)
    exempt = exempt or cols[-1]
    others = reduce(lambda a, b: a | b, [fences.outside(c, missing=True) for c in cols if c != exempt], F.lit(False))
    return F.when(others, UNIVARIATE).otherwise(MULTIVARIATE)


def deviation_summary(outliers: DataFrame, fences: Fences, ids: Sequence[str], exempt: str | None = None) -> DataFrame:
    """Identifiers and deviation type of every flagged row."""
    return outliers.select(*ids, deviation_type(fences, exempt).alias("deviation_type"))


def attribute_flags(outliers: DataFrame, fences: Fences) -> DataFrame:
    """How often each attribute lies outside among the flagged rows; only those that do, most often first.

    A missing value is not outside here.
    """
    cols = list(fences.bounds)
    counts = outliers.agg(*[F.count_if(fences.outside(c)).alias(c) for c in cols])
    return (
        counts.unpivot([], cols, "attribute", "times_flagged")
        .filter("times_flagged > 0")
        .orderBy(F.desc("times_flagged"), "attribute")
    )


def top_attributes(flags: DataFrame, skip: int = 1, n: int = 3) -> list[str]:
    """Names ranked after the first ``skip``; fewer than ``n`` when there are no more."""
    ordered = flags.orderBy(F.desc("times_flagged"), "attribute")
    return [r["attribute"] for r in ordered.offset(skip).limit(n).collect()]

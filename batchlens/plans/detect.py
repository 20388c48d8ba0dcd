"""From a complete table to labelled and explained outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.functions import DECIMAL, present_count
from batchlens.operators.audit import refuse_bad_values
from batchlens.operators.components import ComponentModel, fit_pca, standardize, transform_pca
from batchlens.operators.coverage import drop_empty_columns, prune_low_coverage
from batchlens.operators.evaluation import label_outliers, select_outliers
from batchlens.operators.fences import deviation_summary, deviation_type, iqr_fences
from batchlens.operators.forest import IsolationForest
from batchlens.operators.roles import COUNTER, ROW_KEY, Roles, prefix_columns
from batchlens.plans.curate import focus_slice
from batchlens.operators.cleaning import impute_median, to_decimal, to_double
from batchlens.sources.shared import discard, settle, stored


def fence_screen(
    df: DataFrame, roles: Roles = Roles(), frac: float = 0.6, kind: str = DECIMAL, refuse: bool = True
) -> DataFrame:
    """Fences alone, no forest: busiest slice, pruned and imputed, each row with its deviation type.

    Empty columns go first: without fences of its own such a column would decide the
    type.  Values that are no decimal are treated as ``clean`` treats them.
    """
    part = settle(drop_empty_columns(focus_slice(df), roles.features(df)))
    cols = roles.features(part)
    if refuse:
        refuse_bad_values(part, cols, kind)
    part = part.withColumn(COUNTER, present_count(cols))
    exact = settle(to_decimal(prune_low_coverage(part, frac), cols, kind))
    filled = settle(to_double(impute_median(exact, cols), cols))
    return filled.select(ROW_KEY, *roles.ids, deviation_type(iqr_fences(filled, cols)).alias("deviation_type"))


def component_scores(df: DataFrame, cols: Sequence[str], keep: float = 0.95) -> tuple[DataFrame, ComponentModel]:
    """Standardised, reduced to components, and the components standardised again, by row key."""
    scaled = stored(standardize(df.select(ROW_KEY, *cols), cols))
    model = fit_pca(scaled, cols, keep)
    scores = transform_pca(scaled, model, [ROW_KEY])
    scores = stored(standardize(scores, prefix_columns(scores, "PC")))
    discard(scaled)
    return scores, model


def final_model(
    df: DataFrame, cols: Sequence[str], contamination: float = 0.05, forest: IsolationForest = IsolationForest(trees=400)
) -> DataFrame:
    """Decision value and label of every row, from a forest over its component scores."""
    scores, _ = component_scores(df, cols)
    decided = settle(forest.fit_score(scores, prefix_columns(scores, "PC")))
    return label_outliers(decided, contamination)


def explain_outliers(df: DataFrame, labels: DataFrame, cols: Sequence[str], roles: Roles = Roles()) -> DataFrame:
    """Identifiers and deviation type of the rows labelled -1, with fences over the whole table."""
    outliers = select_outliers(df, labels.filter(F.col("label") == -1))
    return deviation_summary(outliers, iqr_fences(df, cols), [ROW_KEY, *roles.ids])

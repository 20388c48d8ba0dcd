"""Standardise, reduce to principal components, and explain the components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchlens.functions import component_label


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean 0 and population standard deviation 1; a constant column becomes 0.

    One pass for the moments, which enter the plan as literals.
    """
    moments = df.agg(
        F.array(*[F.avg(f"`{c}`") for c in cols]).alias("mean"),
        F.array(*[F.stddev_pop(f"`{c}`") for c in cols]).alias("sd"),
    ).first()
    return df.withColumns(
        {
            c: (F.col(f"`{c}`") - F.lit(mean)) / F.lit(sd) if sd else F.col(f"`{c}`") * F.lit(0.0)
            for c, mean, sd in zip(cols, moments["mean"], moments["sd"])
        }
    )


@dataclass(frozen=True)
class ComponentModel:
    """Loadings (attribute × component) and variance ratios: sized by columns, never by rows."""

    spark: SparkSession
    attributes: tuple[str, ...]
    weights: np.ndarray
    ratios: np.ndarray

    @property
    def names(self) -> list[str]:
        return [f"PC{i}" for i in range(1, len(self.ratios) + 1)]


def fit_pca(df: DataFrame, cols: Sequence[str], keep: float = 0.95) -> ComponentModel:
    """Principal components of standardised columns: the fewest whose ratios add up to more than ``keep``.

    Each component is turned so that its largest loading is positive (the first
    of equally large ones), since the sign a solver returns means nothing.
    """
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(df.select(*cols)).select("_v")
    model = PCA(k=len(cols), inputCol="_v", outputCol="_p").fit(vectors)
    weights, ratios = model.pc.toArray(), model.explainedVariance.toArray()
    kept = min(int(np.searchsorted(np.cumsum(ratios), keep, side="right")) + 1, len(ratios))
    weights, ratios = weights[:, :kept], ratios[:kept]
    size = np.abs(weights)
    largest = weights[(size >= size.max(axis=0) - 1e-9).argmax(axis=0), np.arange(kept)]
    return ComponentModel(df.sparkSession, tuple(cols), weights * np.where(largest < 0, -1.0, 1.0), ratios)


def transform_pca(df: DataFrame, model: ComponentModel, keep_cols: Sequence[str]) -> DataFrame:
    """``keep_cols`` and the component scores PC1 … PCk of every (standardised) row."""
    def score(j: int):
        total = F.lit(0.0)
        for attribute, weight in zip(model.attributes, model.weights[:, j]):
            total = total + F.col(f"`{attribute}`") * F.lit(float(weight))
        return total

    return df.select(*keep_cols, *[score(j).alias(name) for j, name in enumerate(model.names)])


def vector_columns(df: DataFrame, col: str, size: int, prefix: str) -> DataFrame:
    """An array column as ``size`` plain double columns."""
    return df.select(
        *[c for c in df.columns if c != col],
        *[F.col(col)[i].cast("double").alias(f"{prefix}{i + 1}") for i in range(size)],
    )


def loadings(model: ComponentModel) -> DataFrame:
    """(attribute, component, loading)."""
    return model.spark.createDataFrame(
        [
            (a, name, float(model.weights[i, j]))
            for i, a in enumerate(model.attributes)
            for j, name in enumerate(model.names)
        ],
        "attribute string, component string, loading double",
    )


def explained_variance(model: ComponentModel) -> DataFrame:
    """(position, component, ratio)."""
    return model.spark.createDataFrame(
        [(j + 1, name, float(r)) for j, (name, r) in enumerate(zip(model.names, model.ratios))],
        "position int, component string, ratio double",
    )


def scree(model: ComponentModel, threshold: float = 0.95) -> DataFrame:
    """Individual and cumulative ratio of each component, with the line it is compared to."""
    upto = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)  # k rows
    return (
        explained_variance(model)
        .withColumn("cumulative", F.sum("ratio").over(upto))
        .withColumn("threshold", F.lit(threshold))
        .withColumn("label", component_label(F.col("position"), F.col("ratio")))
    )


def component_detail(model: ComponentModel, component: str) -> DataFrame:
    """The loadings of one component, strongest first."""
    return (
        loadings(model)
        .filter(F.col("component") == component)
        .select("attribute", "loading", F.abs("loading").alias("abs_loading"))
        .orderBy(F.desc("abs_loading"), "attribute")
    )


def loading_weight(model: ComponentModel) -> DataFrame:
    """Total absolute loading per attribute, largest first."""
    return (
        loadings(model)
        .groupBy("attribute")
        .agg(F.sum(F.abs("loading")).alias("total_abs"))
        .orderBy(F.desc("total_abs"), "attribute")
    )


def loading_matrix(model: ComponentModel) -> DataFrame:
    """Attribute × component, attributes ordered by total absolute loading."""
    wide = loadings(model).groupBy("attribute").pivot("component", model.names).agg(F.first("loading"))
    return wide.join(loading_weight(model), "attribute").orderBy(F.desc("total_abs"), "attribute")


def global_contribution(model: ComponentModel) -> DataFrame:
    """Σ loading² · ratio per attribute, largest first."""
    return (
        loadings(model)
        .join(explained_variance(model), "component")
        .groupBy("attribute")
        .agg(F.sum(F.col("loading") * F.col("loading") * F.col("ratio")).alias("contribution"))
        .orderBy(F.desc("contribution"), "attribute")
    )


def implied_correlations(model: ComponentModel) -> DataFrame:
    """``attribute, other, correlation``: what the kept components say of each pair of attributes.

    Σ variance · loading · loading over the components.  With all of them kept these are the
    correlations of the columns, which checks a model; with fewer, the difference is what was
    left out.  0 for a constant column.
    """
    varying = (np.abs(model.weights[:, model.ratios > 1e-12]) > 1e-12).any(axis=1).sum()  # a constant column has no variance
    variances = model.ratios * varying
    matrix = (model.weights * variances) @ model.weights.T
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(model.attributes) for j, b in enumerate(model.attributes)]
    return model.spark.createDataFrame(rows, "attribute string, other string, correlation double")


def attribute_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample variance of each column, as rows."""
    row = df.agg(*[F.var_samp(f"`{c}`").alias(c) for c in cols])
    return row.unpivot([], list(cols), "attribute", "variance")

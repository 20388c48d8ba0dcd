"""From a raw scan to the slice to study."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchlens.operators.coverage import drop_empty_columns, with_test_count
from batchlens.operators.roles import COUNTER, ROW_KEY, Roles, canonical_names, cast_roles, order_columns
from batchlens.sources.shared import settle


def focus_slice(df: DataFrame, first: str = "material_code", second: str = "component_code") -> DataFrame:
    """Rows of the busiest ``first`` code and, inside it, the busiest ``second`` code.

    One job counts pairs of codes and picks both; they enter the filter as
    literals, so it reaches the scan.
    """
    pairs = (
        df.filter(F.col(first).isNotNull())
        .groupBy(first, second)
        .agg(F.count(F.lit(1)).alias("batch_count"))
    )
    chosen = (
        pairs.withColumn("total", F.sum("batch_count").over(Window.partitionBy(first)))  # over counts, not rows
        .filter(F.col(second).isNotNull())
        .orderBy(F.desc("total"), first, F.desc("batch_count"), second)
        .limit(1)
        .collect()
    )
    if not chosen:
        return df.limit(0)
    return df.filter((F.col(first) == chosen[0][first]) & (F.col(second) == chosen[0][second]))


def curate(
    raw: DataFrame,
    renames: Mapping[str, str] | None = None,
    drop: Sequence[str] = (),
    roles: Roles = Roles(),
) -> DataFrame:
    """Canonical names, the busiest slice, no empty columns, a test count, identifiers first, types by role.

    Attributes stay as they came, so ``clean`` gets every digit of them.
    """
    df = settle(focus_slice(canonical_names(raw, renames).drop(*drop)))
    df = drop_empty_columns(df, roles.features(df))
    df = with_test_count(df, roles.features(df))
    first = [c for c in (*([ROW_KEY] if ROW_KEY in df.columns else []), *roles.ids, COUNTER)]
    return cast_roles(order_columns(df, first), roles, attribute_type=None)

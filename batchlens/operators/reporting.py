"""Bring scores, labels and raw rows together for people to look at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.functions import gaussian_draw, map_literal
from batchlens.operators.audit import require_unique
from batchlens.operators.fences import MULTIVARIATE, UNIVARIATE

CORE = "Core"
# The colour key of the three states, and of the two profile groups.
STATUS_COLOURS = {CORE: "#7f7f7f", UNIVARIATE: "red", MULTIVARIATE: "gold"}
PROFILE_COLOURS = {"Frequent": "#7f7f7f", "Rare": "#1f4e79"}


def attach(df: DataFrame, other: DataFrame, key: str = "row_key") -> DataFrame:
    """The columns of ``other`` beside those of ``df``, matched by row key and not by position.

    Refuses an ``other`` with repeated keys, which would multiply rows.
    """
    return df.join(require_unique(other, [key]), key)


def annotate_status(df: DataFrame, deviations: DataFrame, key: str = "row_key") -> DataFrame:
    """``status`` on every row: its deviation type, or ``Core`` when it was not flagged.

    ``deviations`` has one row per flagged key, so no row is multiplied.
    """
    flagged = deviations.select(key, F.col("deviation_type").alias("status"))
    return df.join(flagged, key, "left").withColumn("status", F.coalesce("status", F.lit(CORE)))


def with_colour(df: DataFrame, col: str = "status", colours=None) -> DataFrame:
    return df.withColumn("colour", map_literal(F.col(col), colours or STATUS_COLOURS))


def flagged_report(df: DataFrame, keys: DataFrame, source: str = "IsolationForest", key: str = "row_key") -> DataFrame:
    """Full rows of the flagged keys, headed by what flagged them; refuses a ``df`` with repeated keys."""
    require_unique(df, [key])
    full = keys.select(key).distinct().join(df, key)
    return full.select(F.lit(source).alias("flagged_by"), *df.columns)


def ordered_union(df: DataFrame, status: str = "status") -> DataFrame:
    """Flagged rows with ``draw_order`` 0, core rows with 1, in one table."""
    flagged = df.filter(F.col(status) != CORE).withColumn("draw_order", F.lit(0))
    return flagged.unionByName(df.filter(F.col(status) == CORE).withColumn("draw_order", F.lit(1)))


def jitter(df: DataFrame, cols: Sequence[str], sd: float, seed: int, key: str = "row_key") -> DataFrame:
    """``<col>_jittered``: the column plus Gaussian noise drawn from (seed, column, key)."""
    return df.withColumns(
        {
            f"{c}_jittered": F.col(f"`{c}`") + F.lit(sd) * gaussian_draw(seed, c, F.col(key))
            for c in cols
        }
    )


def projection_frame(
    df: DataFrame, cols: Sequence[str], by: str, sd: float = 0.03, seed: int = 42, key: str = "row_key"
) -> DataFrame:
    """A table ready to plot: key, group and the (jittered) axes; ``sd=0`` leaves the axes as they are."""
    if not sd:
        return df.select(key, by, *cols)
    return jitter(df, cols, sd, seed, key).select(key, by, *[f"{c}_jittered" for c in cols])

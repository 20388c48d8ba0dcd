"""How often exactly the same combination of attribute values occurs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.operators.ranking import category_code, global_rank, sent_if_few
from batchlens.sources.shared import stored


def profile_frequency(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per combination; a row with any missing value belongs to none."""
    return df.na.drop(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("frequency"))


def profile_counts(df: DataFrame, cols: Sequence[str], prefix: str = "CMA_Profile_") -> DataFrame:
    """``profile_frequency`` with an id by rank: 0 for the most frequent, ties by value."""
    ranked = global_rank(profile_frequency(df, cols), [F.desc("frequency"), *cols], "_rank")
    return ranked.select(
        *cols, "frequency", F.concat(F.lit(prefix), (F.col("_rank") - 1).cast("string")).alias("profile_id")
    )


def profile_spectrum(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How many combinations occur once, twice, …; the most frequent first."""
    return (
        profile_frequency(df, cols)
        .groupBy("frequency")
        .agg(F.count(F.lit(1)).alias("n_profiles"))
        .orderBy(F.desc("frequency"))
    )


def with_profile(df: DataFrame, profiles: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each row with the columns of its combination; null where the row has a missing value.

    Counting before joining keeps a dominating combination from landing in one
    window: its rows meet a single counted row, and the join can split them.
    """
    return df.join(profiles, list(cols), "left")


def profile_group(df: DataFrame, mode: str = "threshold", threshold: int = 5) -> DataFrame:
    """Name the group of a row that carries ``frequency`` (and ``profile_id``).

    ``threshold``: ``Frequent`` above it, else ``Rare``, a missing frequency included.
    ``singleton``: the profile id, and ``Rare_Profile`` for profiles met once.
    """
    if mode == "threshold":
        group = F.when(F.col("frequency") > threshold, "Frequent").otherwise("Rare")
    else:
        group = F.when(F.col("frequency") == 1, "Rare_Profile").otherwise(F.col("profile_id"))
    return df.withColumn("profile_group", group)


def frequent_or_rare(df: DataFrame, cols: Sequence[str], threshold: int = 5) -> DataFrame:
    """Every row with its profile, the profile's frequency and Frequent / Rare."""
    return profile_group(with_profile(df, profile_counts(df, cols), cols), threshold=threshold)


def coded_profiles(df: DataFrame, cols: Sequence[str], key: str = "row_key") -> DataFrame:
    """Every row with its profile group, singletons collapsed, and the group's integer code."""
    grouped = profile_group(with_profile(df, sent_if_few(profile_counts(df, cols)), cols), mode="singleton")
    return category_code(stored(grouped), "profile_group", key)

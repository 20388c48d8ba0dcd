"""From curated rows to a complete numeric table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from batchlens.functions import DECIMAL
from batchlens.operators.audit import refuse_bad_values
from batchlens.operators.cleaning import impute_median, normalize_precision, to_decimal, to_double
from batchlens.operators.coverage import prune_low_coverage
from batchlens.operators.roles import Roles, cast_roles
from batchlens.sources.shared import settle


def clean(
    df: DataFrame, roles: Roles = Roles(), frac: float = 0.6, kind: str = DECIMAL, refuse: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Decimals, coverage pruning, median imputation, precision recovery, doubles.

    Returns the table without its counters, and the (attribute, places) summary.
    Precision is measured after imputation, so imputed values have their vote.
    Values that are no decimal of type ``kind`` raise an error with their counts;
    with ``refuse=False`` they count as missing.
    """
    cols = roles.features(df)
    if refuse:
        refuse_bad_values(df, cols, kind)
    typed = to_decimal(cast_roles(df, roles, attribute_type=None), cols, kind)
    kept = settle(prune_low_coverage(typed, frac))
    rounded, summary = normalize_precision(impute_median(kept, cols), cols)
    return to_double(rounded, cols).drop(*[c for c in roles.counters if c in df.columns]), summary

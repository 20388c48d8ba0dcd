"""Which column plays which part: identifiers, the coverage counter, attributes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

IDS = ("material_code", "component_code", "material_batch_nr", "component_batch_nr")
COUNTER = "n_tests"
ROW_KEY = "row_key"


@dataclass(frozen=True)
class Roles:
    """Attributes are whatever is neither an identifier, a counter nor a key."""

    ids: tuple[str, ...] = IDS
    counters: tuple[str, ...] = (COUNTER, "imputed_tests")
    key: str = ROW_KEY

    def role_of(self, column: str) -> str:
        if column in self.ids:
            return "id"
        if column in self.counters:
            return "counter"
        return "key" if column == self.key else "attribute"

    def features(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if self.role_of(c) == "attribute"]


def canonical_names(df: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Apply ``renames``, then write every name in lower case with underscores."""
    renames = renames or {}
    mapping = {
        c: re.sub(r"[^0-9a-z]+", "_", renames.get(c, c).strip().lower()).strip("_")
        for c in df.columns
    }
    if len(set(mapping.values())) < len(mapping):
        raise ValueError("two columns would share one canonical name")
    return df.withColumnsRenamed(mapping)


def order_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """``first`` in front, everything else after it in its old order."""
    return df.select(*first, *[f"`{c}`" for c in df.columns if c not in first])


def prefix_columns(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def cast_roles(df: DataFrame, roles: Roles = Roles(), attribute_type: str | None = "double") -> DataFrame:
    """Identifiers to text, counters to int, attributes to ``attribute_type`` (None: as they are).

    Text that is blank or no number becomes null; ``audit_types`` counts the latter.
    """
    kinds = {"id": "string", "counter": "int", "attribute": attribute_type, "key": None}

    def typed(c: str) -> Column:
        kind = kinds[roles.role_of(c)]
        if kind is None:
            return F.col(f"`{c}`")
        if kind != "string" and isinstance(df.schema[c].dataType, StringType):
            return F.trim(F.col(f"`{c}`")).try_cast(kind).alias(c)
        return F.col(f"`{c}`").cast(kind).alias(c)

    return df.select(*map(typed, df.columns))

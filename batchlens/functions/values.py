"""Column expressions for cleaning and labelling single values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute values stay exact decimals from parsing to modelling: 20 digits
# before the point, 18 after it.
DECIMAL = "decimal(38,18)"


def missing_to_null(value: Column) -> Column:
    """NaN becomes null, so that counting and averaging agree on what is missing."""
    return F.when(~F.isnan(value), value)


def finite_only(value: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def parse_decimal(value: Column, kind: str = DECIMAL) -> Column:
    """Text or number as an exact decimal; blanks and unparsable text become null."""
    return F.trim(value.cast("string")).try_cast(kind)


def exact_double(value: Column) -> Column:
    """A decimal as the double nearest to it.

    Spark goes through text where the digits of a decimal fill more than 52 bits, as they do with
    18 places whatever the value.  What 15 digits hold exactly is divided instead, with the same result.
    """
    short = value.try_cast("decimal(15,4)")
    return F.when(short.isNotNull() & (short == value), short.cast("double")).otherwise(value.cast("double"))


def decimal_places(value: Column, kind: str = DECIMAL) -> Column:
    """Digits after the point once trailing zeros are gone; 0 for whole numbers.

    Only the fraction matters, and adding 1 to it keeps its text free of
    scientific notation (``1.0001`` rather than ``1E-4``).  ``kind`` is the type of a
    decimal column; other values are read as one.
    """
    text = (F.abs(value.cast(kind)) % F.lit(1) + F.lit(1)).cast("string")
    return F.when(
        value.isNotNull(),
        F.length(F.regexp_extract(F.regexp_replace(text, "0+$", ""), "[.](.*)$", 1)),
    )


def round_half_up(value: Column, places: int, kind: str = DECIMAL) -> Column:
    """Round a decimal of type ``kind`` half away from zero; the same type comes out."""
    return F.round(value.cast(kind), places).cast(kind)


def present_count(columns: Sequence[str]) -> Column:
    """How many of ``columns`` are not null in this row."""
    flags = F.array(*[F.col(f"`{c}`").isNotNull() for c in columns])
    if len(columns) > 100:
        # One small loop instead of an expression hundreds of terms deep.
        return F.size(F.filter(flags, lambda f: f)).cast("int")
    total = F.lit(0)
    for c in columns:
        total = total + F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0)
    return total.cast("int")


def percent_label(count: Column, total: int) -> Column:
    """``count`` as a share of ``total``, as text such as ``67%`` (ties to even)."""
    share = count.cast("double") / F.lit(float(total)) * F.lit(100.0)
    return F.concat(F.bround(share, 0).cast("int").cast("string"), F.lit("%"))


def component_label(index: Column, ratio: Column) -> Column:
    """Axis text: ``PC 1 (41.3%)``."""
    return F.format_string("PC %d (%.1f%%)", index, ratio * F.lit(100.0))


def map_literal(value: Column, pairs: Mapping[str, str]) -> Column:
    """Look a category up in a small fixed table; null when it is not there."""
    literals = [F.lit(x) for x in chain.from_iterable(pairs.items())]
    return F.when(value.isNotNull(), F.create_map(*literals)[value])

from batchlens.functions.draws import gaussian_draw, hash_text, uniform_draw
from batchlens.functions.values import (
    DECIMAL,
    component_label,
    decimal_places,
    exact_double,
    finite_only,
    map_literal,
    missing_to_null,
    parse_decimal,
    percent_label,
    present_count,
    round_half_up,
)

__all__ = [
    "DECIMAL",
    "component_label",
    "decimal_places",
    "exact_double",
    "finite_only",
    "gaussian_draw",
    "hash_text",
    "map_literal",
    "missing_to_null",
    "parse_decimal",
    "percent_label",
    "present_count",
    "round_half_up",
    "uniform_draw",
]

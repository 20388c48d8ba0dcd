"""Exact order statistics by counting, with no global sort.

A sketch names a narrow range around each wanted rank, and a count of the rows
below and inside it proves or refutes that the rank lies there.  A range that
holds too many rows, or a refuted one widened to the whole column, is narrowed by
histograms.  What is left fits in a task and is looked at value by value.
Repeated values are counted, not carried, so a value that makes up a third of the
table is one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal, localcontext
from functools import reduce
from itertools import pairwise
from math import ceil, floor, isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from batchlens.functions import exact_double, finite_only
from batchlens.sources.shared import settle

_BINS = 1024
_EXAMINE = 1 << 17  # rows of one range that are ranked value by value
_PRECISION = 80  # digits of decimal arithmetic on the driver, for any two decimals of 38
_GROUP_EXAMINE = 1 << 14  # values of one group that are ranked together
_GROUP_POINTS = tuple(i / 64 for i in range(1, 64))  # where a larger group is cut
_SKETCH = 1 << 13  # ``k`` of the sketch: ranks are off by 2.296 / k^0.9021 of the rows, with 99 % confidence
_MARGIN = 0.001
_FEW = 50_000  # rows of a lookup that are sent to every task


@dataclass
class _Range:
    """Values of ``col`` in [low, high]: how many there are and how many lie below."""

    col: str
    low: object
    high: object
    below: int
    size: int
    ranks: set[int] = field(default_factory=set)  # 0-based, within the whole column


def order_statistics(
    df: DataFrame, ranks_of: Callable[[int], set[int]], cols: Sequence[str], ps: Sequence[float] = (), examine: int = _EXAMINE
) -> tuple[dict[str, int], dict[tuple[str, int], object]]:
    """Values at given ranks of many columns at once.

    ``ranks_of(n)`` names the 0-based ranks wanted in a column of ``n`` values;
    ``ps`` are about the same places as fractions, where the sketch looks.
    Null, NaN and infinite values do not count.  Returns the column sizes and
    the value at every (column, rank).
    """
    df = df.select(*[
        F.col(f"`{c}`").alias(c) if isinstance(df.schema[c].dataType, DecimalType)
        else finite_only(F.col(f"`{c}`").cast("double")).alias(c)
        for c in cols
    ])
    near = sorted({min(max(p + d, 0.0), 1.0) for p in ps for d in (-_MARGIN, _MARGIN)})
    ends = df.agg(
        F.array(*[F.count(f"`{c}`") for c in cols]).alias("n"),
        F.array(*[F.min(f"`{c}`") for c in cols]).alias("low"),
        F.array(*[F.max(f"`{c}`") for c in cols]).alias("high"),
    ).first()
    sizes = dict(zip(cols, ends["n"]))
    found: dict[tuple[str, int], object] = {}
    open_ranges = [
        _Range(c, low, high, 0, n, set(ranks_of(n)))
        for c, n, low, high in zip(cols, ends["n"], ends["low"], ends["high"])
        if n
    ]
    if near and any(r.size > examine for r in open_ranges):
        sketched = _sketched(df, [r.col for r in open_ranges], near)
        ends_of = {r.col: (r.low, r.high) for r in open_ranges}
        points = {
            c: [_as_type(x, df.schema[c].dataType, *ends_of[c]) for x in values]
            for c, values in sketched.items()
        }
        open_ranges = _proven(df, open_ranges, points)
    final: list[_Range] = []
    while open_ranges:
        wide = [r for r in open_ranges if r.size > examine and r.low != r.high]
        final += [r for r in open_ranges if r not in wide]
        parents = {(r.col, r.low, r.high, r.size) for r in wide}
        open_ranges = _split(df, wide, found) if wide else []
        # a range of values too close to be told apart by a bin is ranked as it is
        final += [r for r in open_ranges if (r.col, r.low, r.high, r.size) in parents]
        open_ranges = [r for r in open_ranges if (r.col, r.low, r.high, r.size) not in parents]
    _rank_values(df, final, found)
    return sizes, found


def _sketched(df: DataFrame, cols: Sequence[str], ps: Sequence[float]) -> dict[str, list[float]]:
    """Values near the ranks ``ps`` of each column; all columns hold some value.

    A pass of its own: beside a sketch, the other aggregates would not be compiled, and neither
    would the conversion of decimals inside the sketch.
    """
    double = lambda c: exact_double(F.col(f"`{c}`")) if isinstance(df.schema[c].dataType, DecimalType) else F.col(f"`{c}`")
    held = df.select(*[double(c).alias(c) for c in cols]).agg(*[F.kll_sketch_agg_double(F.col(f"`{c}`"), _SKETCH).alias(c) for c in cols])
    points = [F.array(*[F.kll_sketch_get_quantile_double(F.col(f"`{c}`"), F.lit(p)) for p in ps]) for c in cols]
    return dict(zip(cols, held.select(F.array(*points)).first()[0]))


def _as_type(value: float, kind, low, high):
    """A sketch point in the type of its column, inside its range: any point will do, a value of the column does best."""
    if not isinstance(kind, DecimalType):
        return value
    with localcontext() as context:
        context.prec = _PRECISION
        return min(max(Decimal(repr(value)).quantize(Decimal(1).scaleb(-kind.scale)), low), high)


def _place(r: _Range) -> Column:
    """Where ``x`` lies in a range, from 0 to 1 and never falling as ``x`` grows.

    Halves keep the width of any two doubles finite.  Decimals that share a double
    are told apart by their distance from the lower end, which is small and exact.
    """
    x, low, high = F.col("x"), float(r.low) / 2, float(r.high) / 2
    if isinstance(r.low, Decimal) and high - low <= 1e-9 * max(abs(low), abs(high)):
        with localcontext() as context:
            context.prec = _PRECISION
            width = float(r.high - r.low)
        return (x - F.lit(r.low)).cast("double") / F.lit(width)
    return (x.cast("double") / 2 - F.lit(low)) / F.lit(high - low)


def _proven(df: DataFrame, whole: list[_Range], near: dict[str, list]) -> list[_Range]:
    """Ranges that surely hold the wanted ranks: the smallest of the sketch points and the gaps between them.

    The point itself is the answer for a value that is repeated often enough.
    """
    guesses = []
    for r in whole:
        points = sorted({r.low, r.high, *near[r.col]})
        guesses += [_Range(r.col, a, b, 0, 0) for a, b in [*zip(points, points), *pairwise(points)]]
    column = lambda g: F.col(f"`{g.col}`")
    counts = df.agg(
        F.array(*[F.count_if(column(g) < F.lit(g.low)) for g in guesses]).alias("below"),
        F.array(*[F.count_if(column(g) <= F.lit(g.high)) for g in guesses]).alias("upto"),
    ).first()
    kept: list[_Range] = []
    for r in whole:
        left = set(r.ranks)
        mine = [(g, b, u) for g, b, u in zip(guesses, counts["below"], counts["upto"]) if g.col == r.col]
        for g, below, upto in sorted(mine, key=lambda m: m[2] - m[1]):  # smallest ranges first
            inside = {k for k in left if below <= k < upto}
            if inside:
                kept.append(_Range(g.col, g.low, g.high, below, upto - below, inside))
                left -= inside
    return kept


def _tagged(df: DataFrame, ranges: list[_Range]) -> DataFrame:
    """Long form: (range number, value) for each value inside a range; rows in no range drop out first."""
    inside = [F.col(f"`{r.col}`").between(F.lit(r.low), F.lit(r.high)) for r in ranges]
    picks = [F.when(hit, F.struct(F.lit(i).alias("t"), F.col(f"`{r.col}`").alias("x"))) for i, (r, hit) in enumerate(zip(ranges, inside))]
    near = df.filter(reduce(lambda a, b: a | b, inside))
    return near.select(F.explode(F.array(*picks)).alias("v")).filter("v is not null").select("v.t", "v.x")


def _split(df: DataFrame, ranges: list[_Range], found: dict) -> list[_Range]:
    place = F.lit(0.0)
    for i, r in enumerate(ranges):
        place = F.when(F.col("t") == i, _place(r)).otherwise(place)
    bins = (
        _tagged(df, ranges)
        .groupBy("t", F.least(F.floor(place * _BINS), F.lit(_BINS - 1)).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        .orderBy("t", "b")
        .collect()  # at most _BINS rows for each range
    )
    by_range: dict[int, list] = {}
    for row in bins:
        by_range.setdefault(row["t"], []).append(row)
    narrower = []
    for t, r in enumerate(ranges):
        below = r.below
        for row in by_range[t]:
            inside = {k for k in r.ranks if below <= k < below + row["n"]}
            # The ends of a bin are known without looking further.
            for k in list(inside):
                if row["low"] == row["high"] or k == below:
                    found[r.col, k] = row["low"]
                    inside.discard(k)
                elif k == below + row["n"] - 1:
                    found[r.col, k] = row["high"]
                    inside.discard(k)
            if inside:
                narrower.append(_Range(r.col, row["low"], row["high"], below, row["n"], inside))
            below += row["n"]
    return narrower


def _rank_values(df: DataFrame, ranges: list[_Range], found: dict) -> None:
    for r in [r for r in ranges if r.low == r.high]:
        found.update({(r.col, k): r.low for k in r.ranks})
    ranges = [r for r in ranges if r.low != r.high and r.ranks]
    if not ranges:
        return
    # At most ``examine`` rows per window, or values that share a double: _split saw to it.
    running = Window.partitionBy("t").orderBy("x")
    wanted = F.element_at(
        F.array(*[F.array(*[F.lit(k - r.below).cast("bigint") for k in sorted(r.ranks)]) for r in ranges]), F.col("t") + 1
    )
    rows = (
        _tagged(df, ranges)
        .groupBy("t", "x")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(running))
        .filter(F.exists(wanted, lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n"))))
        .collect()
    )
    for row in rows:
        r = ranges[row["t"]]
        for k in r.ranks:
            if row["upto"] - row["n"] <= k - r.below < row["upto"]:
                found[r.col, k] = row["x"]


def quantile_values(
    df: DataFrame, cols: Sequence[str], ps: Sequence[float], examine: int = _EXAMINE
) -> dict[tuple[str, float], float | None]:
    """Exact quantiles with linear interpolation between neighbours; None for an empty column."""
    def ranks(n: int):
        return {edge((n - 1) * p) for p in ps for edge in (floor, ceil)}

    sizes, found = order_statistics(df, ranks, cols, ps, examine)
    values: dict[tuple[str, float], float | None] = {}
    for c in cols:
        for p in ps:
            if not sizes[c]:
                values[c, p] = None
                continue
            place = (sizes[c] - 1) * p
            low, high = float(found[c, floor(place)]), float(found[c, ceil(place)])
            part = place - floor(place)
            step = high - low
            values[c, p] = low + step * part if isfinite(step) else low * (1 - part) + high * part
    return values


def quantiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float], examine: int = _EXAMINE) -> DataFrame:
    """``quantile_values`` as rows (attribute, p, value)."""
    values = quantile_values(df, cols, ps, examine)
    return df.sparkSession.createDataFrame(
        [(c, float(p), v) for (c, p), v in values.items()], "attribute string, p double, value double"
    )


def sent_if_few(lookup: DataFrame) -> DataFrame:
    """A lookup of few rows, as counted, goes to every task: a checkpoint does not know its size, and Spark would exchange the rows to learn it."""
    return F.broadcast(lookup) if lookup.count() <= _FEW else lookup


def grouped_quantiles(df: DataFrame, by: str, col: str, ps: Sequence[float], examine: int = _GROUP_EXAMINE) -> DataFrame:
    """``by, n, quantiles``: exact quantiles of ``col`` in every group, any number of groups of any size.

    Groups of up to ``examine`` values are ranked by counts of their values.  Larger ones are
    cut at points that a sketch of the group names; counts of the rows at and between the
    points prove which gap holds a wanted rank, and only the rows of such gaps go on to the
    next round, where a gap is what a group was.  Points are values of the group, so each
    round leaves fewer values, and a value that is repeated often becomes a point itself.
    Null and non-finite values do not count; the null group is a group.
    """
    # in a struct, nulls equal each other in joins
    rows = df.select(F.struct(F.col(f"`{by}`").alias("g")).alias("by"), finite_only(F.col(f"`{col}`").cast("double")).alias("x"))
    rows = rows.filter("x is not null").withColumn("part", F.lit(0).cast("bigint"))
    places = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(p))).alias("at")) for i, p in enumerate(ps)])
    sizes = settle(rows.groupBy("by").agg(F.count(F.lit(1)).alias("n")))
    placed = sizes.select("by", "n", F.inline(places))
    ranks = placed.select("by", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    wanted = settle(ranks.select("by", F.lit(0).cast("bigint").alias("part"), "rank", F.col("rank").alias("place")))
    found, within = [], (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n"))
    while True:
        parts = settle(rows.groupBy("by", "part").agg(F.count(F.lit(1)).alias("size"), F.min("x").alias("low"), F.max("x").alias("high")))
        large = parts.filter((F.col("size") > examine) & (F.col("low") < F.col("high"))).select("by", "part", "low", "high")
        # sent to the rows, where they are few; else one task may get all rows of a group
        small = sent_if_few(parts.filter((F.col("size") <= examine) | (F.col("low") == F.col("high"))).select("by", "part"))
        ranked = rows.join(small, ["by", "part"])
        found.append(wanted.join(_started(ranked, "x"), ["by", "part"]).filter(within).select("by", "rank", "x"))
        if large.isEmpty():
            break
        held = rows.join(sent_if_few(large), ["by", "part"])
        points = F.array_sort(F.array_distinct(F.concat(F.percentile_approx("x", list(_GROUP_POINTS), 2000), F.array(F.first("low"), F.first("high")))))
        cuts = settle(held.groupBy("by", "part").agg(points.alias("points")))
        met = F.size(F.filter("points", lambda p: p <= F.col("x")))
        # 2k: the k-th point itself, 2k + 1: the gap after it
        slot = 2 * met + F.when(F.element_at("points", met) == F.col("x"), 0).otherwise(1)
        slotted = rows.join(sent_if_few(cuts), ["by", "part"]).withColumn("slot", slot)
        hit = settle(wanted.join(_started(slotted, "slot"), ["by", "part"]).filter(within))
        at_point = hit.filter("slot % 2 = 0").join(cuts, ["by", "part"])
        found.append(at_point.select("by", "rank", F.element_at("points", F.floor(F.col("slot") / 2).cast("int")).alias("x")))
        gaps = hit.filter("slot % 2 = 1")
        next_part = (F.col("part") * 256 + F.col("slot")).alias("part")
        open_ = sent_if_few(gaps.select("by", "part", "slot").distinct())
        rows = settle(slotted.join(open_, ["by", "part", "slot"]).select("by", "x", next_part))
        wanted = settle(gaps.select("by", next_part, "rank", (F.col("place") - F.col("start")).alias("place")))
    values = settle(reduce(DataFrame.unionByName, found))
    edge = lambda name: values.select("by", F.col("rank").alias(f"_{name}"), F.col("x").alias(name))
    ends = placed.withColumns({"_low": F.floor("at"), "_high": F.ceil("at")}).join(edge("low"), ["by", "_low"]).join(edge("high"), ["by", "_high"])
    step, share = F.col("high") - F.col("low"), F.col("at") - F.floor("at")
    one = F.when(F.abs(step) < float("inf"), F.col("low") + step * share).otherwise(F.col("low") * (1 - share) + F.col("high") * share)
    each = ends.groupBy("by", "n").agg(F.array_sort(F.collect_list(F.struct("i", one.alias("v")))).alias("v"))  # one entry a wanted quantile
    return each.select(F.col("by.g").alias(by), "n", F.col("v.v").alias("quantiles"))


def _started(rows: DataFrame, of: str) -> DataFrame:
    """``n`` rows for each value of ``of`` in a part of a group, and how many come before it."""
    order = Window.partitionBy("by", "part").orderBy(of)
    counts = rows.groupBy("by", "part", of).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("start", F.sum("n").over(order) - F.col("n"))


def approx_quantiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float], accuracy: int = 10000) -> DataFrame:
    """One pass and a bounded sketch instead of exact ranks, where an estimate will do."""
    row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), list(ps), accuracy).alias(c) for c in cols]).first()
    return df.sparkSession.createDataFrame(
        [(c, float(p), v) for c in cols for p, v in zip(ps, row[c] or [None] * len(ps))],
        "attribute string, p double, value double",
    )


def sketch_size(accuracy: float) -> int:
    """``k`` of a KLL sketch whose rank error, at 99 % confidence 2.296 / k^0.9021, is a third of ``accuracy``."""
    size = ceil((3 * 2.296 / accuracy) ** (1 / 0.9021)) if 0 < accuracy < 1 else 0
    if not 0 < size <= 65535:
        raise ValueError(f"no sketch has an accuracy of {accuracy}")
    return max(size, 8)


def quantile_sketches(df: DataFrame, cols: Sequence[str], accuracy: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """``by…, attribute, sketch``: a mergeable sketch of each column, for every batch that ``by`` names.

    Made to be stored: the sketches of a new batch are added to those that are there, and
    ``sketch_quantiles`` reads quantiles of any set of batches without their rows.  Null and
    non-finite values do not count.  Tasks merge sketches before anything is exchanged.
    """
    size = sketch_size(accuracy)
    sketches = [F.kll_sketch_agg_double(finite_only(F.col(f"`{c}`").cast("double")), size).alias(c) for c in cols]
    keys = [F.col(f"`{b}`") for b in by]
    return df.groupBy(*keys).agg(*sketches).unpivot(keys, list(cols), "attribute", "sketch").filter("sketch is not null")


def sketch_quantiles(sketches: DataFrame, ps: Sequence[float]) -> DataFrame:
    """``attribute, p, n, value``: quantiles of all values behind the sketches of an attribute; none for an empty column."""
    filled = sketches.filter(F.kll_sketch_get_n_double("sketch") > 0)
    merged = filled.groupBy("attribute").agg(F.kll_merge_agg_double("sketch").alias("s"))
    value = lambda p: F.kll_sketch_get_quantile_double("s", F.lit(p))
    rows = F.array(*[F.struct(F.lit(p).alias("p"), value(p).alias("value")) for p in map(float, ps)])
    return merged.select("attribute", F.kll_sketch_get_n_double("s").alias("n"), F.inline(rows)).select("attribute", "p", "n", "value")


def rank_errors(df: DataFrame, estimates: DataFrame) -> DataFrame:
    """``attribute, p, n, value, error``: how far, as a share of all values, each estimate's rank lies from ``p``.

    Counted exactly, in one pass over the table.  A value that stands for several ranks is
    right for all of them.  ``estimates`` has a row per attribute and p (columns attribute, p, value).
    """
    asked = estimates.select("attribute", "p", "value").collect()  # a row per attribute and p
    counts = []
    for i, r in enumerate(asked):
        x = finite_only(F.col(f"`{r['attribute']}`").cast("double"))
        counts += [F.count(x).alias(f"n{i}"), F.count_if(x < r["value"]).alias(f"b{i}"), F.count_if(x <= r["value"]).alias(f"u{i}")]
    rows = []
    if asked:
        found = df.agg(*counts).first()
        for i, r in enumerate(asked):
            n, below, upto = (found[f"{c}{i}"] for c in "nbu")
            rows.append((r["attribute"], r["p"], n, r["value"], max(below / n - r["p"], r["p"] - upto / n, 0.0) if n else None))
    return df.sparkSession.createDataFrame(rows, "attribute string, p double, n bigint, value double, error double")


def median_values(df: DataFrame, cols: Sequence[str], examine: int = _EXAMINE) -> dict[str, Decimal | None]:
    """Median of decimal columns in decimal arithmetic: the middle value, or the mean of the two."""
    sizes, found = order_statistics(df, lambda n: {(n - 1) // 2, n // 2}, cols, [0.5], examine)
    medians: dict[str, Decimal | None] = {}
    for c in cols:
        n, kind = sizes[c], df.schema[c].dataType
        if not n:
            medians[c] = None
            continue
        with localcontext() as context:
            context.prec = _PRECISION
            middle = (found[c, (n - 1) // 2] + found[c, n // 2]) / 2
            medians[c] = middle.quantize(Decimal(1).scaleb(-kind.scale), ROUND_HALF_UP)
    return medians


def decimal_median(df: DataFrame, cols: Sequence[str], examine: int = _EXAMINE) -> DataFrame:
    """``median_values`` as rows (attribute, median)."""
    medians = median_values(df, cols, examine)
    kind = df.schema[cols[0]].dataType.simpleString()
    return df.sparkSession.createDataFrame(list(medians.items()), f"attribute string, median {kind}")

"""Cutoffs, labels, and how far they hold when the forest or the sample changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from batchlens.functions import finite_only
from batchlens.operators.forest import IsolationForest
from batchlens.operators.quantiles import grouped_quantiles, quantile_values, sent_if_few
from batchlens.operators.ranking import sample_flags
from batchlens.sources.shared import settle

_WORD = 62  # labels packed into one number


def label_outliers(
    scores: DataFrame,
    contamination: float,
    col: str = "decision",
    sampled: str | None = None,
    name: str = "label",
) -> DataFrame:
    """-1 below the ``contamination`` quantile of the decision values, else 1.

    The quantile is taken over the rows the forest was grown from (``sampled``),
    the label is given to every row.
    """
    known = scores.filter(sampled) if sampled else scores
    offset = quantile_values(known, [col], [contamination])[col, contamination]
    return scores.withColumn(name, F.when(F.col(col) < F.lit(offset), -1).otherwise(1))


def outlier_keys(labels: DataFrame, key: str = "row_key", label: str = "label") -> DataFrame:
    """The keys labelled -1, each with the total."""
    total = labels.agg(F.count_if(F.col(label) == -1)).scalar()
    return labels.filter(F.col(label) == -1).select(key, total.alias("n_outliers"))


def select_outliers(df: DataFrame, keys: DataFrame, key: str = "row_key") -> DataFrame:
    """The rows of ``df`` whose key is in ``keys``."""
    return df.join(keys.select(key), key, "left_semi")


def param_grid(spark, **values: Sequence) -> DataFrame:
    """Every combination of a few parameter values, one column per parameter."""
    grid = spark.range(1).select()
    for name, choices in values.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in choices])).alias(name))
    return grid


def score_summary(scores: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum, maximum, median and sample deviation of each score column."""
    finite = scores.select(*[finite_only(F.col(c)).alias(c) for c in cols])
    medians = quantile_values(finite, cols, [0.5])
    row = finite.agg(
        *[
            F.struct(
                F.min(c).alias("score_min"),
                F.max(c).alias("score_max"),
                F.lit(medians[c, 0.5]).alias("score_median"),
                F.stddev_samp(c).alias("score_std"),
            ).alias(c)
            for c in cols
        ]
    )
    return row.unpivot([], list(cols), "scores", "s").select("scores", "s.*")


def score_range(scores: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The smallest and the largest score over all columns, for a common axis."""
    each = scores.agg(
        F.array(*[F.min(finite_only(F.col(c))) for c in cols]).alias("low"),
        F.array(*[F.max(finite_only(F.col(c))) for c in cols]).alias("high"),
    )
    return each.select(F.array_min("low").alias("global_min"), F.array_max("high").alias("global_max"))


def contamination_grid(
    scores: DataFrame, sizes: Sequence[int], contaminations: Sequence[float], prefix: str = "decision_"
) -> DataFrame:
    """For each forest size and contamination: rows strictly below the quantile, and the score summary.

    All cutoffs come from one call.  A score's place among its forest's sorted cutoffs tells
    which of them it lies below, so rows are counted by place, whatever the number of cells,
    and the grid meets these few counts in a join.
    """
    sizes, contaminations = list(dict.fromkeys(sizes)), list(dict.fromkeys(contaminations))
    cols = [f"{prefix}{s}" for s in sizes]
    finite = scores.select(*[finite_only(F.col(c)).alias(c) for c in cols])
    cut = quantile_values(finite, cols, list(contaminations))
    spark, cells, places = scores.sparkSession, [], []
    for size, col in zip(sizes, cols):
        known = sorted({cut[col, c] for c in contaminations} - {None})
        # a score below the k-th cutoff has at most k cutoffs that it reaches
        cells += [(size, float(c), cut[col, c], known.index(cut[col, c]) if known else -1) for c in contaminations]
        reached = F.filter(F.array(*map(F.lit, known)), lambda q: q <= F.col(col)) if known else F.array()
        places.append(F.struct(F.lit(size).alias("n_estimators"), F.when(F.col(col).isNotNull(), F.size(reached)).alias("reached")))
    cutoffs = spark.createDataFrame(cells, "n_estimators int, contamination double, cutoff double, place int")
    grid = param_grid(spark, n_estimators=list(sizes), contamination=[float(c) for c in contaminations]).join(cutoffs, ["n_estimators", "contamination"])
    counted = finite.select(F.inline(F.array(*places))).filter("reached is not null").groupBy("n_estimators", "reached").agg(F.count(F.lit(1)).alias("n"))
    below = grid.join(
        counted.withColumnRenamed("n_estimators", "_size"), (F.col("_size") == F.col("n_estimators")) & (F.col("reached") <= F.col("place")), "left"
    )
    flagged = below.groupBy("contamination", "n_estimators").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("outliers_flagged"))
    named = F.create_map(*[x for s, c in zip(sizes, cols) for x in (F.lit(c), F.lit(s))])
    summary = score_summary(finite, cols).select(F.element_at(named, F.col("scores")).alias("n_estimators"), "score_min", "score_max", "score_median", "score_std")
    return flagged.join(summary, "n_estimators").select(
        "contamination", "n_estimators", "outliers_flagged", "score_min", "score_max", "score_median", "score_std"
    ).orderBy("n_estimators", "contamination")


def estimator_sweep(
    scores: DataFrame, sizes: Sequence[int], contaminations: Sequence[float], prefix: str = "decision_"
) -> DataFrame:
    """Rows labelled -1 for each forest size and contamination."""
    return contamination_grid(scores, sizes, contaminations, prefix).select(
        "contamination", "n_estimators", "outliers_flagged"
    ).orderBy("contamination", "n_estimators")


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1.0) / 2.0


def _rand_index(sum_cells: Column, sum_a: Column, sum_b: Column, n: Column) -> Column:
    expected = sum_a * sum_b / _pairs(n)
    best = (sum_a + sum_b) / 2.0
    # Two labelings that each put all rows together, or all rows apart, agree.
    return F.when(n < 2, 1.0).when(best == expected, 1.0).otherwise((sum_cells - expected) / (best - expected))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings of the same rows, as one row."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.cube("a", "b").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("g")
    )
    total = lambda g: F.sum(F.when(F.col("g") == g, _pairs(F.col("n"))).otherwise(0.0))
    sums = sides.agg(
        total(0).alias("cells"), total(1).alias("a"), total(2).alias("b"), F.max("n").alias("n")
    )
    return sums.select(_rand_index(F.col("cells"), F.col("a"), F.col("b"), F.col("n")).alias("ari"))


def stability_pairs(
    labels: DataFrame, runs: Sequence, run: str = "seed", key: str = "row_key", by: Sequence[str] = ("contamination",), label: str = "label"
) -> DataFrame:
    """Adjusted Rand index of every pair of runs, from long labels (key, run, *by, label).

    A row's labels over all runs are packed into bits, rows with the same bits are
    counted, and the pairs are formed from those counts; rows are never paired with
    each other or repeated per pair.  Rows that repeat a run count once, and are -1
    there if any of them is.
    """
    place = F.array_position(F.array(*map(F.lit, runs)), F.col(run)).cast("int") - 1
    mine = (F.col(label) == -1) & (place >= 0)
    words = [
        F.bit_or(F.when(mine & (F.floor(place / _WORD) == w), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(_WORD)))).otherwise(F.lit(0).cast("bigint")))
        for w in range(-(-len(runs) // _WORD))
    ]
    return pattern_pairs(labels.groupBy(key, *by).agg(F.array(*words).alias("pattern")), runs, by)


def _packed(marks: Sequence[Column]) -> Column:
    """Booleans as bits, ``_WORD`` to a number."""
    bit = lambda mark, i: F.when(mark, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    words = [marks[w : w + _WORD] for w in range(0, len(marks), _WORD)]
    return F.array(*[reduce(lambda a, b: a + b, [bit(m, i) for i, m in enumerate(word)]) for word in words])


def pattern_pairs(packed: DataFrame, runs: Sequence, by: Sequence[str] = ("contamination",)) -> DataFrame:
    """``stability_pairs`` from rows that already carry ``pattern``, an array of words: bit i is set where run i said -1.

    How often two runs both say -1 is a product of the counted patterns' bits with
    themselves.  A task adds it up over the patterns it holds and sends a row a pair.
    """
    counted = packed.groupBy(*by, "pattern").agg(F.count(F.lit(1)).alias("n"))
    left, right = np.triu_indices(len(runs), 1)

    def tally(batches):
        sums: dict = {}
        for batch in batches:
            n = batch.column("n").to_numpy().astype(float)
            words = batch.column("pattern").flatten().to_numpy().reshape(batch.num_rows, -1)
            bits = np.concatenate([(words[:, w, None] >> np.arange(_WORD)) & 1 for w in range(words.shape[1])], axis=1)[:, : len(runs)].astype(float)
            groups = [tuple(row.values()) for row in batch.select(list(by)).to_pylist()] if by else [()] * batch.num_rows
            for group in set(groups):
                mine = np.array([g == group for g in groups])
                both = (bits[mine] * n[mine, None]).T @ bits[mine]  # whole numbers below 2 ** 53
                total, held = sums.get(group, (0, 0))
                sums[group] = total + n[mine].sum(), held + both
        for group, (total, both) in sums.items():
            alone, size = np.diag(both), len(left)
            columns = {c: pa.array([v] * size, kinds[c]) for c, v in zip(by, group)}
            counts = {"n": np.full(size, total), "na": alone[left], "nb": alone[right], "nab": both[left, right]}
            columns |= {"a": left.astype(np.int32), "b": right.astype(np.int32)} | {c: v.astype(np.int64) for c, v in counts.items()}
            yield pa.RecordBatch.from_pydict(columns)

    kinds = {f.name: f.type for f in to_arrow_schema(counted.select(*by).schema)} if by else {}
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in counted.select(*by).schema] if by else []
    each = counted.mapInArrow(tally, ", ".join([*fields, "a int, b int, n bigint, na bigint, nb bigint, nab bigint"]))
    cells = each.groupBy(*by, "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "na", "nb", "nab")])
    names = F.array(*[F.lit(str(r)) for r in runs])
    pair = F.concat_ws("-", F.element_at(names, F.col("a") + 1), F.element_at(names, F.col("b") + 1))
    n, na, nb, nab = (F.col(c) for c in ("n", "na", "nb", "nab"))
    both = _pairs(nab) + _pairs(na - nab) + _pairs(nb - nab) + _pairs(n - na - nb + nab)
    ari = _rand_index(both, _pairs(na) + _pairs(n - na), _pairs(nb) + _pairs(n - nb), n)
    return cells.select(*by, pair.alias("seed_pair"), ari.alias("ari")).orderBy(*by, "seed_pair")


def seed_stability(
    df: DataFrame,
    cols: Sequence[str],
    seeds: Sequence[int] = tuple(range(10, 110, 10)),
    contaminations: Sequence[float] = (0.03, 0.05),
    frac: float = 0.8,
    trees: int = 400,
    key: str = "row_key",
    **forest,
) -> DataFrame:
    """Grow a forest per seed on a fresh sample, label every row, compare all pairs of seeds.

    The contamination moves only the cutoff, so each seed's forest serves all of
    them.
    """
    n = df.count()
    flags = {seed: f"in_{i}" for i, seed in enumerate(seeds)}
    flagged = settle(sample_flags(df.select(key, *cols), round(frac * n), {f: s for s, f in flags.items()}, key, n))
    both = settle(IsolationForest(trees=trees, **forest).fit_score_seeds(flagged, cols, flags, key, keep=True))
    # Cutoffs come from the rows a seed was grown on, labels go to all rows.
    known = both.select(*[F.when(F.col(f), F.col(f"decision_{s}")).alias(f"d{s}") for s, f in flags.items()])
    cut = quantile_values(known, [f"d{s}" for s in seeds], contaminations)
    patterns = [
        F.struct(F.lit(c).alias("contamination"), _packed([F.col(f"decision_{s}") < F.lit(cut[f"d{s}", c]) for s in seeds]).alias("pattern"))
        for c in contaminations
    ]
    return pattern_pairs(both.select(F.inline(F.array(*patterns))), seeds)


def stability_summary(pairs: DataFrame) -> DataFrame:
    """Median index per contamination; the input has one row per pair of seeds."""
    return (
        pairs.groupBy("contamination")
        .agg(F.percentile("ari", F.lit(0.5)).alias("median_ari"))
        .orderBy("contamination")
    )


def histogram(df: DataFrame, col: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Counts over ``bins`` equal ranges between the smallest and largest value; the last includes its end.

    With ``by`` a histogram per group, all on the same ranges.
    """
    value = finite_only(F.col(col))
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        low = high = 0.0
    width = (high - low) or 1.0
    place = F.floor((value - F.lit(low)) / F.lit(width) * F.lit(bins))
    return (
        df.filter(value.isNotNull())
        .groupBy(*by, F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns(
            {
                "bin_from": F.lit(low) + F.col("bin") * F.lit(width / bins),
                "bin_to": F.lit(low) + (F.col("bin") + 1) * F.lit(width / bins),
            }
        )
        .orderBy(*by, "bin")
    )


def histogram_grid(
    scores: DataFrame, sizes: Sequence[int], contaminations: Sequence[float], bins: int = 30, prefix: str = "decision_"
) -> DataFrame:
    """For each forest size and contamination: the histogram of the scores, and the cutoff to draw into it.

    All histograms share their ranges, and are counted in one pass over all forests.
    """
    sizes, contaminations = list(dict.fromkeys(sizes)), list(dict.fromkeys(contaminations))
    cols = [f"{prefix}{s}" for s in sizes]
    cut = quantile_values(scores.select(*[finite_only(F.col(c)).alias(c) for c in cols]), cols, list(contaminations))
    each = scores.select(F.inline(F.array(*[F.struct(F.lit(s).alias("n_estimators"), F.col(c).alias("score")) for s, c in zip(sizes, cols)])))
    cells = [(s, float(c), cut[col, c]) for s, col in zip(sizes, cols) for c in contaminations]
    cutoffs = scores.sparkSession.createDataFrame(cells, "n_estimators int, contamination double, cutoff double")
    return histogram(each, "score", bins, ["n_estimators"]).join(cutoffs, "n_estimators").select(
        "n_estimators", "contamination", "cutoff", "bin", "n", "bin_from", "bin_to"
    ).orderBy("n_estimators", "contamination", "bin")


def box_summary(df: DataFrame, by: str, col: str, k: float = 1.5, examine: int = 1 << 14) -> DataFrame:
    """Quartiles, whisker ends (the last values inside the fences) and values beyond, per group.

    Any number of groups: quartiles are found for all of them in the same passes, and no
    group above ``examine`` values is ever sorted.
    """
    boxes = grouped_quantiles(df, by, col, (0.25, 0.5, 0.75), examine)
    q = [F.col("quantiles")[i] for i in range(3)]
    boxes = boxes.select(F.struct(F.col(by).alias("g")).alias("_by"), *[v.alias(n) for v, n in zip(q, ("q1", "median", "q3"))])
    low, high = F.col("q1") - k * (F.col("q3") - F.col("q1")), F.col("q3") + k * (F.col("q3") - F.col("q1"))
    inside = F.col("_value").between(low, high)
    rows = df.select(F.struct(F.col(f"`{by}`").alias("g")).alias("_by"), F.col(f"`{col}`").cast("double").alias("_value"))
    return (
        rows.filter("_value is not null")
        .join(sent_if_few(settle(boxes)), "_by")
        .groupBy("_by", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("_value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_value"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_fliers"),
        )
        .select(F.col("_by.g").alias(by), "q1", "median", "q3", "whisker_low", "whisker_high", "n_fliers")
        .orderBy(by)
    )

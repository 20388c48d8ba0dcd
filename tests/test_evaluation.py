"""Pairs of any number of runs, grids by place among cutoffs, histograms on common ranges: against numpy."""

from itertools import combinations

import numpy as np
import pytest

from batchlens.operators import evaluation as ev


def rand_by_hand(a, b):
    pairs = lambda n: n * (n - 1) / 2
    cells = sum(pairs(np.sum((a == x) & (b == y))) for x in (-1, 1) for y in (-1, 1))
    left, right = (sum(pairs(np.sum(v == x)) for x in (-1, 1)) for v in (a, b))
    expected, best = left * right / pairs(len(a)), (left + right) / 2
    return 1.0 if best == expected else (cells - expected) / (best - expected)


@pytest.mark.parametrize("runs", [2, 62, 63, 130])
def test_pairs_of_any_number_of_runs(spark, runs):
    rng = np.random.default_rng(runs)
    marks = np.where(rng.random((2, 90, runs)) < 0.3, -1, 1)
    marks[:, :30] = marks[:, :1]  # many rows share a pattern
    groups = [0.03, None]  # one group has no name
    rows = [(k, f"r{i}", groups[g], int(marks[g, k, i])) for g in (0, 1) for k in range(90) for i in range(runs)]
    rows += rows[:40] + [(0, "no run", 0.03, -1)]  # repeated labels count once, unknown runs not at all
    df = spark.createDataFrame(rows, "row_key int, seed string, contamination double, label int").repartition(6)
    got = ev.stability_pairs(df, [f"r{i}" for i in range(runs)]).collect()
    want = {(groups[g], f"r{i}-r{j}"): rand_by_hand(marks[g, :, i], marks[g, :, j]) for g in (0, 1) for i, j in combinations(range(runs), 2)}
    assert len(got) == len(want)
    for r in got:
        assert r["ari"] == pytest.approx(want[r["contamination"], r["seed_pair"]], abs=1e-12)


def test_grid_counts_strictly_below_each_cutoff(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 12, 500) / 4, rng.normal(size=500)  # many ties, none
    rows = [(float(x), float(y), None) for x, y in zip(a, b)] + [(None, float("nan"), None)]
    df = spark.createDataFrame(rows, "decision_1 double, decision_2 double, decision_3 double")
    shares = [0.03, 0.05, 0.1, 0.05, 0.5]
    got = {(r["n_estimators"], r["contamination"]): r for r in ev.contamination_grid(df, [1, 2, 3], shares).collect()}
    for size, v in ((1, a), (2, b)):
        for c in set(shares):
            r = got[size, c]
            assert r["outliers_flagged"] == np.sum(v < np.quantile(v, c))
            assert (r["score_min"], r["score_max"], r["score_median"]) == (v.min(), v.max(), pytest.approx(np.median(v)))
    assert got[3, 0.1]["outliers_flagged"] == 0 and got[3, 0.1]["score_min"] is None


def test_histograms_of_groups_share_their_ranges(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=400), rng.normal(3, 2, 300)
    df = spark.createDataFrame([(float(x), None) for x in a] + [(None, float(x)) for x in b], "decision_1 double, decision_2 double")
    low, high = min(a.min(), b.min()), max(a.max(), b.max())
    got = ev.histogram_grid(df, [1, 2], [0.05, 0.1], bins=7).collect()
    for size, v in ((1, a), (2, b)):
        counts, edges = np.histogram(v, bins=7, range=(low, high))
        for c in (0.05, 0.1):
            mine = [r for r in got if (r["n_estimators"], r["contamination"]) == (size, c)]
            assert {r["bin"]: r["n"] for r in mine} == {i: n for i, n in enumerate(counts) if n}
            assert all(r["bin_from"] == pytest.approx(edges[r["bin"]]) and r["cutoff"] == pytest.approx(np.quantile(v, c)) for r in mine)

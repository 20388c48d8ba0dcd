import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchlens.functions import isolation
from batchlens.operators import evaluation as ev
from batchlens.operators import forest as forest_module
from batchlens.operators.components import fit_pca, standardize, transform_pca
from batchlens.operators.fences import (
    MULTIVARIATE,
    UNIVARIATE,
    Fences,
    attribute_flags,
    deviation_type,
    fence_mask,
    top_attributes,
)
from batchlens.operators.forest import IsolationForest, score
from batchlens.operators.ranking import sample_flag
from batchlens.operators.reporting import annotate_status
from batchlens.sources import settle

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    """3,000 points, a third of them one and the same, and one far away."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    x[:1000] = [0.5, 0.5, 0.5]
    x[-1] = [9.0, -9.0, 9.0]
    rows = [(f"p{i:04d}", *map(float, r)) for i, r in enumerate(x)]
    return settle(spark.createDataFrame(rows, "row_key string, a double, b double, c double").repartition(5))


def scored(df):
    return {r["row_key"]: r["decision"] for r in df.collect()}


@pytest.fixture(scope="module")
def reference(points):
    return scored(IsolationForest(trees=12).fit_score(points, COLS))


def test_scores_are_proper_and_find_the_far_point(points, reference):
    assert len(reference) == 3000 and all(-0.5 < d < 0.5 for d in reference.values())
    assert min(reference, key=reference.get) == "p2999"


@pytest.mark.parametrize("group_rows", [1500, 100])
def test_scores_do_not_depend_on_group_size(points, reference, group_rows):
    # 1,000 equal rows never fit into groups of 100: they end as a large leaf.
    assert scored(IsolationForest(trees=12, group_rows=group_rows).fit_score(points, COLS)) == reference


def test_scores_do_not_depend_on_partitions(points, reference):
    assert scored(IsolationForest(trees=12).fit_score(points.repartition(9), COLS)) == reference


def test_a_forest_begins_with_its_smaller_ones(points, reference):
    sizes = IsolationForest(trees=20).fit_score(points, COLS, sizes=[12, 20])
    assert {r["row_key"]: r["decision_12"] for r in sizes.collect()} == reference


@pytest.mark.parametrize("group_rows", [1 << 20, 400])
def test_stored_nodes_score_like_the_growth(points, reference, group_rows):
    nodes = settle(IsolationForest(trees=12, group_rows=group_rows).fit(points, COLS))
    assert scored(score(points, COLS, nodes, 3000)) == reference


@pytest.mark.parametrize("table_nodes", [10, 1000, 5000])
def test_a_forest_too_large_to_send_is_walked_in_batches(points, reference, table_nodes):
    """Equal to the last bit: trees in batches, and with 10 nodes every tree joined level by level."""
    nodes = settle(IsolationForest(trees=12 if table_nodes > 10 else 3).fit(points, COLS))
    trees = nodes.groupBy("tree").count().collect()
    assert table_nodes == 10 or 1 < sum(r["count"] for r in trees) / table_nodes
    whole = scored(score(points, COLS, nodes, 3000))
    assert scored(score(points, COLS, nodes, 3000, table_nodes=table_nodes)) == whole
    assert table_nodes == 10 or whole == reference


@pytest.mark.parametrize("group_rows,table_nodes", [(100, 1200), (64, 400)])
def test_nodes_beyond_the_drivers_table_are_split_in_the_frame(points, group_rows, table_nodes):
    """The table of tops would need larger groups; the rest is split by aggregates and joins instead."""
    small, forest = IsolationForest(trees=3), IsolationForest(trees=3, group_rows=group_rows, table_nodes=table_nodes)
    assert 4 * 12 * 3000 / table_nodes > group_rows
    assert scored(forest.fit_score(points, COLS)) == scored(small.fit_score(points, COLS))
    plain, deep = small.fit(points, COLS), forest.fit(points, COLS)
    assert plain.exceptAll(deep).count() == deep.exceptAll(plain).count() == 0


def test_a_task_holds_no_group_above_group_rows(points):
    forest = IsolationForest(trees=2, group_rows=200, table_nodes=300)
    rows = forest_module._matrix(points, COLS, "row_key", {42: None})
    facts = forest_module._facts(rows, 3, [42])
    rows = rows.drop("key").withColumn("id", F.monotonically_increasing_id())
    sizes = []
    for top in forest._tops(settle(rows), facts[42], 3, 42):
        assert len(top.inner) + len(top.bins) + len(top.finished) <= forest.table_nodes
        groups, _, _ = forest._groups(top, rows, 3, 12)
        sizes += [r["count"] for r in groups.groupBy("seed", "first_tree", "last_tree", "bin").count().collect()]
    assert max(sizes) <= 200 and sum(sizes) <= 2 * 3000


def test_seeds_share_one_walk(points):
    """All forests of samples are walked in one pass, equal to each seed by itself, and flags are kept."""
    flags = {s: f"in_{s}" for s in (1, 2, 3)}
    df = points
    for s, f in flags.items():
        df = sample_flag(df, 2400, s, "row_key", 3000, f)
    df = settle(df)
    together = IsolationForest(trees=9, max_samples=64).fit_score_seeds(df, COLS, flags, keep=True)
    assert set(flags.values()) <= set(together.columns)
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    rows = {r["row_key"]: r for r in together.collect()}
    marks = {r["row_key"]: r for r in df.collect()}
    for s, f in flags.items():
        alone = scored(IsolationForest(trees=9, max_samples=64, seed=s).fit_score(df, COLS, sampled=f))
        assert {k: r[f"decision_{s}"] for k, r in rows.items()} == alone
        assert all(r[f] == marks[k][f] for k, r in rows.items())
    in_batches = IsolationForest(trees=9, max_samples=64, table_nodes=700).fit_score_seeds(df, COLS, flags)
    assert {r["row_key"]: r["decision_3"] for r in in_batches.collect()} == {k: r["decision_3"] for k, r in rows.items()}


@pytest.mark.parametrize("group_rows", [1 << 20, 500])
def test_rows_outside_the_sample_only_fall_through(points, group_rows):
    flagged = sample_flag(points, 2400, 5, "row_key", 3000)
    forest = IsolationForest(trees=8, group_rows=group_rows)
    nodes = settle(forest.fit(flagged, COLS, sampled="in_sample"))
    assert nodes.filter("depth = 0").agg(F.min("n"), F.max("n")).first() == (2400, 2400)
    grown = scored(forest.fit_score(flagged, COLS, sampled="in_sample"))
    assert len(grown) == 3000 and grown == scored(score(points, COLS, nodes, 2400))


def test_sampled_trees_get_their_rows_once(points):
    for psi in (64, 700):  # 700: more trees than one deck can serve
        nodes = IsolationForest(trees=10, max_samples=psi).fit(points, COLS)
        roots = nodes.filter("depth = 0").select("tree", "n").collect()
        assert sorted(r["tree"] for r in roots) == list(range(1, 11)) and {r["n"] for r in roots} == {psi}
    found = scored(IsolationForest(trees=50, max_samples=128).fit_score(points, COLS))
    assert min(found, key=found.get) == "p2999"


def test_gaps_are_refused(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "row_key string, a double")
    with pytest.raises(ValueError, match="missing"):
        IsolationForest(trees=2).fit_score(df, ["a"])


def test_constant_table_scores_alike(spark):
    df = spark.createDataFrame([(str(i), 1.0) for i in range(50)], "row_key string, a double")
    assert len(set(scored(IsolationForest(trees=3).fit_score(df, ["a"])).values())) == 1


def test_labels_and_keys(points, reference):
    labels = ev.label_outliers(settle(IsolationForest(trees=12).fit_score(points, COLS)), 0.03)
    keys = ev.outlier_keys(labels).collect()
    assert len(keys) == keys[0]["n_outliers"] == 90
    assert {r["row_key"] for r in keys} == set(sorted(reference, key=reference.get)[:90])


def test_rand_index(spark):
    df = spark.createDataFrame([(i, i % 3, "xyz"[i % 3], i % 2) for i in range(60)], "k int, a int, b string, c int")
    assert ev.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(1.0)
    assert ev.adjusted_rand(df, "a", "c").first()["ari"] < 0.05
    assert ev.adjusted_rand(df.withColumn("one", F.lit(1)), "one", "one").first()["ari"] == 1.0


def test_stability_of_seeds(points):
    kinds = {}
    for rows in (1 << 20, 600):
        pairs = ev.seed_stability(points, COLS, (1, 2, 3), (0.05,), trees=6, group_rows=rows)
        kinds[rows] = [tuple(r) for r in pairs.collect()]
    assert kinds[1 << 20] == kinds[600] and [p for _, p, _ in kinds[600]] == ["1-2", "1-3", "2-3"]
    assert ev.stability_summary(pairs).count() == 1


def test_parameter_grid(spark):
    assert ev.param_grid(spark, contamination=[0.03, 0.05], n_estimators=[100, 200, 300]).distinct().count() == 6


def test_components_are_orthonormal_and_uncorrelated(points):
    scaled = settle(standardize(points, COLS))
    model = fit_pca(scaled, COLS, keep=1.0)
    assert np.allclose(model.weights.T @ model.weights, np.eye(len(model.ratios)), atol=1e-9)
    assert model.ratios.sum() == pytest.approx(1.0)
    x = np.array([list(r) for r in transform_pca(scaled, model, []).collect()])
    assert np.allclose(np.cov(x.T) / np.trace(np.cov(x.T)), np.diag(model.ratios), atol=1e-6)


def test_deviation_rules(spark):
    fences = Fences({"a": (0.0, 10.0), "b": (0.0, 10.0)})
    rows = [("in", 5.0, 10.0), ("last", 5.0, 11.0), ("first", -1.0, 5.0), ("both", 11.0, 11.0), ("gap", None, 5.0), ("lastgap", 5.0, None)]
    df = spark.createDataFrame(rows, "row_key string, a double, b double")
    kinds = {r["row_key"]: r["d"] for r in df.select("row_key", deviation_type(fences).alias("d")).collect()}
    assert kinds == {"in": MULTIVARIATE, "last": MULTIVARIATE, "first": UNIVARIATE, "both": UNIVARIATE, "gap": UNIVARIATE, "lastgap": MULTIVARIATE}
    flags = attribute_flags(df, fences)
    assert [tuple(r) for r in flags.collect()] == [("a", 2), ("b", 2)] and top_attributes(flags) == ["b"]
    assert fence_mask(df, fences, ["row_key"]).filter("a = 'missing'").count() == 1
    status = annotate_status(df, df.filter("a < 0").select("row_key", deviation_type(fences).alias("deviation_type")))
    assert {r["status"] for r in status.collect()} == {"Core", UNIVARIATE}


def test_tops_of_trees_that_fit_the_table_are_counted_together(points):
    forest = IsolationForest(trees=3, group_rows=100, table_nodes=3000)
    rows = forest_module._matrix(points, COLS, "row_key", {42: None})
    tops = list(forest._tops(settle(rows.drop("key")), forest_module._facts(rows, 3, [42])[42], 3, 42))
    assert [top.trees for top in tops] == [range(1, 4)] and not tops[0].large
    few = list(IsolationForest(trees=3, group_rows=20, table_nodes=300)._tops(rows.drop("key"), forest_module._facts(rows, 3, [42])[42], 3, 42))
    assert [t for top in few for t in top.trees] == [1, 2, 3] and all(2 * len(top.inner) + len(top.trees) <= 300 for top in few)


@pytest.mark.parametrize("table_nodes, lot", [(2000, 1 << 18), (100, 50)])
def test_large_stored_trees_are_entered_together(points, spark, monkeypatch, table_nodes, lot):
    """Jobs don't grow with trees times levels, and a part that many rows reach is shared by tasks."""
    nodes = settle(IsolationForest(trees=4).fit(points, COLS))
    whole = scored(score(points, COLS, nodes, 3000))
    monkeypatch.setattr(forest_module, "_LOT", lot)
    spark.sparkContext.setJobGroup(f"large-{table_nodes}", "")
    assert scored(score(points, COLS, nodes, 3000, table_nodes=table_nodes)) == whole
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"large-{table_nodes}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert table_nodes < 1000 or jobs < 4 * 12


def test_trees_of_a_few_levels_move_no_rows(points, monkeypatch):
    df = sample_flag(points, 2400, 7, "row_key", 3000, "in_7")
    forest = IsolationForest(trees=6, max_depth=4)
    moved, nodes = scored(forest.fit_score(df, COLS, sampled="in_7")), forest.fit(df, COLS, sampled="in_7")
    nodes = settle(nodes)
    monkeypatch.setattr(forest_module, "_LOT", 100)
    counted = forest.fit_score(df, COLS, sampled="in_7")
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert scored(counted) == moved
    again = forest.fit(df, COLS, sampled="in_7")
    assert nodes.exceptAll(again).count() == again.exceptAll(nodes).count() == 0


def plain_growth(x, node, sampled, seed, tree, limit):
    """One node after the other."""
    path, waiting = np.zeros(x.shape[1], dtype=np.int64), [(k, np.flatnonzero(node == k)) for k in set(node.tolist())]
    while waiting:
        k, rows = waiting.pop()
        own, depth = rows[sampled[rows]], k.bit_length() - 1
        low, high = (x[:, own].min(axis=1), x[:, own].max(axis=1)) if own.size else (np.zeros(len(x)), np.zeros(len(x)))
        if own.size < 2 or depth >= limit or not (high > low).any():
            path[rows] = isolation.leaf_path(depth, own.size)
            continue
        feature, threshold = isolation.choose_splits(seed, tree, np.array([k]), low[:, None], high[:, None])
        right = x[feature[0], rows] > threshold[0]
        waiting += [(2 * k, rows[~right]), (2 * k + 1, rows[right])]
    return path


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_growth_is_that_of_one_node_after_the_other(share):
    rng = np.random.default_rng(int(10 * share))
    x = np.stack([rng.integers(0, 4, 700) / 10, rng.normal(size=700).round(2), np.full(700, 7.0), np.where(rng.random(700) < 0.5, 0.0, -0.0)])
    node, sampled = rng.choice([4, 5, 6, 7], 700), rng.random(700) < share
    sampled[node == 6] = False  # a node no sampled row has reached
    marks = None if sampled.all() else sampled
    places, values = isolation.ranked(x)
    for tree, limit in ((1, 10), (2, 60), (3, 2)):
        want = plain_growth(x, node, np.ones(700, bool) if marks is None else sampled, 42, tree, limit).tolist()
        levels, by_places = [], []
        assert isolation.grow(x, node, marks, 42, tree, limit).tolist() == want
        assert isolation.grow(places, node, marks, 42, tree, limit, values=values).tolist() == want
        isolation.grow(x, node, marks, 42, tree, limit, levels)
        isolation.grow(places, node, marks, 42, tree, limit, by_places, values)
        assert all(np.array_equal(a, b) for one, other in zip(levels, by_places, strict=True) for a, b in zip(one, other))
    assert isolation.grow(x[:, :0], node[:0], None, 42, 1, 5).size == 0


def test_growth_holds_little_beside_its_rows():
    """A task that grows trees over two million rows has to fit beside three others."""
    rng = np.random.default_rng(1)
    x, node, sampled = rng.normal(size=(6, 50_000)).round(1), np.ones(50_000, np.int64), rng.random(50_000) < 0.8
    tracemalloc.start()
    isolation.grow(x, node, sampled, 42, 1, 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4.5 * x.nbytes


def test_trees_in_lots_give_the_same_scores_and_leave_no_exchange_behind(spark, monkeypatch):
    from batchlens.operators import forest
    from batchlens.sources import shared

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(f"k{i}", float(a), float(round(b, 1))) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))], "row_key string, u double, v double").repartition(3)
    expected = sorted(IsolationForest(trees=5, group_rows=64).fit_score(df, ["u", "v"], sizes=[2, 4]).collect())
    monkeypatch.setattr(forest, "_ON_THE_WAY", 700, raising=False)
    monkeypatch.setattr(shared, "_LOT_ROWS", 120, raising=False)
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = files.getAllFiles().size()
    scores = IsolationForest(trees=5, group_rows=64).fit_score(df, ["u", "v"], sizes=[2, 4])
    assert sorted(scores.collect()) == expected and len(expected) == 300
    assert files.getAllFiles().size() <= before

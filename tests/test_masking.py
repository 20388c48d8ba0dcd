"""Masking in batches, sketches against exact ranks, and correlations that components imply."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchlens.operators import components as pc
from batchlens.operators.masking import build_mappings, mask
from batchlens.operators.quantiles import quantile_sketches, rank_errors, sketch_quantiles, sketch_size

SCHEMA = "row_key string, material_code string, component_code string, material_batch_nr string, component_batch_nr string, cma1 double"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_stored_codes_stay_and_new_ones_follow(spark):
    first = batch(spark, [("1", "b", "x", "10", None, 1.0), ("2", "d", "x", "9", "q", 2.0), ("3", None, "y", "10", "q", None)])
    second = batch(spark, [("4", "a", "x", "10", "q", 1.0), ("5", "c", "z", "11", "p", 2.0), ("6", "d", None, "8", "r", 3.0)])
    _, stored = mask(first)
    masked, mappings = mask(second, stored=stored)
    codes = {c: {r["original"]: r["masked"] for r in mappings[c].collect()} for c in mappings}
    assert codes["material_code"] == {"b": "M1", "d": "M2", "a": "M3", "c": "M4"}
    assert codes["component_code"] == {"x": "C1", "y": "C2", "z": "C3"}
    assert codes["material_batch_nr"] == {"10": "MB1", "9": "MB2", "11": "MB3", "8": "MB4"}
    assert codes["component_batch_nr"] == {"q": "CB1", "p": "CB2", "r": "CB3"}
    rows = {r["row_key"]: tuple(r)[1:] for r in masked.collect()}
    assert rows == {"4": ("M3", "C1", "MB1", "CB1", 1.0), "5": ("M4", "C3", "MB3", "CB2", 2.0), "6": ("M2", None, "MB4", "CB3", 3.0)}
    assert masked.columns == [*first.columns[:5], "CMA1"]


def test_mask_refuses_repeated_keys_and_mappings(spark):
    twice = batch(spark, [("1", "b", "x", "10", "q", 1.0), ("1", "d", "x", "9", "q", 2.0)])
    with pytest.raises(ValueError, match="1 keys of row_key stand for 2 rows"):
        mask(twice)
    stored = spark.createDataFrame([("b", "M1"), ("b", "M2")], "original string, masked string")
    with pytest.raises(ValueError, match="1 keys of original stand for 2 rows"):
        build_mappings(twice, {"material_code": "M"}, stored={"material_code": stored})


def test_mask_of_an_empty_table(spark):
    masked, mappings = mask(batch(spark, []))
    assert masked.count() == 0 and mappings["material_code"].count() == 0


def test_sketches_of_batches_merge_within_the_accuracy(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 7).alias("batch"),
        (F.hash("id") % 1000).cast("double").alias("ties"),
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.exp(F.randn(4) * 9)).alias("wide"),
        F.lit(None).cast("double").alias("none"),
    )
    ps = [0.0, 0.01, 0.5, 0.9, 1.0]
    estimates = sketch_quantiles(quantile_sketches(df, ["ties", "wide", "none"], 0.02, by=["batch"]), ps)
    errors = rank_errors(df, estimates).collect()
    assert {(r["attribute"], r["p"]) for r in errors} == {(c, p) for c in ("ties", "wide") for p in ps}
    assert all(r["error"] <= 0.02 and r["n"] == (60_000 if r["attribute"] == "ties" else 40_000) for r in errors)
    wrong = spark.createDataFrame([("ties", 0.5, -1000.0)], "attribute string, p double, value double")
    assert rank_errors(df, wrong).first()["error"] == pytest.approx(0.5, abs=1e-3)
    assert rank_errors(df, wrong.limit(0)).count() == 0


def test_sketch_size_is_the_smallest_that_holds_the_accuracy():
    for accuracy in (0.3, 0.05, 0.01, 0.001):
        k = sketch_size(accuracy)
        assert 2.296 / k**0.9021 <= accuracy / 3 and (k == 8 or 2.296 / (k - 1) ** 0.9021 > accuracy / 3)
    for accuracy in (0.0, 1.0, 0.0001):
        with pytest.raises(ValueError):
            sketch_size(accuracy)


def test_components_imply_the_correlations(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 5)) @ draw.normal(size=(5, 5))
    df = spark.createDataFrame([(*map(float, row), 2.0) for row in x], "a double, b double, c double, d double, e double, flat double")
    model = pc.fit_pca(pc.standardize(df, df.columns), df.columns, 1.0)
    got = {(r["attribute"], r["other"]): r["correlation"] for r in pc.implied_correlations(model).collect()}
    want = np.corrcoef(x.T)
    for i, a in enumerate("abcde"):
        assert got[a, "flat"] == pytest.approx(0.0, abs=1e-9)
        for j, b in enumerate("abcde"):
            assert got[a, b] == pytest.approx(want[i, j], abs=1e-9)


def test_mappings_known_to_be_small_are_sent_and_not_exchanged(spark):
    rows = [(f"k{i}", f"m{i % 3}", f"c{i % 5}", f"b{i}", f"d{i}", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "row_key string, material_code string, component_code string, material_batch_nr string, component_batch_nr string, cma1 double")
    masked, mappings = mask(df)
    assert masked._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 4
    assert {c: m.count() for c, m in mappings.items() if c != "attribute"} == {"material_code": 3, "component_code": 5, "material_batch_nr": 50, "component_batch_nr": 50}
    found = {r["row_key"]: (r["material_code"], r["component_code"]) for r in masked.collect()}
    assert found == {f"k{i}": (f"M{i % 3 + 1}", f"C{i % 5 + 1}") for i in range(50)}


def shuffle_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


@pytest.mark.parametrize("order_by", [None, "row_key"])
def test_mask_in_lots_gives_the_same_codes_and_leaves_no_exchange_behind(spark, monkeypatch, order_by):
    from batchlens.operators import masking
    from batchlens.sources import shared

    rows = [(f"k{i:03}", f"m{i % 3}" if i % 7 else None, f"c{i % 5}", f"b{i * 7 % 50}", f"d{i}", float(i)) for i in range(150)]
    kinds = "row_key string, material_code string, component_code string, material_batch_nr string, component_batch_nr string, cma1 double"
    df = spark.createDataFrame(rows, kinds).repartition(4)
    expected = sorted(mask(df, order_by=order_by)[0].collect())
    monkeypatch.setattr(masking, "_FEW_CODES", 4)
    monkeypatch.setattr(shared, "_LOT_ROWS", 60, raising=False)
    before = shuffle_files(spark)
    masked, mappings = mask(df, order_by=order_by)
    assert sorted(masked.collect()) == expected and len(expected) == 150
    assert shuffle_files(spark) <= before
    assert {c: m.count() for c, m in mappings.items() if c != "attribute"} == {"material_code": 3, "component_code": 5, "material_batch_nr": 50, "component_batch_nr": 150}


def test_component_scores_are_one_table_by_column(spark, monkeypatch, tmp_path):
    from batchlens.plans.detect import component_scores
    from batchlens.sources import shared

    monkeypatch.setattr(shared, "_shared_root", lambda _: str(tmp_path))
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f"k{i}", float(a), float(a + b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))], "row_key string, u double, v double")
    scores, _ = component_scores(df, ["u", "v"], keep=1.0)
    assert [p.name[:6] for p in tmp_path.iterdir()] == ["table-"]
    assert scores.count() == 200 and scores.columns == ["row_key", "PC1", "PC2"]
    assert {round(r["s"], 9) for r in scores.unpivot(["row_key"], ["PC1", "PC2"], "c", "v").groupBy("c").agg(F.stddev_pop("v").alias("s")).collect()} == {1.0}

"""Quantiles, medians, ranks, samples and masks against brute force."""

import statistics
from decimal import ROUND_HALF_UP, Decimal, localcontext
from hashlib import md5

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from batchlens.operators import quantiles as q
from batchlens.operators.audit import require_unique, with_row_key
from batchlens.operators.masking import build_mapping, mask
from batchlens.operators.profiles import coded_profiles, frequent_or_rare
from batchlens.operators.ranking import category_code, exact_sample, global_rank, sample_flags, top_code
from batchlens.operators.reporting import attach
from batchlens.operators.roles import Roles

N = 3000


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(
        {
            "normal": rng.normal(size=N),
            "few": rng.integers(0, 5, N).astype(float),
            "hot": np.where(rng.random(N) < 0.4, 7.0, rng.lognormal(3, 4, N)),  # one value holds 40 % of the rows
            "flat": np.full(N, 3.0),
        }
    )
    pdf.loc[rng.random(N) < 0.2, "normal"] = np.nan
    return pdf


@pytest.mark.parametrize("examine", [1 << 20, 500, 3])
def test_quantiles_and_medians(spark, numbers, examine):
    cols = list(numbers.columns)
    df = spark.createDataFrame(numbers).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    for (c, p), value in q.quantile_values(df, cols, [0.0, 0.03, 0.25, 0.5, 0.9, 1.0], examine).items():
        assert value == pytest.approx(float(numbers[c].quantile(p)), rel=1e-9)
    exact = df.select(*[F.col(c).cast("string").cast("decimal(38,18)").alias(c) for c in cols])
    medians = q.median_values(exact, cols, examine)
    with localcontext() as context:
        context.prec = 60
        for c in cols:
            values = [r[0] for r in exact.select(c).collect() if r[0] is not None]
            assert medians[c] == statistics.median(values).quantize(Decimal(1).scaleb(-18), ROUND_HALF_UP)


@pytest.mark.parametrize("examine", [1 << 20, 200, 3])
@pytest.mark.parametrize(
    "texts",
    [
        [f"{20_000_000_000 + 7 * i}.{i:018d}" for i in range(900)],  # wide decimals
        [f"12345678901234567890.{i:018d}" for i in range(900)],  # all within one double
        [f"{'-' if i % 2 else ''}99999999999999999999.{i:018d}" for i in range(900)],
    ],
    ids=["wide", "one double", "both ends"],
)
def test_medians_of_decimals_beyond_doubles(spark, texts, examine):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("decimal(38,18)").alias("x"))
    with localcontext() as context:
        context.prec = 80
        want = statistics.median(map(Decimal, texts)).quantize(Decimal(1).scaleb(-18), ROUND_HALF_UP)
    assert q.median_values(df, ["x"], examine)["x"] == want
    _, found = q.order_statistics(df, lambda n: {0, 5, n // 3, n - 1}, ["x"], [1 / 3], examine)
    ordered = sorted(map(Decimal, texts))
    assert all(value == ordered[k] for (_, k), value in found.items()) and len(found) == 4


@pytest.mark.parametrize("examine", [1 << 20, 100, 3])
def test_quantiles_over_the_whole_range_of_doubles(spark, examine):
    values = [(-1) ** i * 1.7e308 * ((i + 1) / 900) for i in range(900)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values)
    n, found = q.order_statistics(df, lambda n: {0, 449, 450, n - 1}, ["x"], [0.5], examine)
    assert all(found["x", k] == ordered[k] for k in (0, 449, 450, 899)) and n == {"x": 900}
    ends = q.quantile_values(df, ["x"], [0.0, 1.0], examine)
    assert (ends["x", 0.0], ends["x", 1.0]) == (ordered[0], ordered[-1])


def test_histograms_alone_find_the_ranks(spark, numbers):
    df = spark.createDataFrame(numbers[["hot"]])
    n, found = q.order_statistics(df, lambda n: {0, 10, n // 2, n - 1}, ["hot"], examine=5)
    ordered = sorted(numbers["hot"])
    assert all(found["hot", k] == ordered[k] for k in (0, 10, N // 2, N - 1)) and n == {"hot": N}


def test_empty_column_has_no_quantile(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert q.quantile_values(df, ["x"], [0.5]) == {("x", 0.5): None}
    assert q.median_values(df.select(F.col("x").cast("decimal(38,18)").alias("x")), ["x"]) == {"x": None}


def test_global_rank_is_a_row_number(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("v")).repartition(11)
    assert all(r["v"] + 1 == r["rank"] for r in global_rank(df, ["v"]).collect())


def test_sample_is_exact_and_stable(spark):
    df = spark.range(5000).withColumn("k", F.concat(F.lit("row-"), F.col("id").cast("string")))
    wanted = {k for _, k in sorted((md5(f"row-{i}|9".encode()).hexdigest(), f"row-{i}") for i in range(5000))[:4000]}
    assert {r["k"] for r in exact_sample(df, 0.8, 9, "k").collect()} == wanted
    assert {r["k"] for r in exact_sample(df.repartition(17), 0.8, 9, "k").collect()} == wanted
    both = sample_flags(df, 4000, {"a": 9, "b": 10}, "k", 5000)
    assert {r["k"] for r in both.filter("a").collect()} == wanted and both.filter("b").count() == 4000
    assert exact_sample(df, 0.0, 9, "k").count() == 0 and exact_sample(df, 1.0, 9, "k").count() == 5000


def test_sample_of_rows_that_share_a_key_is_exact_and_stable(spark):
    """A key of 30,000 rows is cut by a hash of the whole row, equal rows by where they lie."""
    df = spark.range(30_000).select(F.lit("hot").alias("k"), F.col("id").alias("v")).unionByName(spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")))
    some = lambda frame: {(r["k"], r["v"]) for r in exact_sample(frame, 0.4, 10, "k").collect()}
    first = some(df.repartition(7))
    assert len(first) == 12_200 and first == some(df.repartition(3, "v"))
    assert len({k for k, _ in first}) > 1
    equal = spark.range(5000).select(F.lit("hot").alias("k"), F.lit(1).alias("v"), F.lit(None).cast("string").alias("w"))
    assert exact_sample(equal.repartition(6), 0.31, 10, "k").count() == 1550
    flagged = sample_flags(equal, 7, {"a": 1, "b": 2}, "k", 5000)
    assert (flagged.filter("a").count(), flagged.filter("b").count(), flagged.columns) == (7, 7, ["k", "v", "w", "a", "b"])


@pytest.mark.parametrize("examine", [4, 64, 1 << 14])
def test_quantiles_of_groups(spark, examine):
    rng = np.random.default_rng(5)
    groups = {"hot": rng.integers(0, 40, 3000) / 8, "wide": rng.normal(0, 1e6, 2000), "one": np.array([3.5]), "same": np.full(900, 2.25), None: rng.normal(size=77)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("hot", None), ("gap", None), ("wide", float("nan")), ("wide", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ps = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in q.grouped_quantiles(df, "g", "v", ps, examine).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g]["n"] == len(v) and got[g]["quantiles"] == pytest.approx(np.quantile(v, ps).tolist(), rel=1e-12)


def test_row_keys_are_unique_and_repeated_ones_are_refused(spark):
    rows = [("a", 1, "x")] * 3 + [("a", 1, "y"), ("a", None, "x"), (None, 1, "x"), ("b", 2, None)]
    df = spark.createDataFrame(rows, "p string, q int, v string")
    keyed = with_row_key(df, ["p", "q"])
    got = sorted((r["row_key"], r["v"]) for r in keyed.collect())
    assert [k for k, _ in got] == ["-1", "a-", "a-1#1", "a-1#2", "a-1#3", "a-1#4", "b-2"]
    assert len({v for k, v in got[2:5]} | {got[5][1]}) == 2
    assert require_unique(keyed, ["row_key"]) is keyed
    with pytest.raises(ValueError, match="1 keys of p, q stand for 4 rows"):
        require_unique(df, ["p", "q"])
    scores = keyed.select("row_key", F.lit(0.5).alias("score"))
    assert attach(keyed, scores).count() == 7
    with pytest.raises(ValueError):
        attach(keyed, scores.unionByName(scores))


def test_top_code_skips_nulls_and_breaks_ties(spark):
    df = spark.createDataFrame([(v,) for v in [None, None, None, "b", "a", "a", "b"]], "c string")
    assert tuple(top_code(df, "c").first()) == ("a", 2)


def test_masks_are_reversible_and_keep_nulls(spark):
    rows = [("k3", "z", "u", "1"), ("k1", "y", "u", None), ("k2", "z", "v", "1")]
    df = spark.createDataFrame(rows, "row_key string, material_code string, component_code string, temp string")
    roles = Roles(ids=("material_code", "component_code"))
    masked, mappings = mask(df, roles)
    by_key = {r["row_key"]: r for r in masked.collect()}
    assert masked.columns == ["row_key", "material_code", "component_code", "CMA1"] or set(masked.columns) == {"row_key", "material_code", "component_code", "CMA1"}
    assert by_key["k1"]["material_code"] == "M1" and by_key["k3"]["material_code"] == "M2"
    assert set(mappings) == {"material_code", "component_code", "attribute"}
    first = {r["original"]: r["masked"] for r in build_mapping(df, "material_code", "M", "row_key").collect()}
    assert first == {"y": "M1", "z": "M2"}
    assert mask(df, roles, on=False) == (df, {})
    unseen = spark.createDataFrame([("k9", None, "u", "1")], df.schema)
    assert mask(unseen, roles)[0].first()["material_code"] is None


def test_category_codes_follow_first_appearance(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (0, None)], "k int, c string")
    assert {r["k"]: r["code"] for r in category_code(df, "c", "k").collect()} == {0: 0, 1: 1, 2: 2, 3: 2}


def test_profiles_with_a_dominating_combination(spark):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("row_key"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("double").alias("a"),
        F.when(F.col("id") == 7, None).otherwise(1.0).alias("b"),
    )
    groups = {r["row_key"]: (r["frequency"], r["profile_group"]) for r in frequent_or_rare(df, ["a", "b"]).collect()}
    assert groups["0"] == (335, "Frequent") and groups["7"] == (None, "Rare") and groups["2"] == (1, "Rare")
    coded = {r["row_key"]: r["profile_group"] for r in coded_profiles(df, ["a", "b"]).collect()}
    assert coded["0"] == "CMA_Profile_0" and coded["2"] == "Rare_Profile" and coded["7"] is None


def test_few_profiles_move_no_rows(spark):
    rows = [(f"k{i}", float(i % 3), 1.0) for i in range(60)] + [("once", 9.0, 9.0), ("gap", None, 1.0)]
    df = spark.createDataFrame(rows, "row_key string, a double, b double").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = coded_profiles(df, ["a", "b"])
        plan = coded._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {r["row_key"]: (r["profile_group"], r["code"]) for r in coded.collect()}
    assert len(got) == 62 and got["once"][0] == "Rare_Profile" and got["gap"][0] is None
    assert [got[f"k{i}"][0] for i in range(3)] == [f"CMA_Profile_{i}" for i in range(3)] and len({c for _, c in got.values()}) == 5


def test_rows_of_a_few_large_groups_stay_where_they_are(spark, tmp_path, monkeypatch):
    """A table that Spark takes for small must not be sent to the few rows of a lookup, and so meet in one task."""
    path, moved, settle = str(tmp_path / "rows"), [], q.settle
    spark.range(0, 60_000, 1, 8).selectExpr("id % 3 AS g", "cast(hash(id) AS double) AS x").write.parquet(path)

    def settled(df):
        moved.append(settle(df))
        return moved[-1]

    monkeypatch.setattr(q, "settle", settled)
    got = {r["g"]: r["quantiles"][0] for r in q.grouped_quantiles(spark.read.parquet(path), "g", "x", (0.5,), 64).collect()}
    assert got == {r["g"]: r["m"] for r in spark.read.parquet(path).groupBy("g").agg(F.expr("percentile(x, 0.5)").alias("m")).collect()}
    rows = next(df for df in moved if set(df.columns) == {"by", "x", "part"})
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_row_keys_in_lots_and_of_crowds_leave_no_exchange_behind(spark, monkeypatch):
    from batchlens.operators import audit
    from batchlens.sources import shared

    rows = [("a", i) for i in range(90)] + [(f"b{i % 20}", i) for i in range(60)] + [(f"c{i}", i) for i in range(30)] + [(None, 1), (None, 1)]
    df = spark.createDataFrame(rows, "p string, v int").repartition(5)
    expected = sorted(with_row_key(df, ["p"]).collect())
    assert [r[0] for r in expected] == sorted(
        [f"a#{i + 1}" for i in range(90)] + [f"b{i}#{k + 1}" for i in range(20) for k in range(3)] + [f"c{i}" for i in range(30)] + ["#1", "#2"]
    )
    monkeypatch.setattr(audit, "_CROWD", 50, raising=False)
    monkeypatch.setattr(shared, "_LOT_ROWS", 100, raising=False)
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = files.getAllFiles().size()
    keyed = with_row_key(df, ["p"])
    assert files.getAllFiles().size() <= before
    assert sorted(require_unique(keyed, ["row_key"]).collect()) == expected and keyed.columns == ["row_key", "p", "v"]

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from batchlens.functions import (
    decimal_places,
    exact_double,
    finite_only,
    gaussian_draw,
    map_literal,
    parse_decimal,
    percent_label,
    present_count,
    round_half_up,
    uniform_draw,
)
from batchlens.operators.audit import audit_alignment, audit_types
from batchlens.operators.cleaning import column_precision, impute_median, normalize_precision, to_decimal, to_double
from batchlens.operators.roles import Roles, canonical_names, cast_roles
from batchlens.sources import read_batches


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_blanks_and_text_become_null(spark):
    assert column(spark, ["", " ", "  ", "abc", " 1.50", None], parse_decimal) == [None, None, None, None, Decimal("1.5"), None]


def test_decimal_places(spark):
    places = column(spark, ["100", "1.500", "0.0001", "12.34", "0", "0.0000000001", "-0.25", None], lambda v: decimal_places(parse_decimal(v)))
    assert places == [0, 1, 4, 2, 0, 10, 2, None]


def test_rounding_is_half_up_on_decimals(spark):
    assert column(spark, ["2.665", "0.285", None], lambda v: round_half_up(parse_decimal(v), 2)) == [Decimal("2.67"), Decimal("0.29"), None]
    assert column(spark, ["-2.5", "2.5"], lambda v: round_half_up(parse_decimal(v), 0)) == [Decimal(-3), Decimal(3)]


def test_percent_ties_go_to_even(spark):
    assert column(spark, [1, 3, 7], lambda v: percent_label(v, 8), "int") == ["12%", "38%", "88%"]


def test_finite_only(spark):
    assert column(spark, [1.0, float("inf"), float("-inf"), float("nan"), None], finite_only, "double") == [1.0, None, None, None, None]


def test_map_literal_keeps_unknown_and_null_empty(spark):
    assert column(spark, ["a", "z", None], lambda v: map_literal(v, {"a": "x"})) == ["x", None, None]


def test_present_count_is_the_same_for_many_columns(spark):
    wide = spark.range(1).select(*[F.when(F.lit(i % 3 == 0), F.lit(1)).alias(f"c{i}") for i in range(120)])
    assert wide.select(present_count(wide.columns)).first()[0] == 40
    assert wide.select(present_count(wide.columns[:9])).first()[0] == 3


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    draws = lambda d: {r["id"]: (r["u"], r["g"]) for r in d.select("id", uniform_draw(7, F.col("id")).alias("u"), gaussian_draw(7, F.col("id")).alias("g")).collect()}
    one = draws(df)
    assert one == draws(df.repartition(13))
    assert all(0 <= u < 1 for u, _ in one.values()) and abs(sum(g for _, g in one.values()) / 500) < 0.2


def test_csv_ids_stay_text_and_nan_is_null(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Batch Nr,x\n00123,1.5\n00124,NaN\n")
    df = read_batches(spark, str(tmp_path / "b.csv"), ids=["Batch Nr"])
    assert sorted(tuple(r) for r in df.collect()) == [("00123", 1.5), ("00124", None)]
    assert canonical_names(df, {"Batch Nr": "Material Batch Nr"}).columns == ["material_batch_nr", "x"]


def test_roles(spark):
    df = spark.createDataFrame([("k", 1, "2", "3.5")], "row_key string, material_code int, n_tests string, cma1 string")
    cast = cast_roles(df)
    assert Roles().features(df) == ["cma1"]
    assert [f.dataType.simpleString() for f in cast.schema] == ["string", "string", "int", "double"]


def test_imputation_and_precision(spark):
    rows = [("1.0", "5", None), (None, "6", None), ("2.25", "7", None), ("3.5", "8", None)]
    df = to_decimal(spark.createDataFrame(rows, "a string, b string, e string"), ["a", "b", "e"])
    filled = impute_median(df, ["a", "b", "e"])
    assert sorted(r["a"] for r in filled.collect()) == [Decimal("1"), Decimal("2.25"), Decimal("2.25"), Decimal("3.5")]
    assert all(r["e"] is None for r in filled.collect())
    # a: places 0, 2, 2, 1; b: whole numbers, so the minimum of 1; e: none
    assert {r["attribute"]: r["places"] for r in column_precision(filled, ["a", "b", "e"]).collect()} == {"a": 2, "b": 1, "e": None}
    assert normalize_precision(filled, ["a", "e"])[0].count() == 4


def test_precision_tie_takes_the_smaller(spark):
    df = to_decimal(spark.createDataFrame([("1.5",), ("2.25",)], "a string"), ["a"])
    assert column_precision(df, ["a"]).first()["places"] == 1


def test_type_audit_names_three_examples(spark):
    df = spark.createDataFrame([(v,) for v in ["d", "a", "c", "b", "a", " ", "1"]], "x string")
    assert [tuple(r) for r in audit_types(df, ["x"]).collect()] == [("x", 5, "a, b, c")]


def test_alignment_counts_both_sides(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "k string")
    b = spark.createDataFrame([("2",), ("3",), (None,)], "k string")
    assert tuple(audit_alignment(a, b, ["k"]).first()) == (2, 1, False)
    assert audit_alignment(a, a.repartition(3), ["k"]).first()["aligned"]


def test_blanks_and_text_go_through_curate_and_clean(spark):
    from batchlens.plans import clean, curate

    rows = [(f"k{i}", "m", "c", str(i), f"c{i}", text) for i, text in enumerate(["1.50", " ", "", "2.25", None, "3.75"])]
    raw = spark.createDataFrame(rows, "row_key string, `Material Code` string, component_code string, material_batch_nr string, component_batch_nr string, a string")
    table, places = clean(curate(raw), frac=0.0)
    assert sorted(r["a"] for r in table.collect()) == [1.5, 2.25, 2.25, 2.25, 2.25, 3.75]
    assert [tuple(r) for r in places.collect()] == [("a", 2)]


@pytest.mark.parametrize("bad", ["n/a", "1e21", "1,5"])
def test_values_that_are_no_decimal_are_refused(spark, bad):
    from batchlens.plans import clean

    rows = [(str(i), "m", "c", str(i), str(i), v) for i, v in enumerate(["1", "2", "3", bad])]
    df = spark.createDataFrame(rows, "row_key string, material_code string, component_code string, material_batch_nr string, component_batch_nr string, a string").withColumn("n_tests", F.lit(1))
    with pytest.raises(ValueError, match="a: 1"):
        clean(df)
    assert clean(df, refuse=False)[0].count() == 4


def test_rounding_keeps_the_type_of_the_column(spark):
    from batchlens.operators.cleaning import normalize_precision

    df = spark.createDataFrame([("1234567890123456789012345.250000",), ("2.500000",), ("7.125000",)], "t string")
    exact = df.select(F.col("t").cast("decimal(38,6)").alias("x"))
    rounded, places = normalize_precision(exact, ["x"])
    assert rounded.schema["x"].dataType == exact.schema["x"].dataType
    assert [tuple(r) for r in places.collect()] == [("x", 1)]
    assert max(str(r["x"]) for r in rounded.collect() if len(str(r["x"])) > 20) == "1234567890123456789012345.300000"


def test_box_summary_by_group_and_null_group(spark):
    from batchlens.operators.evaluation import box_summary

    rows = [("a", float(i)) for i in range(11)] + [("a", 100.0), (None, 1.0), (None, 3.0), ("b", None)]
    got = {r["g"]: r for r in box_summary(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert (got["a"]["q1"], got["a"]["median"], got["a"]["q3"], got["a"]["n_fliers"]) == (2.75, 5.5, 8.25, 1)
    assert (got["a"]["whisker_low"], got["a"]["whisker_high"]) == (0.0, 10.0)
    assert got[None]["median"] == 2.0 and "b" not in got


def test_exact_doubles_do_not_go_through_text(spark):
    texts = ["0.1", "-0.07", "901.5", "99999999999.9999", "99999999999.99999", "100000000000", "0.00001", "-0.00005", "12345678901234567890.123456789012345678", "0", None]
    for kind in ("decimal(38,18)", "decimal(38,0)", "decimal(12,2)"):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").try_cast(kind).alias("x"))
        both = rows.select(F.col("x").cast("double").alias("slow"), exact_double(F.col("x")).alias("fast")).collect()
        assert [r["slow"] for r in both] == [r["fast"] for r in both]
    huge = spark.createDataFrame([("9" * 38,), ("-" + "9" * 38,), ("7",)], "t string").select(F.col("t").cast("decimal(38,0)").alias("x"))
    assert [r[0] for r in huge.select(exact_double(F.col("x"))).collect()] == [1e38, -1e38, 7.0]
    plan = to_double(rows, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal(15,4)" in plan

"""Ranks, running sums and ordered results."""

from pyspark.sql import functions as F

from batchlens.functions import present_count
from batchlens.operators import components as pc
from batchlens.operators.cleaning import to_decimal
from batchlens.operators.coverage import with_coverage, with_test_count
from batchlens.operators.fences import attribute_flags, deviation_type, iqr_fences, top_attributes
from batchlens.operators.masking import build_mapping
from batchlens.operators.profiles import profile_counts
from batchlens.operators.quantiles import order_statistics
from batchlens.operators.reporting import annotate_status, ordered_union
from batchlens.sources import preview
from queries.fixture import ATTRS, COUNTED, FILLED, OPV, Book, dec, deviation_sql, fences_sql, opv, rounded
from queries.projections import PAIR, pair_model

BOOK = Book()


@BOOK.add("w1_running_codes", f"WITH {OPV} SELECT v AS original, concat('CB', row_number() OVER (ORDER BY v)) AS masked FROM (SELECT DISTINCT component_batch_nr AS v FROM opv)")
def running_codes(spark, sf_dir):
    return build_mapping(opv(spark, sf_dir), "component_batch_nr", "CB")


@BOOK.add("w2_cumulative_variance", f"WITH {PAIR} SELECT pos AS position, round(ratio, 6) AS ratio, round(sum(ratio) OVER (ORDER BY pos), 6) AS cumulative FROM ratios")
def cumulative_variance(spark, sf_dir):
    return rounded(pc.scree(pair_model(spark, sf_dir)), "ratio", "cumulative").select("position", "ratio", "cumulative")


@BOOK.add(
    "w3_profile_ids",
    f"WITH {OPV}, p AS (SELECT cma1, cma3, cma4, count(*) AS frequency FROM opv WHERE cma1 IS NOT NULL AND cma3 IS NOT NULL AND cma4 IS NOT NULL GROUP BY 1, 2, 3)"
    " SELECT *, concat('CMA_Profile_', row_number() OVER (ORDER BY frequency DESC, cma1, cma3, cma4) - 1) AS profile_id FROM p",
)
def profile_ids(spark, sf_dir):
    return profile_counts(opv(spark, sf_dir), ["cma1", "cma3", "cma4"])


_FLAGS = f"WITH {OPV}, {fences_sql('opv')}, n AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, count(*) FILTER ({c} < 0.9 * {c}_lo OR {c} > 0.45 * {c}_hi) AS times_flagged FROM opv, fences" for c in FILLED
) + "), ranked AS (SELECT *, row_number() OVER (ORDER BY times_flagged DESC, attribute) AS rn FROM n WHERE times_flagged > 0)"


@BOOK.add("w4_ranks_two_to_four", _FLAGS + " SELECT attribute, times_flagged FROM ranked WHERE rn BETWEEN 2 AND 4")
def middle_ranks(spark, sf_dir):
    df = opv(spark, sf_dir)
    fences = iqr_fences(df, FILLED)
    # Tightened fences: with the usual ones these tables flag next to nothing.
    tight = type(fences)({c: (0.9 * low, 0.45 * high) for c, (low, high) in fences.bounds.items()})
    flags = attribute_flags(df, tight)
    return flags.filter(F.col("attribute").isin(top_attributes(flags)))


@BOOK.add(
    "w5_middle_rows",
    f"WITH {OPV}, d AS (SELECT component_code, {dec('cma2')} AS v FROM opv), k AS (SELECT v, row_number() OVER (ORDER BY v) AS rn, count(*) OVER () AS n FROM d WHERE v IS NOT NULL)"
    " SELECT round(CAST(min(v) AS double), 6) AS lower_middle, round(CAST(max(v) AS double), 6) AS upper_middle, max(n) AS n FROM k WHERE rn = (n + 1) // 2 OR rn = (n + 2) // 2",
)
def middle_rows(spark, sf_dir):
    df = to_decimal(opv(spark, sf_dir).select("cma2"), ["cma2"])
    sizes, found = order_statistics(df, lambda n: {(n - 1) // 2, n // 2}, ["cma2"], [0.5])
    n = sizes["cma2"]
    row = (float(found["cma2", (n - 1) // 2]), float(found["cma2", n // 2]), n)
    return rounded(spark.createDataFrame([row], "lower_middle double, upper_middle double, n bigint"), "lower_middle", "upper_middle")


@BOOK.add(
    "o1_descending_with_tie",
    f"WITH {OPV} SELECT material_code, count(*) AS batch_count FROM opv GROUP BY 1 ORDER BY 2 DESC, 1",
)
def descending(spark, sf_dir):
    return opv(spark, sf_dir).groupBy("material_code").agg(F.count(F.lit(1)).alias("batch_count")).orderBy(F.desc("batch_count"), "material_code")


@BOOK.add("o2_ascending_coverage", f"WITH {COUNTED} SELECT row_key, n_tests, CAST(7 - n_tests AS integer) AS imputed_tests FROM counted ORDER BY n_tests, row_key")
def ascending(spark, sf_dir):
    df = with_coverage(with_test_count(opv(spark, sf_dir), ATTRS), len(ATTRS))
    return df.select("row_key", "n_tests", "imputed_tests").orderBy("n_tests", "row_key")


@BOOK.add("o3_first_row", f"WITH {OPV} SELECT cma1, count(*) AS n FROM opv WHERE cma1 IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def first_row(spark, sf_dir):
    counted = opv(spark, sf_dir).filter("cma1 is not null").groupBy("cma1").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "cma1").limit(1)


@BOOK.add("o4_limit", f"WITH {COUNTED} SELECT row_key, n_tests FROM counted ORDER BY n_tests DESC, row_key LIMIT 10")
def limited(spark, sf_dir):
    df = opv(spark, sf_dir).select("row_key", present_count(ATTRS).alias("n_tests"))
    return preview(df, 10, F.desc("n_tests"), "row_key")


@BOOK.add(
    "o5_outliers_then_core",
    f"WITH {OPV}, {fences_sql('opv')}, flagged AS (SELECT row_key, {deviation_sql()} AS d FROM opv, fences WHERE cma2 < 10000)"
    " SELECT row_key, coalesce(d, 'Core') AS status, CASE WHEN d IS NULL THEN 1 ELSE 0 END AS draw_order FROM opv LEFT JOIN flagged USING (row_key)",
)
def outliers_then_core(spark, sf_dir):
    df = opv(spark, sf_dir)
    flagged = df.filter("cma2 < 10000").select("row_key", deviation_type(iqr_fences(df, FILLED)).alias("deviation_type"))
    return ordered_union(annotate_status(df.select("row_key"), flagged))

"""Counts, medians, modes, quantiles and indices."""

from pyspark.sql import functions as F

from batchlens.operators import components as pc
from batchlens.operators import evaluation as ev
from batchlens.operators.audit import audit_nulls
from batchlens.operators.cleaning import column_precision, mode_smallest, to_decimal
from batchlens.operators.coverage import coverage_distribution, non_null_counts, with_test_count
from batchlens.operators.fences import iqr_fences
from batchlens.operators.profiles import profile_frequency, profile_spectrum
from batchlens.operators.quantiles import (
    approx_quantiles,
    decimal_median,
    quantile_sketches,
    quantiles,
    rank_errors,
    sketch_quantiles,
)
from batchlens.operators.ranking import top_code, value_counts
from batchlens.sources import run_folder, settle, write_table
from queries.fixture import ATTRS, COUNTED, FILLED, OPV, Book, dec, fences_sql, median_sql, opv, rounded, table
from queries.joins import LABELS, PAIRS, labels, rand_sql
from queries.projections import PAIR, pair_model

BOOK = Book()


@BOOK.add("a1_top_material", f"WITH {OPV} SELECT material_code, count(*) AS batch_count FROM opv GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def top_material(spark, sf_dir):
    return top_code(opv(spark, sf_dir), "material_code")


@BOOK.add(
    "a1_top_component",
    f"WITH {OPV}, m AS (SELECT material_code FROM opv GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    " SELECT component_code, count(*) AS batch_count FROM opv WHERE material_code = (SELECT material_code FROM m) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
)
def top_component(spark, sf_dir):
    df = opv(spark, sf_dir)
    best = top_code(df, "material_code").first()["material_code"]
    return top_code(df.filter(F.col("material_code") == best), "component_code")


@BOOK.add("a2_non_null_counts", f"WITH {OPV} SELECT " + ", ".join(f"count({c}) AS {c}" for c in ATTRS) + " FROM opv")
def present(spark, sf_dir):
    return non_null_counts(opv(spark, sf_dir), ATTRS)


@BOOK.add("a3_distinct_values", f"WITH {OPV} SELECT DISTINCT material_batch_nr FROM opv")
def distinct_values(spark, sf_dir):
    return opv(spark, sf_dir).select("material_batch_nr").distinct()


@BOOK.add("a4_group_sizes", f"WITH {COUNTED} SELECT n_tests, count(*) AS batch_count FROM counted GROUP BY 1")
def group_sizes(spark, sf_dir):
    return coverage_distribution(with_test_count(opv(spark, sf_dir), ATTRS), 7).select("n_tests", "batch_count")


@BOOK.add("a5_value_counts", f"WITH {COUNTED} SELECT n_tests, count(*) AS n FROM counted GROUP BY 1")
def counts_by_value(spark, sf_dir):
    return value_counts(with_test_count(opv(spark, sf_dir), ATTRS), "n_tests")


_COMPLETE = "cma1 IS NOT NULL AND cma3 IS NOT NULL AND cma4 IS NOT NULL"


@BOOK.add("a6_profile_counts", f"WITH {OPV} SELECT cma1, cma3, cma4, count(*) AS frequency FROM opv WHERE {_COMPLETE} GROUP BY 1, 2, 3")
def profiles(spark, sf_dir):
    return profile_frequency(opv(spark, sf_dir), ["cma1", "cma3", "cma4"])


@BOOK.add(
    "a7_profile_spectrum",
    f"WITH {OPV}, p AS (SELECT count(*) AS frequency FROM opv WHERE {_COMPLETE} GROUP BY cma1, cma3, cma4) SELECT frequency, count(*) AS n_profiles FROM p GROUP BY 1",
)
def spectrum(spark, sf_dir):
    return profile_spectrum(opv(spark, sf_dir), ["cma1", "cma3", "cma4"])


@BOOK.add("a8_max_counter", f"WITH {COUNTED} SELECT max(n_tests) AS max_tests FROM counted")
def max_counter(spark, sf_dir):
    return with_test_count(opv(spark, sf_dir), ATTRS).agg(F.max("n_tests").alias("max_tests"))


@BOOK.add(
    "a9_decimal_median",
    f"WITH {OPV}, d AS MATERIALIZED (SELECT " + ", ".join(f"{dec(c)} AS {c}" for c in FILLED) + " FROM opv) "
    + " UNION ALL ".join(f"SELECT '{c}' AS attribute, round(CAST({median_sql('d', c)} AS double), 6) AS median" for c in FILLED),
)
def medians(spark, sf_dir):
    # Parsing is the dear part and the values are read three times: parse once.
    exact = settle(to_decimal(opv(spark, sf_dir).select(*FILLED), FILLED))
    return rounded(decimal_median(exact, FILLED), "median")


@BOOK.add(
    "a10_null_counts",
    f"WITH {OPV}, n AS (" + " UNION ALL ".join(f"SELECT '{c}' AS attribute, count(*) - count({c}) AS n_null FROM opv" for c in FILLED) + ") SELECT * FROM n WHERE n_null > 0",
)
def null_counts(spark, sf_dir):
    return audit_nulls(opv(spark, sf_dir), FILLED)


@BOOK.add(
    "a11_mode_smallest",
    f"WITH {OPV}, c AS (SELECT component_code, cma1, count(*) AS n FROM opv WHERE cma1 IS NOT NULL GROUP BY 1, 2),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY component_code ORDER BY n DESC, cma1) AS rn FROM c) SELECT component_code, cma1 AS mode FROM k WHERE rn = 1",
)
def mode(spark, sf_dir):
    return mode_smallest(opv(spark, sf_dir), ["component_code"], "cma1")


_PS = (0.03, 0.25, 0.5, 0.75, 0.9)


@BOOK.add(
    "a12_exact_quantiles",
    f"WITH {OPV} " + " UNION ALL ".join(
        f"SELECT '{c}' AS attribute, CAST({p} AS double) AS p, round(quantile_cont({c}, {p}), 6) AS value FROM opv" for c in FILLED for p in _PS
    ),
)
def exact_quantiles(spark, sf_dir):
    return rounded(quantiles(opv(spark, sf_dir), FILLED, _PS), "value")


@BOOK.add("a12_approximate_quantiles")
def estimated_quantiles(spark, sf_dir):
    return approx_quantiles(opv(spark, sf_dir), FILLED, _PS)


_EDGES = (0.0, *_PS, 0.99, 1.0)


_WITHIN = f"WITH {OPV} " + " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, CAST({p} AS double) AS p, count({c}) AS n, TRUE AS within FROM opv" for c in FILLED for p in _EDGES
)


@BOOK.add("a12_sketch_rank_error", _WITHIN)
def sketch_rank_error(spark, sf_dir):
    """Sketches of each shipping year, stored, read again and merged; their ranks against exact counts."""
    df, path = opv(spark, sf_dir).withColumn("year", F.substring("row_key", -8, 4)), run_folder(spark, "sketches")
    write_table(quantile_sketches(df, FILLED, accuracy=0.01, by=["year"]), path)
    errors = rank_errors(df, sketch_quantiles(spark.read.parquet(path), _EDGES))
    return errors.select("attribute", "p", "n", (F.col("error") <= 0.01).alias("within"))


@BOOK.add("a12_approximate_rank_error", _WITHIN)
def approximate_rank_error(spark, sf_dir):
    """Ranks of ``approx_quantiles`` against exact counts: within 1/accuracy, and half a row."""
    df = opv(spark, sf_dir)
    errors = rank_errors(df, approx_quantiles(df, FILLED, _EDGES, accuracy=10000))
    return errors.select("attribute", "p", "n", (F.col("error") <= F.lit(1 / 10000) + 1 / F.col("n")).alias("within"))


@BOOK.add(
    "a13_score_summary",
    f"WITH {OPV} " + " UNION ALL ".join(
        f"SELECT '{c}' AS scores, min({c}) AS score_min, max({c}) AS score_max, round(quantile_cont({c}, 0.5), 6) AS score_median, round(stddev_samp({c}), 6) AS score_std FROM opv"
        for c in ("cma2", "cma5")
    ),
)
def summary(spark, sf_dir):
    return rounded(ev.score_summary(opv(spark, sf_dir), ["cma2", "cma5"]), "score_median", "score_std")


@BOOK.add("a14_score_range", f"WITH {OPV} SELECT least(min(cma3), min(cma5)) AS global_min, greatest(max(cma3), max(cma5)) AS global_max FROM opv")
def span(spark, sf_dir):
    return ev.score_range(opv(spark, sf_dir), ["cma3", "cma5"])


@BOOK.add(
    "a15_conditional_counts",
    f"WITH {OPV}, {fences_sql('opv')} SELECT count(*) FILTER (cma2 < 10000) AS below_cutoff, "
    + ", ".join(f"count(*) FILTER ({c} < {c}_lo OR {c} > {c}_hi) AS {c}_outside" for c in FILLED) + " FROM opv, fences",
)
def conditional_counts(spark, sf_dir):
    df = opv(spark, sf_dir)
    fences = iqr_fences(df, FILLED)
    return df.agg(
        F.count_if(F.col("cma2") < 10000).alias("below_cutoff"),
        *[F.count_if(fences.outside(c)).alias(f"{c}_outside") for c in FILLED],
    )


@BOOK.add(
    "a16_median_index",
    f"WITH {LABELS}, {PAIRS} SELECT CAST(0.05 AS double) AS contamination, round(quantile_cont(ari, 0.5), 9) AS median_ari FROM ari",
)
def median_index(spark, sf_dir):
    marked = labels(spark, sf_dir).withColumn("contamination", F.lit(0.05))
    pairs = ev.stability_pairs(marked, [10, 20, 30, 40], key="o_orderkey")
    return rounded(ev.stability_summary(pairs), "median_ari", places=9)


@BOOK.add("a17_attribute_variance", f"WITH {OPV} " + " UNION ALL ".join(f"SELECT '{c}' AS attribute, round(var_samp({c}), 4) AS variance FROM opv" for c in FILLED))
def variance(spark, sf_dir):
    return rounded(pc.attribute_variance(opv(spark, sf_dir), FILLED), "variance", places=4)


@BOOK.add("a18_loading_weight", f"WITH {PAIR} SELECT attribute, round(sum(abs(loading)), 6) AS total_abs FROM loads GROUP BY 1")
def weight(spark, sf_dir):
    return rounded(pc.loading_weight(pair_model(spark, sf_dir)), "total_abs")


@BOOK.add(
    "a19_global_contribution",
    f"WITH {PAIR} SELECT attribute, round(sum(loading * loading * ratio), 6) AS contribution FROM loads JOIN ratios USING (pos) GROUP BY 1",
)
def contribution(spark, sf_dir):
    return rounded(pc.global_contribution(pair_model(spark, sf_dir)), "contribution")


@BOOK.add(
    "a20_adjusted_rand",
    "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS double) AS n FROM lineitem GROUP BY 1, 2),"
    " k AS (SELECT sum(n * (n - 1) / 2) AS c, sum(n) AS n FROM c),"
    " sa AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), sb AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b))"
    f" SELECT round({rand_sql('c', 'sa', 'sb', 'n')}, 9) AS ari FROM k, sa, sb",
)
def rand(spark, sf_dir):
    return rounded(ev.adjusted_rand(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"), "ari", places=9)


@BOOK.add(
    "a21_histogram",
    "WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),"
    " b AS (SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29) AS integer) AS bin, lo, hi FROM lineitem, m)"
    " SELECT bin, count(*) AS n, round(max(lo) + bin * ((max(hi) - max(lo)) / 30), 4) AS bin_from, round(max(lo) + (bin + 1) * ((max(hi) - max(lo)) / 30), 4) AS bin_to FROM b GROUP BY bin",
)
def score_histogram(spark, sf_dir):
    return rounded(ev.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "bin_from", "bin_to", places=4)


def _box_sql(source: str, by: str, value: str) -> str:
    return (
        f"WITH q AS (SELECT {by}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS med, quantile_cont({value}, 0.75) AS q3 FROM {source} GROUP BY 1)"
        f" SELECT {by}, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,"
        f" round(min({value}) FILTER ({value} >= q1 - 1.5 * (q3 - q1) AND {value} <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,"
        f" round(max({value}) FILTER ({value} >= q1 - 1.5 * (q3 - q1) AND {value} <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,"
        f" count(*) FILTER ({value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1)) AS n_fliers"
        f" FROM {source} JOIN q USING ({by}) GROUP BY {by}, q1, med, q3"
    )


_BOX = ("q1", "median", "q3", "whisker_low", "whisker_high")


@BOOK.add("a22_box_summary", _box_sql("events", "event_type", "value"))
def box(spark, sf_dir):
    return rounded(ev.box_summary(table(spark, sf_dir, "events"), "event_type", "value"), *_BOX)


@BOOK.add("a22_box_of_every_part", _box_sql("lineitem", "l_partkey", "l_extendedprice"))
def box_of_every_part(spark, sf_dir):
    # A group for each part; none of them is large.
    return rounded(ev.box_summary(table(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice"), *_BOX)


@BOOK.add("a22_box_of_large_groups", _box_sql("lineitem", "l_returnflag", "l_extendedprice"))
def box_of_large_groups(spark, sf_dir):
    # Groups above 512 values are cut by sketches and counts, round by round.
    return rounded(ev.box_summary(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", examine=512), *_BOX)


@BOOK.add(
    "a11_precision_modes",
    f"WITH {OPV}, long AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS attribute, length(regexp_extract(rtrim(CAST({dec(c)} AS varchar), '0'), '[.](.*)$', 1)) AS p FROM opv WHERE {c} IS NOT NULL" for c in FILLED
    ) + "), c AS (SELECT attribute, p, count(*) AS n FROM long GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, p) AS rn FROM c)"
    " SELECT attribute, CAST(greatest(p, 1) AS integer) AS places FROM k WHERE rn = 1",
)
def precision_modes(spark, sf_dir):
    return column_precision(to_decimal(opv(spark, sf_dir).select(*FILLED), FILLED), FILLED)



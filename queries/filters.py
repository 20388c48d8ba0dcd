"""Filters and audits."""

from pyspark.sql import functions as F

from batchlens.functions import finite_only
from batchlens.operators.audit import audit_alignment, audit_nulls, audit_types
from batchlens.operators.coverage import drop_empty_columns, prune_report, with_test_count
from batchlens.operators.evaluation import label_outliers, outlier_keys, select_outliers
from batchlens.operators.fences import attribute_flags, iqr_fences
from batchlens.operators.coverage import prune_low_coverage
from batchlens.operators.cleaning import impute_median
from batchlens.plans import focus_slice
from queries.fixture import (
    ATTRS,
    COUNTED,
    FILLED,
    IDS,
    WHOLE_IMPUTED,
    OPV,
    SLICE,
    Book,
    fences_sql,
    opv,
    pruned,
    quantile_sql,
    r,
    table,
)

BOOK = Book()


@BOOK.add("f1_one_code", f"WITH {OPV} SELECT row_key, component_code, cma4 FROM opv WHERE material_code = 'Brand#7'")
def one_code(spark, sf_dir):
    return opv(spark, sf_dir).filter(F.col("material_code") == "Brand#7").select("row_key", "component_code", "cma4")


@BOOK.add("f2_focus_slice", f"WITH {SLICE} SELECT row_key, {', '.join(IDS)}, {', '.join(FILLED)} FROM slice")
def focus(spark, sf_dir):
    return focus_slice(opv(spark, sf_dir)).select("row_key", *IDS, *FILLED)


@BOOK.add("f3_drop_empty_columns", f"WITH {SLICE} SELECT row_key, {', '.join(IDS)}, {', '.join(FILLED)} FROM slice")
def drop_empty(spark, sf_dir):
    return drop_empty_columns(focus_slice(opv(spark, sf_dir)))


@BOOK.add(
    "f4_prune_low_coverage",
    f"WITH {COUNTED} SELECT row_key, n_tests FROM counted WHERE n_tests >= 0.6 * (SELECT max(n_tests) FROM counted)",
)
def prune(spark, sf_dir):
    return prune_low_coverage(with_test_count(opv(spark, sf_dir), ATTRS)).select("row_key", "n_tests")


@BOOK.add(
    "f4_prune_report",
    f"WITH {COUNTED}, t AS (SELECT max(n_tests) AS m FROM counted) SELECT CAST(max(m) AS bigint) AS max_tests,"
    " round(CAST(0.6 * max(m) AS double), 6) AS threshold, count(*) AS rows_before, count(*) FILTER (n_tests >= 0.6 * m) AS rows_after,"
    " count(*) FILTER (n_tests < 0.6 * m) AS rows_dropped FROM counted, t",
)
def prune_counts(spark, sf_dir):
    report = prune_report(with_test_count(opv(spark, sf_dir), ATTRS))
    return report.withColumn("threshold", r("threshold"))


@BOOK.add("f5_drop_missing", f"WITH {OPV} SELECT row_key, cma6 FROM opv WHERE cma6 IS NOT NULL")
def drop_missing(spark, sf_dir):
    return opv(spark, sf_dir).filter("cma6 is not null").select("row_key", "cma6")


@BOOK.add(
    "f6_finite_scores",
    "SELECT l_orderkey, l_partkey, l_linenumber, round(ln(l_discount), 6) AS score FROM lineitem WHERE l_discount > 0",
)
def finite(spark, sf_dir):
    # log of a zero discount: minus infinity, as a score would be in a broken model
    score = F.when(F.col("l_discount") > 0, F.ln("l_discount")).otherwise(F.lit(float("-inf")))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", finite_only(score).alias("score"))
    return df.filter("score is not null").withColumn("score", r("score"))


_LOW = "low AS (SELECT row_key FROM opv WHERE cma2 < 2000)"


@BOOK.add("f7_rows_by_key_list", f"WITH {OPV}, {_LOW} SELECT row_key, {', '.join(FILLED)} FROM opv WHERE row_key IN (SELECT row_key FROM low)")
def by_key_list(spark, sf_dir):
    df = opv(spark, sf_dir)
    return select_outliers(df, df.filter("cma2 < 2000").select("row_key")).select("row_key", *FILLED)


@BOOK.add(
    "f8_outlier_keys",
    f"WITH {OPV}, cut AS (SELECT {quantile_sql('opv', 'cma2', 0.05)} AS c), low AS (SELECT row_key FROM opv, cut WHERE cma2 < c)"
    " SELECT row_key, (SELECT count(*) FROM low) AS n_outliers FROM low",
)
def keys_of_outliers(spark, sf_dir):
    return outlier_keys(label_outliers(opv(spark, sf_dir).select("row_key", "cma2"), 0.05, "cma2"))


@BOOK.add(
    "f9_positive_counts",
    f"WITH {OPV}, {fences_sql('opv')}, n AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS attribute, count(*) FILTER ({c} < {c}_lo OR {c} > {c}_hi) AS times_flagged FROM opv, fences WHERE cma4 >= 0.07" for c in FILLED)
    + ") SELECT * FROM n WHERE times_flagged > 0",
)
def positive_counts(spark, sf_dir):
    df = opv(spark, sf_dir)
    return attribute_flags(df.filter("cma4 >= 0.07"), iqr_fences(df, FILLED))


_RAW = """raw AS (SELECT CASE WHEN l_linenumber = 3 THEN concat('n/a ', l_suppkey) WHEN l_linenumber = 4 THEN ' ' ELSE CAST(l_quantity AS varchar) END AS cma1,
 CASE WHEN l_suppkey = 7 THEN '<0.1' ELSE CAST(l_discount AS varchar) END AS cma3, CAST(l_tax AS varchar) AS cma4 FROM lineitem)"""


@BOOK.add(
    "f10_type_audit",
    f"WITH {_RAW}, long AS (SELECT 'cma1' AS attribute, cma1 AS raw FROM raw UNION ALL SELECT 'cma3', cma3 FROM raw UNION ALL SELECT 'cma4', cma4 FROM raw),"
    " bad AS (SELECT * FROM long WHERE raw IS NOT NULL AND trim(raw) <> '' AND TRY_CAST(trim(raw) AS decimal(38,18)) IS NULL),"
    " ranked AS (SELECT attribute, raw, row_number() OVER (PARTITION BY attribute ORDER BY raw) AS rn FROM (SELECT DISTINCT attribute, raw FROM bad))"
    " SELECT attribute, count(*) AS n_bad, (SELECT string_agg(raw, ', ' ORDER BY raw) FROM ranked WHERE rn <= 3 AND ranked.attribute = bad.attribute) AS examples"
    " FROM bad GROUP BY attribute",
)
def type_audit(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") == 3, F.concat(F.lit("n/a "), F.col("l_suppkey").cast("string")))
        .when(F.col("l_linenumber") == 4, F.lit(" "))
        .otherwise(F.col("l_quantity").cast("string"))
        .alias("cma1"),
        F.when(F.col("l_suppkey") == 7, F.lit("<0.1")).otherwise(F.col("l_discount").cast("string")).alias("cma3"),
        F.col("l_tax").cast("string").alias("cma4"),
    )
    return audit_types(raw, ["cma1", "cma3", "cma4"])


@BOOK.add(
    "f11_null_audit",
    f"WITH {OPV}, n AS (" + " UNION ALL ".join(f"SELECT '{c}' AS attribute, count(*) FILTER ({c} IS NULL) AS n_null FROM opv" for c in ATTRS)
    + ") SELECT * FROM n WHERE n_null > 0",
)
def null_audit(spark, sf_dir):
    return audit_nulls(opv(spark, sf_dir), ATTRS)


@BOOK.add(
    "f11_nulls_after_imputation",
    f"WITH {WHOLE_IMPUTED}, n AS (" + " UNION ALL ".join(f"SELECT '{c}' AS attribute, count(*) FILTER ({c} IS NULL) AS n_null FROM imputed" for c in FILLED)
    + ") SELECT * FROM n WHERE n_null > 0",
)
def nulls_after_imputation(spark, sf_dir):
    return audit_nulls(impute_median(pruned(spark, sf_dir), FILLED), FILLED)


@BOOK.add(
    "f12_alignment_audit",
    f"WITH {OPV}, b AS (SELECT {', '.join(IDS)} FROM opv WHERE cma4 > 0),"
    f" l AS (SELECT {', '.join(IDS)} FROM opv EXCEPT ALL SELECT * FROM b), rr AS (SELECT * FROM b EXCEPT ALL SELECT {', '.join(IDS)} FROM opv)"
    " SELECT (SELECT count(*) FROM l) AS only_left, (SELECT count(*) FROM rr) AS only_right,"
    " (SELECT count(*) FROM l) = 0 AND (SELECT count(*) FROM rr) = 0 AS aligned",
)
def alignment(spark, sf_dir):
    df = opv(spark, sf_dir)
    return audit_alignment(df, df.filter("cma4 > 0"), IDS)

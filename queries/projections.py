"""Renames, casts and column expressions."""

from pyspark.sql import functions as F

from batchlens.functions import (
    decimal_places,
    percent_label,
    present_count,
    round_half_up,
)
from batchlens.operators import components as pc
from batchlens.operators.cleaning import to_decimal, to_double
from batchlens.operators.coverage import coverage_distribution, with_coverage, with_test_count
from batchlens.operators.fences import deviation_type, iqr_fences
from batchlens.operators.profiles import frequent_or_rare, profile_counts, profile_group, with_profile
from batchlens.operators.ranking import category_code
from batchlens.operators.reporting import PROFILE_COLOURS, STATUS_COLOURS, annotate_status, jitter, with_colour
from batchlens.operators.roles import Roles, canonical_names, cast_roles, order_columns, prefix_columns
from batchlens.operators.audit import row_digests
from queries.fixture import ATTRS, COUNTED, FILLED, IDS, OPV, WHOLE_DOUBLES, Book, dec, deviation_sql, fences_sql, filled, opv, r, rounded, table

BOOK = Book()
_IDS, _ATTRS, _FILLED = ", ".join(IDS), ", ".join(ATTRS), ", ".join(FILLED)


@BOOK.add("p1_rename", f"WITH {OPV} SELECT row_key, {_IDS}, {_ATTRS} FROM opv")
def rename(spark, sf_dir):
    titled = opv(spark, sf_dir).withColumnsRenamed({**{c: c.replace("_", " ").title() for c in IDS}, "material_batch_nr": "Batch Nr"})
    return canonical_names(titled, {"Batch Nr": "Material Batch Nr"})


@BOOK.add("p2_drop", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def drop(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").drop("l_returnflag", "l_linestatus", "l_shipdate")


@BOOK.add("p3_reorder", f"WITH {COUNTED} SELECT {_IDS}, n_tests, row_key, {_ATTRS} FROM counted")
def reorder(spark, sf_dir):
    return order_columns(with_test_count(opv(spark, sf_dir), ATTRS), [*IDS, "n_tests"])


@BOOK.add("p4_role_split", f"WITH {OPV} SELECT {_ATTRS} FROM opv")
def role_split(spark, sf_dir):
    df = opv(spark, sf_dir)
    return df.select(*Roles().features(df))


@BOOK.add("p5_prefix_columns", f"WITH {OPV} SELECT {_ATTRS} FROM opv")
def by_prefix(spark, sf_dir):
    df = opv(spark, sf_dir)
    return df.select(*prefix_columns(df, "cma"))


@BOOK.add("p6_attribute_subset", f"WITH {OPV} SELECT row_key, cma1, cma3, cma5 FROM opv")
def subset(spark, sf_dir):
    return opv(spark, sf_dir).select("row_key", "cma1", "cma3", "cma5")


@BOOK.add(
    "p7_cast_by_role",
    "SELECT CAST(l_orderkey AS varchar) AS material_batch_nr, CAST(l_partkey AS varchar) AS component_code,"
    " l_linenumber AS n_tests, l_quantity AS cma1, l_extendedprice AS cma2 FROM lineitem",
)
def cast_by_role(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("material_batch_nr"),
        F.col("l_partkey").alias("component_code"),
        F.col("l_linenumber").cast("string").alias("n_tests"),
        F.col("l_quantity").cast("string").alias("cma1"),
        F.col("l_extendedprice").cast("string").alias("cma2"),
    )
    return cast_roles(raw)


@BOOK.add(
    "p8_cast_ids",
    "SELECT CAST(l_orderkey AS varchar) AS material_batch_nr, l_linenumber AS n_tests, CAST(l_tax AS varchar) AS cma4 FROM lineitem",
)
def cast_ids(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("material_batch_nr"),
        F.col("l_linenumber").cast("bigint").alias("n_tests"),
        F.col("l_tax").cast("string").alias("cma4"),
    )
    return cast_roles(raw, attribute_type=None)


@BOOK.add(
    "p9_blank_to_decimal",
    f"WITH {OPV} SELECT row_key, round(CAST({dec('cma1')} AS double), 6) AS cma1, round(CAST({dec('cma2')} AS double), 6) AS cma2,"
    " CAST(NULL AS double) AS cma7 FROM opv",
)
def blank_to_decimal(spark, sf_dir):
    text = opv(spark, sf_dir).select(
        "row_key",
        F.coalesce(F.concat(F.lit(" "), F.col("cma1").cast("string")), F.lit(" ")).alias("cma1"),
        F.coalesce(F.col("cma2").cast("string"), F.lit("   ")).alias("cma2"),
        F.lit("").alias("cma7"),
    )
    return rounded(to_decimal(text, ["cma1", "cma2", "cma7"]), "cma1", "cma2", "cma7")


@BOOK.add("p10_decimal_to_double", f"WITH {OPV} SELECT row_key, {_FILLED} FROM opv")
def decimal_to_double(spark, sf_dir):
    return to_double(to_decimal(opv(spark, sf_dir).select("row_key", *FILLED), FILLED), FILLED)


@BOOK.add("p11_tests_per_row", f"WITH {COUNTED} SELECT row_key, n_tests FROM counted")
def tests_per_row(spark, sf_dir):
    return with_test_count(opv(spark, sf_dir), ATTRS).select("row_key", "n_tests")


@BOOK.add(
    "p12_coverage_shares",
    f"WITH {COUNTED} SELECT row_key, n_tests, CAST(7 - n_tests AS integer) AS imputed_tests,"
    " round(n_tests / 7.0, 6) AS share_original, round(1 - n_tests / 7.0, 6) AS share_imputed FROM counted",
)
def coverage_shares(spark, sf_dir):
    df = with_coverage(with_test_count(opv(spark, sf_dir), ATTRS), len(ATTRS))
    return rounded(df, "share_original", "share_imputed").select("row_key", "n_tests", "imputed_tests", "share_original", "share_imputed")


@BOOK.add(
    "p13_stack_heights",
    f"WITH {COUNTED} SELECT n_tests, round(n_tests / 7.0 * 7, 6) AS height_original, round((1 - n_tests / 7.0) * 7, 6) AS height_imputed"
    " FROM counted GROUP BY n_tests",
)
def stack_heights(spark, sf_dir):
    df = coverage_distribution(with_test_count(opv(spark, sf_dir), ATTRS), len(ATTRS))
    return rounded(df, "height_original", "height_imputed").select("n_tests", "height_original", "height_imputed")


@BOOK.add(
    "p14_percent_label",
    f"WITH {COUNTED} SELECT row_key, concat(CAST(CAST(round_even(CAST(n_tests AS double) / 7 * 100, 0) AS integer) AS varchar), '%') AS percent FROM counted",
)
def percent(spark, sf_dir):
    return opv(spark, sf_dir).select("row_key", percent_label(present_count(ATTRS), len(ATTRS)).alias("percent"))


def _places_sql(expression: str) -> str:
    return f"length(regexp_extract(rtrim(CAST({dec(expression)} AS varchar), '0'), '[.](.*)$', 1))"


@BOOK.add(
    "p15_decimal_places",
    "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
        f"CAST({_places_sql(c)} AS integer) AS {n}"
        for c, n in (("l_quantity", "quantity_places"), ("l_extendedprice", "price_places"), ("l_discount", "discount_places"))
    ) + " FROM lineitem",
)
def places(spark, sf_dir):
    df = to_decimal(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        decimal_places(F.col("l_quantity")).alias("quantity_places"),
        decimal_places(F.col("l_extendedprice")).alias("price_places"),
        decimal_places(F.col("l_discount")).alias("discount_places"),
    )


@BOOK.add(
    "p16_round_half_up",
    f"WITH {OPV} SELECT row_key, round(CAST(round({dec('cma2')}, 1) AS double), 6) AS cma2, round(CAST(round({dec('cma3')}, 1) AS double), 6) AS cma3 FROM opv",
)
def half_up(spark, sf_dir):
    df = to_decimal(opv(spark, sf_dir).select("row_key", "cma2", "cma3"), ["cma2", "cma3"])
    return df.select("row_key", *[r(round_half_up(F.col(c), 1)).alias(c) for c in ("cma2", "cma3")])


@BOOK.add(
    "p17_row_digest",
    f"WITH {OPV} SELECT {_IDS}, md5(concat_ws('|', {_IDS})) AS row_digest FROM opv",
)
def digest(spark, sf_dir):
    return row_digests(opv(spark, sf_dir), IDS)


# -- two strongly correlated columns, whose components are known in closed form --------

PAIR = """pair AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS row_key,
         l_extendedprice AS gross, l_extendedprice * (1 - l_discount) AS net FROM lineitem),
moments AS (SELECT corr(gross, net) AS r, avg(gross) AS mg, stddev_pop(gross) AS sg, avg(net) AS mn, stddev_pop(net) AS sn FROM pair),
loads AS (
  SELECT 'gross' AS attribute, 1 AS pos, sqrt(0.5) AS loading UNION ALL SELECT 'net', 1, sign(r) * sqrt(0.5) FROM moments
  UNION ALL SELECT 'gross', 2, sqrt(0.5) UNION ALL SELECT 'net', 2, -sign(r) * sqrt(0.5) FROM moments),
ratios AS (SELECT 1 AS pos, (1 + abs(r)) / 2 AS ratio FROM moments UNION ALL SELECT 2, (1 - abs(r)) / 2 FROM moments)"""


def pair(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd")).alias("row_key"),
        F.col("l_extendedprice").alias("gross"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("net"),
    )


def pair_model(spark, sf_dir, keep=1.0):
    return pc.fit_pca(pc.standardize(pair(spark, sf_dir), ["gross", "net"]), ["gross", "net"], keep)


@BOOK.add("p18_absolute_loading", f"WITH {PAIR} SELECT attribute, concat('PC', pos) AS component, round(abs(loading), 6) AS abs_loading FROM loads")
def absolute_loading(spark, sf_dir):
    return pc.loadings(pair_model(spark, sf_dir)).select("attribute", "component", r(F.abs("loading")).alias("abs_loading"))


@BOOK.add(
    "p19_weighted_square",
    f"WITH {PAIR} SELECT attribute, concat('PC', pos) AS component, round(loading * loading * ratio, 6) AS weighted FROM loads JOIN ratios USING (pos)",
)
def weighted_square(spark, sf_dir):
    model = pair_model(spark, sf_dir)
    both = pc.loadings(model).join(pc.explained_variance(model), "component")
    return both.select("attribute", "component", r(F.col("loading") * F.col("loading") * F.col("ratio")).alias("weighted"))


@BOOK.add("p20_axis_label", f"WITH {PAIR} SELECT pos AS position, format('PC {{:d}} ({{:.1f}}%)', pos, ratio * 100) AS label FROM ratios")
def axis_label(spark, sf_dir):
    return pc.scree(pair_model(spark, sf_dir)).select("position", "label")


@BOOK.add("p21_literal_column", f"WITH {OPV} SELECT row_key, 'IsolationForest' AS flagged_by, 'Core' AS status FROM opv")
def literal_column(spark, sf_dir):
    return opv(spark, sf_dir).select("row_key", F.lit("IsolationForest").alias("flagged_by"), F.lit("Core").alias("status"))


_STATUS = f"WITH {WHOLE_DOUBLES}, {fences_sql('filled')}, flagged AS (SELECT row_key, {deviation_sql()} AS deviation_type FROM filled, fences WHERE cma1 >= 45)"


def _status(spark, sf_dir):
    df = filled(spark, sf_dir)
    flagged = df.filter("cma1 >= 45").select("row_key", deviation_type(iqr_fences(df, FILLED)).alias("deviation_type"))
    return annotate_status(df, flagged)


@BOOK.add("p22_fill_category", _STATUS + " SELECT filled.row_key, coalesce(deviation_type, 'Core') AS status FROM filled LEFT JOIN flagged USING (row_key)")
def fill_category(spark, sf_dir):
    return _status(spark, sf_dir).select("row_key", "status")


_PROFILE = "l_quantity", "l_discount", "l_tax"
_KEYED = """keyed AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS row_key,
 l_quantity, l_discount, l_tax FROM lineitem),
freq AS (SELECT l_quantity, l_discount, l_tax, count(*) AS frequency FROM keyed GROUP BY ALL),
named AS (SELECT *, concat('CMA_Profile_', row_number() OVER (ORDER BY frequency DESC, l_quantity, l_discount, l_tax) - 1) AS profile_id FROM freq),
grouped AS (SELECT *, CASE WHEN frequency = 1 THEN 'Rare_Profile' ELSE profile_id END AS profile_group FROM keyed JOIN named USING (l_quantity, l_discount, l_tax))"""


def _keyed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd")).alias("row_key"), *_PROFILE
    )


@BOOK.add("p23_frequent_rare", f"WITH {_KEYED} SELECT row_key, frequency, CASE WHEN frequency > 5 THEN 'Frequent' ELSE 'Rare' END AS profile_group FROM grouped")
def frequent_rare(spark, sf_dir):
    return frequent_or_rare(_keyed(spark, sf_dir), _PROFILE).select("row_key", "frequency", "profile_group")


@BOOK.add("p24_singleton_group", f"WITH {_KEYED} SELECT row_key, profile_group FROM grouped")
def singleton_group(spark, sf_dir):
    df = _keyed(spark, sf_dir)
    return profile_group(with_profile(df, profile_counts(df, _PROFILE), _PROFILE), "singleton").select("row_key", "profile_group")


@BOOK.add(
    "p25_colour_lookup",
    _STATUS + " SELECT filled.row_key, CASE coalesce(deviation_type, 'Core') WHEN 'Core' THEN '#7f7f7f' WHEN 'Univariate deviation' THEN 'red' ELSE 'gold' END AS colour"
    " FROM filled LEFT JOIN flagged USING (row_key)",
)
def colour_lookup(spark, sf_dir):
    return with_colour(_status(spark, sf_dir), "status", STATUS_COLOURS).select("row_key", "colour")


@BOOK.add(
    "p25_profile_colour",
    f"WITH {_KEYED} SELECT row_key, CASE WHEN frequency > 5 THEN '#7f7f7f' ELSE '#1f4e79' END AS colour FROM grouped",
)
def profile_colour(spark, sf_dir):
    return with_colour(frequent_or_rare(_keyed(spark, sf_dir), _PROFILE), "profile_group", PROFILE_COLOURS).select("row_key", "colour")


@BOOK.add(
    "p26_category_code",
    f"WITH {OPV}, first AS (SELECT component_code, min(row_key) AS f FROM opv GROUP BY component_code),"
    " codes AS (SELECT component_code, CAST(row_number() OVER (ORDER BY f) - 1 AS integer) AS code FROM first)"
    " SELECT row_key, component_code, code FROM opv JOIN codes USING (component_code)",
)
def code_by_first(spark, sf_dir):
    return category_code(opv(spark, sf_dir).select("row_key", "component_code"), "component_code", "row_key")


def gauss_sql(*parts: str) -> str:
    digest = f"md5(concat_ws('|', {', '.join(parts)}))"
    word = lambda i: f"((CAST('0x' || substr({digest}, {8 * i + 1}, 8) AS bigint) + 1) / CAST(4294967297 AS double))"
    return f"sqrt(-2.0 * ln({word(0)})) * cos(2.0 * pi() * {word(1)})"


@BOOK.add(
    "p27_jitter",
    f"WITH {OPV} SELECT row_key, round(cma4 + 0.03 * {gauss_sql('42', chr(39) + 'cma4' + chr(39), 'row_key')}, 6) AS cma4_jittered,"
    f" round(cma5 + 0.03 * {gauss_sql('42', chr(39) + 'cma5' + chr(39), 'row_key')}, 6) AS cma5_jittered FROM opv",
)
def jittered(spark, sf_dir):
    df = jitter(opv(spark, sf_dir), ["cma4", "cma5"], 0.03, 42)
    return rounded(df, "cma4_jittered", "cma5_jittered").select("row_key", "cma4_jittered", "cma5_jittered")

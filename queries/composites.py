"""The composed operators: masking, cleaning, components, fences, profiles, charts."""

from pyspark.sql import functions as F

from batchlens.operators import components as pc
from batchlens.operators.cleaning import column_precision, normalize_precision, precision_table
from batchlens.operators.coverage import coverage_distribution, coverage_percent, with_test_count
from batchlens.operators.fences import (
    attribute_flags,
    deviation_summary,
    deviation_type,
    fence_mask,
    fence_table,
    iqr_fences,
)
from batchlens.operators.masking import mask
from batchlens.operators.profiles import coded_profiles, frequent_or_rare
from batchlens.operators.reporting import annotate_status, attach, flagged_report, projection_frame
from batchlens.operators.roles import prefix_columns
from batchlens.plans import clean, curate, fence_screen
from batchlens.plans.detect import component_scores
from batchlens.sources import read_batches, run_folder, settle, write_mappings
from queries.fixture import (
    ATTRS,
    COUNTED,
    FILLED,
    FILLED_DOUBLES,
    IDS,
    IMPUTED,
    OPV,
    SLICE,
    WHOLE_DOUBLES,
    WHOLE_IMPUTED,
    Book,
    deviation_sql,
    fences_sql,
    filled,
    imputed,
    opv,
    outside_sql,
    r,
    rounded,
    table,
)
from queries.projections import PAIR, _KEYED, _PROFILE, _keyed, gauss_sql, pair, pair_model

BOOK = Book()
_IDS, _FILLED = ", ".join(IDS), ", ".join(FILLED)


def _mask_sql(order: dict[str, str]) -> str:
    maps = []
    for col, prefix in (("material_code", "M"), ("component_code", "C"), ("material_batch_nr", "MB"), ("component_batch_nr", "CB")):
        maps.append(
            f"map_{col} AS (SELECT v, concat('{prefix}', row_number() OVER (ORDER BY {order['by']})) AS m"
            f" FROM (SELECT {col} AS v, min(row_key) AS f FROM opv WHERE {col} IS NOT NULL GROUP BY {col}))"
        )
    joins = " ".join(f"LEFT JOIN map_{c} ON map_{c}.v = opv.{c}" for c in IDS)
    cols = ", ".join(f"map_{c}.m AS {c}" for c in IDS) + ", " + ", ".join(f"{c} AS CMA{i}" for i, c in enumerate(ATTRS, 1))
    return f"WITH {OPV}, {', '.join(maps)} SELECT opv.row_key, {cols} FROM opv {joins}"


@BOOK.add("m1_mask", _mask_sql({"by": "v"}))
def masked(spark, sf_dir):
    return mask(opv(spark, sf_dir))[0]


@BOOK.add("m1_mask_off", f"WITH {OPV} SELECT row_key, {_IDS}, {', '.join(ATTRS)} FROM opv")
def unmasked(spark, sf_dir):
    return mask(opv(spark, sf_dir), on=False)[0]


@BOOK.add("m2_mask_by_appearance", _mask_sql({"by": "f, v"}))
def masked_by_appearance(spark, sf_dir):
    return mask(opv(spark, sf_dir), order_by="row_key")[0]


def _next_batch_sql() -> str:
    """Codes of the first batch by value, those that the second adds numbered behind them."""
    maps = []
    for c, prefix in zip(IDS, ("M", "C", "MB", "CB")):
        maps.append(
            f"map_{c} AS (SELECT v, concat('{prefix}', row_number() OVER (ORDER BY b, v)) AS m"
            f" FROM (SELECT {c} AS v, min(CASE WHEN right(row_key, 8) < '19950101' THEN 1 ELSE 2 END) AS b FROM opv WHERE {c} IS NOT NULL GROUP BY {c}))"
        )
    joins = " ".join(f"LEFT JOIN map_{c} ON map_{c}.v = opv.{c}" for c in IDS)
    cols = ", ".join(f"map_{c}.m AS {c}" for c in IDS) + ", " + ", ".join(f"{c} AS CMA{i}" for i, c in enumerate(ATTRS, 1))
    return f"WITH {OPV}, {', '.join(maps)} SELECT opv.row_key, {cols} FROM opv {joins}"


@BOOK.add("m1_mask_next_batch", _next_batch_sql())
def masked_in_batches(spark, sf_dir):
    """What was shipped before 1995 is masked first, its mappings are stored, and the rest extends them."""
    df, path = opv(spark, sf_dir), run_folder(spark, "mappings")
    early = F.substring("row_key", -8, 8) < "19950101"
    first, mappings = mask(df.filter(early))
    write_mappings({c: mappings[c] for c in IDS}, path)
    stored = {c: read_batches(spark, f"{path}/{c}", schema="original string, masked string") for c in IDS}
    return first.unionByName(mask(df.filter(~early), stored=stored)[0])


def _as_double(source: str) -> str:
    return ", ".join(f"round(CAST({c} AS double), 6) AS {c}" for c in FILLED) + f" FROM {source}"


@BOOK.add("m3_impute_median", f"WITH {WHOLE_IMPUTED} SELECT row_key, {_IDS}, n_tests, {_as_double('imputed')}")
def median_imputation(spark, sf_dir):
    return rounded(imputed(spark, sf_dir), *FILLED)


_PLACES = lambda c: f"length(regexp_extract(rtrim(CAST({c} AS varchar), '0'), '[.](.*)$', 1))"


@BOOK.add("m4_precision_table", f"WITH {WHOLE_IMPUTED} SELECT round(CAST(cma2 AS double), 6) AS value, CAST({_PLACES('cma2')} AS integer) AS places FROM imputed")
def precision_of_one(spark, sf_dir):
    return rounded(precision_table(imputed(spark, sf_dir), "cma2"), "value")


@BOOK.add(
    "m4_precision_of_column",
    f"WITH {WHOLE_IMPUTED}, c AS (SELECT {_PLACES('cma2')} AS p, count(*) AS n FROM imputed GROUP BY 1)"
    " SELECT 'cma2' AS attribute, CAST(greatest(p, 1) AS integer) AS places FROM c ORDER BY n DESC, p LIMIT 1",
)
def precision_mode(spark, sf_dir):
    return column_precision(imputed(spark, sf_dir), ["cma2"])


_MODES = ", ".join(
    f"places_{c} AS MATERIALIZED (SELECT greatest(p, 1) AS p FROM (SELECT {_PLACES(c)} AS p, count(*) AS n FROM imputed GROUP BY 1) ORDER BY n DESC, places_rank LIMIT 1)".replace("places_rank", "p")
    for c in FILLED
)
_ROUND = lambda c: f"round(CAST(CASE (SELECT p FROM places_{c}) " + " ".join(f"WHEN {k} THEN CAST(round({c}, {k}) AS decimal(38,18))" for k in range(1, 7)) + f" ELSE {c} END AS double), 6) AS {c}"


@BOOK.add("m5_normalize_precision", f"WITH {WHOLE_IMPUTED}, {_MODES} SELECT row_key, {', '.join(_ROUND(c) for c in FILLED)} FROM imputed")
def normalized(spark, sf_dir):
    df, _ = normalize_precision(imputed(spark, sf_dir), FILLED)
    return rounded(df.select("row_key", *FILLED), *FILLED)


@BOOK.add("m5_precision_summary", f"WITH {WHOLE_IMPUTED}, {_MODES} " + " UNION ALL ".join(f"SELECT '{c}' AS attribute, CAST(p AS integer) AS places FROM places_{c}" for c in FILLED))
def precision_summary(spark, sf_dir):
    return normalize_precision(imputed(spark, sf_dir), FILLED)[1]


_CLEAN = f"WITH {IMPUTED}, {_MODES}, clean AS MATERIALIZED (SELECT row_key, {_IDS}, {', '.join(_ROUND(c) for c in FILLED)} FROM imputed)"


@BOOK.add("m6_clean", _CLEAN + f" SELECT row_key, {_IDS}, {_FILLED} FROM clean")
def cleaned(spark, sf_dir):
    df, _ = clean(curate(opv(spark, sf_dir)))
    return rounded(df, *FILLED)


@BOOK.add(
    "m6_curate",
    f"WITH {SLICE} SELECT row_key, {_IDS}, CAST(n_tests AS integer) AS n_tests, {_FILLED} FROM slice",
)
def curated(spark, sf_dir):
    return curate(opv(spark, sf_dir))


@BOOK.add(
    "m7_standardize",
    "WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS sa, avg(l_tax) AS b, stddev_pop(l_tax) AS sb FROM lineitem)"
    " SELECT l_orderkey, l_partkey, l_linenumber, round((l_quantity - a) / sa, 6) AS l_quantity, round((l_tax - b) / sb, 6) AS l_tax, CAST(0 AS double) AS flat FROM lineitem, m",
)
def standardized(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax", F.lit(7.0).alias("flat"))
    return rounded(pc.standardize(df, ["l_quantity", "l_tax", "flat"]), "l_quantity", "l_tax", "flat")


@BOOK.add(
    "m8_components_kept",
    f"WITH {PAIR}, k AS (SELECT pos, ratio, sum(ratio) OVER (ORDER BY pos) - ratio AS before FROM ratios) SELECT pos AS position, round(ratio, 6) AS ratio FROM k WHERE before <= 0.95",
)
def components_kept(spark, sf_dir):
    return rounded(pc.explained_variance(pair_model(spark, sf_dir, 0.95)), "ratio").select("position", "ratio")


def _embedding_model(spark, sf_dir, keep):
    wide = pc.vector_columns(table(spark, sf_dir, "embeddings"), "embedding", 64, "e")
    cols = [f"e{i}" for i in range(1, 65)]
    return pc.fit_pca(settle(pc.standardize(wide, cols)), cols, keep)


@BOOK.add(
    "m8_embedding_components",
    "WITH u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),"
    " v AS (SELECT vec_id, i, CAST(x AS double) AS x FROM u)"
    " SELECT concat('e', a.i) AS attribute, concat('e', b.i) AS other, round(corr(a.x, b.x), 6) + 0.0 AS correlation FROM v a JOIN v b USING (vec_id) GROUP BY a.i, b.i",
)
def embedding_components(spark, sf_dir):
    """All 64 components, put together again: loadings and variances must give the correlations of the columns."""
    return rounded(pc.implied_correlations(_embedding_model(spark, sf_dir, 1.0)), "correlation")


@BOOK.add("m10_embedding_scree")
def embedding_scree(spark, sf_dir):
    return rounded(pc.scree(_embedding_model(spark, sf_dir, 0.95)), "ratio", "cumulative")


@BOOK.add(
    "m9_component_scores",
    f"WITH {PAIR} SELECT row_key, round(((gross - mg) / sg + sign(r) * (net - mn) / sn) * sqrt(0.5), 6) AS PC1, round(((gross - mg) / sg - sign(r) * (net - mn) / sn) * sqrt(0.5), 6) AS PC2 FROM pair, moments",
)
def scores(spark, sf_dir):
    scaled = pc.standardize(pair(spark, sf_dir), ["gross", "net"])
    return rounded(pc.transform_pca(scaled, pair_model(spark, sf_dir), ["row_key"]), "PC1", "PC2")


@BOOK.add(
    "m10_scree",
    f"WITH {PAIR} SELECT pos AS position, concat('PC', pos) AS component, round(ratio, 6) AS ratio, round(sum(ratio) OVER (ORDER BY pos), 6) AS cumulative,"
    " CAST(0.95 AS double) AS threshold, format('PC {:d} ({:.1f}%)', pos, ratio * 100) AS label FROM ratios",
)
def scree(spark, sf_dir):
    return rounded(pc.scree(pair_model(spark, sf_dir)), "ratio", "cumulative")


@BOOK.add("m11_loadings", f"WITH {PAIR} SELECT attribute, concat('PC', pos) AS component, round(loading, 6) AS loading FROM loads")
def loading_rows(spark, sf_dir):
    return rounded(pc.loadings(pair_model(spark, sf_dir)), "loading")


@BOOK.add("m12_component_detail", f"WITH {PAIR} SELECT attribute, round(loading, 6) AS loading, round(abs(loading), 6) AS abs_loading FROM loads WHERE pos = 2")
def detail(spark, sf_dir):
    return rounded(pc.component_detail(pair_model(spark, sf_dir), "PC2"), "loading", "abs_loading")


@BOOK.add(
    "m13_loading_matrix",
    f"WITH {PAIR} SELECT attribute, round(max(loading) FILTER (pos = 1), 6) AS PC1, round(max(loading) FILTER (pos = 2), 6) AS PC2, round(sum(abs(loading)), 6) AS total_abs FROM loads GROUP BY attribute",
)
def matrix(spark, sf_dir):
    return rounded(pc.loading_matrix(pair_model(spark, sf_dir)), "PC1", "PC2", "total_abs")


@BOOK.add("m14_global_contribution", f"WITH {PAIR} SELECT attribute, round(sum(loading * loading * ratio), 6) AS contribution FROM loads JOIN ratios USING (pos) GROUP BY 1")
def contribution(spark, sf_dir):
    return rounded(pc.global_contribution(pair_model(spark, sf_dir)), "contribution")


@BOOK.add(
    "m22_fences",
    f"WITH {OPV}, {fences_sql('opv')} " + " UNION ALL ".join(f"SELECT '{c}' AS attribute, round({c}_lo, 6) AS lower, round({c}_hi, 6) AS upper FROM fences" for c in FILLED),
)
def fences(spark, sf_dir):
    return rounded(fence_table(opv(spark, sf_dir), FILLED), "lower", "upper")


@BOOK.add(
    "m23_fence_mask",
    f"WITH {OPV}, {fences_sql('opv')} SELECT row_key, " + ", ".join(
        f"CASE WHEN {c} IS NULL THEN 'missing' WHEN {c} >= {c}_lo AND {c} <= {c}_hi THEN 'inside' ELSE 'outside' END AS {c}" for c in FILLED
    ) + " FROM opv, fences",
)
def mask_by_fences(spark, sf_dir):
    df = settle(opv(spark, sf_dir).select("row_key", *FILLED))
    return fence_mask(df, iqr_fences(df, FILLED), ["row_key"])


_DEVIATION = f"WITH {WHOLE_DOUBLES}, {fences_sql('filled')}"


@BOOK.add("m24_deviation_type", f"WITH {FILLED_DOUBLES}, {fences_sql('filled')}" + f" SELECT row_key, {deviation_sql()} AS deviation_type FROM filled, fences")
def deviation(spark, sf_dir):
    return fence_screen(opv(spark, sf_dir)).select("row_key", "deviation_type")


@BOOK.add(
    "m24_deviation_with_gaps",
    f"WITH {OPV}, {fences_sql('opv')} SELECT row_key, CASE WHEN {outside_sql([c for c in FILLED if c != 'cma2'])} THEN 'Univariate deviation' ELSE 'Multivariate deviation' END AS deviation_type FROM opv, fences",
)
def deviation_with_gaps(spark, sf_dir):
    df = opv(spark, sf_dir)
    return df.select("row_key", deviation_type(iqr_fences(df, FILLED), exempt="cma2").alias("deviation_type"))


@BOOK.add("m25_deviation_summary", _DEVIATION + f" SELECT {_IDS}, {deviation_sql()} AS deviation_type FROM filled, fences WHERE cma1 >= 45")
def summary(spark, sf_dir):
    df = filled(spark, sf_dir)
    return deviation_summary(df.filter("cma1 >= 45"), iqr_fences(df, FILLED), IDS)


@BOOK.add(
    "m26_attribute_ranking",
    _DEVIATION + ", n AS (" + " UNION ALL ".join(f"SELECT '{c}' AS attribute, count(*) FILTER ({c} < {c}_lo OR {c} > {c}_hi) AS times_flagged FROM filled, fences" for c in FILLED)
    + ") SELECT * FROM n WHERE times_flagged > 0",
)
def ranking(spark, sf_dir):
    df = filled(spark, sf_dir)
    return attribute_flags(df, iqr_fences(df, FILLED))


_STATUS = _DEVIATION + f", flagged AS (SELECT row_key, {deviation_sql()} AS d FROM filled, fences WHERE cma1 >= 45)"


def _with_status(spark, sf_dir):
    df = filled(spark, sf_dir)
    flagged = deviation_summary(df.filter("cma1 >= 45"), iqr_fences(df, FILLED), ["row_key"])
    return annotate_status(df, flagged)


@BOOK.add("m27_status", _STATUS + f" SELECT row_key, {_IDS}, coalesce(d, 'Core') AS status FROM filled LEFT JOIN flagged USING (row_key)")
def status(spark, sf_dir):
    return _with_status(spark, sf_dir).select("row_key", *IDS, "status")


@BOOK.add("m28_flagged_report", _DEVIATION + f" SELECT 'IsolationForest' AS flagged_by, row_key, {_IDS}, n_tests, {_FILLED} FROM filled WHERE cma1 >= 45")
def report(spark, sf_dir):
    df = filled(spark, sf_dir)
    return flagged_report(df, df.filter("cma1 >= 45"))


@BOOK.add(
    "m29_frequent_rare",
    f"WITH {OPV}, f AS (SELECT cma1, cma3, cma4, count(*) AS frequency FROM opv WHERE cma1 IS NOT NULL AND cma3 IS NOT NULL AND cma4 IS NOT NULL GROUP BY 1, 2, 3)"
    " SELECT row_key, frequency, CASE WHEN frequency > 5 THEN 'Frequent' ELSE 'Rare' END AS profile_group FROM opv LEFT JOIN f USING (cma1, cma3, cma4)",
)
def frequent(spark, sf_dir):
    return frequent_or_rare(opv(spark, sf_dir), ["cma1", "cma3", "cma4"]).select("row_key", "frequency", "profile_group")


@BOOK.add(
    "m30_coded_profiles",
    f"WITH {_KEYED}, first AS (SELECT profile_group, min(row_key) AS f FROM grouped GROUP BY 1), codes AS (SELECT profile_group, CAST(row_number() OVER (ORDER BY f) - 1 AS integer) AS code FROM first)"
    " SELECT row_key, profile_group, code FROM grouped JOIN codes USING (profile_group)",
)
def coded(spark, sf_dir):
    return coded_profiles(_keyed(spark, sf_dir), _PROFILE).select("row_key", "profile_group", "code")


def _noise(col: str, sd: float) -> str:
    return f"round({col} + {sd} * {gauss_sql('42', chr(39) + col + chr(39), 'row_key')}, 5) AS {col}_jittered"


@BOOK.add(
    "m31_status_projection",
    _STATUS + f" SELECT row_key, coalesce(d, 'Core') AS status, {_noise('cma2', 0.06)}, {_noise('cma4', 0.06)}, {_noise('cma5', 0.06)} FROM filled LEFT JOIN flagged USING (row_key)",
)
def status_projection(spark, sf_dir):
    frame = projection_frame(_with_status(spark, sf_dir), ["cma2", "cma4", "cma5"], "status", 0.06)
    return rounded(frame, "cma2_jittered", "cma4_jittered", "cma5_jittered", places=5)


@BOOK.add(
    "m31_profile_projection",
    f"WITH {PAIR}, {_KEYED}, s AS (SELECT row_key, ((gross - mg) / sg + sign(r) * (net - mn) / sn) * sqrt(0.5) AS PC1, ((gross - mg) / sg - sign(r) * (net - mn) / sn) * sqrt(0.5) AS PC2 FROM pair, moments)"
    " SELECT row_key, CASE WHEN frequency > 5 THEN 'Frequent' ELSE 'Rare' END AS profile_group, "
    + ", ".join(f"round({c} + 0.1 * {gauss_sql('42', chr(39) + c + chr(39), 'row_key')}, 5) AS {c}_jittered" for c in ("PC1", "PC2"))
    + " FROM s JOIN grouped USING (row_key)",
)
def profile_projection(spark, sf_dir):
    scaled = pc.standardize(pair(spark, sf_dir), ["gross", "net"])
    scores = pc.transform_pca(scaled, pair_model(spark, sf_dir), ["row_key"])
    both = attach(scores, frequent_or_rare(_keyed(spark, sf_dir), _PROFILE).select("row_key", "profile_group"))
    return rounded(projection_frame(both, ["PC1", "PC2"], "profile_group", 0.1), "PC1_jittered", "PC2_jittered", places=5)


@BOOK.add("m31_coded_projection")
def coded_projection(spark, sf_dir):
    # Components of the cleaned slice beside the profile group; the axes are not jittered here.
    df, cols = filled(spark, sf_dir), ["cma1", "cma3", "cma4"]
    scores, _ = component_scores(df, FILLED, keep=0.9999)
    both = attach(scores, coded_profiles(df.select("row_key", *cols), cols).select("row_key", "profile_group", "code"))
    return projection_frame(both, prefix_columns(scores, "PC"), "code", sd=0)


@BOOK.add(
    "m32_coverage_chart",
    f"WITH {COUNTED} SELECT n_tests, count(*) AS batch_count, CAST(7 - n_tests AS integer) AS imputed_tests, round(n_tests / 7.0, 6) AS share_original, round(1 - n_tests / 7.0, 6) AS share_imputed,"
    " round(CAST(n_tests AS double), 6) AS height_original, round(CAST(7 - n_tests AS double), 6) AS height_imputed FROM counted GROUP BY n_tests",
)
def coverage_chart(spark, sf_dir):
    df = coverage_distribution(with_test_count(opv(spark, sf_dir), ATTRS), len(ATTRS))
    return rounded(df, "share_original", "share_imputed", "height_original", "height_imputed")


@BOOK.add(
    "m32_coverage_percent",
    f"WITH {COUNTED} SELECT n_tests, count(*) AS batch_count, concat(CAST(CAST(round_even(CAST(n_tests AS double) / 7 * 100, 0) AS integer) AS varchar), '%') AS percent FROM counted GROUP BY n_tests",
)
def percent_chart(spark, sf_dir):
    return coverage_percent(with_test_count(opv(spark, sf_dir), ATTRS), len(ATTRS))

"""Joins on row keys, mappings, profiles and constants."""

from pyspark.sql import functions as F

from batchlens.operators.evaluation import contamination_grid, stability_pairs
from batchlens.operators.fences import deviation_type, iqr_fences, with_constants
from batchlens.operators.masking import apply_mapping, build_mapping
from batchlens.operators.profiles import profile_frequency, with_profile
from batchlens.operators.audit import require_unique, with_row_key
from batchlens.operators.reporting import annotate_status, attach, flagged_report
from queries.fixture import (
    FILLED,
    IDS,
    OPV,
    Book,
    deviation_sql,
    fences_sql,
    opv,
    quantile_sql,
    rounded,
    table,
)

BOOK = Book()
_FENCED = f"WITH {OPV}, {fences_sql('opv')}, flagged AS (SELECT row_key, {deviation_sql()} AS deviation_type FROM opv, fences WHERE cma4 >= 0.07)"


def _flagged(df):
    fences = iqr_fences(df, FILLED)
    return df.filter("cma4 >= 0.07").select("row_key", deviation_type(fences).alias("deviation_type"))


@BOOK.add(
    "j1_status_join",
    _FENCED + f" SELECT row_key, {', '.join(IDS)}, coalesce(deviation_type, 'Core') AS status FROM opv LEFT JOIN flagged USING (row_key)",
)
def status_join(spark, sf_dir):
    df = opv(spark, sf_dir)
    return annotate_status(df, _flagged(df)).select("row_key", *IDS, "status")


@BOOK.add(
    "j2_flagged_rows",
    _FENCED + f" SELECT 'IsolationForest' AS flagged_by, row_key, {', '.join(IDS)}, {', '.join(FILLED)} FROM opv WHERE row_key IN (SELECT row_key FROM flagged)",
)
def flagged_rows(spark, sf_dir):
    df = opv(spark, sf_dir).drop("cma7")
    return flagged_report(df, _flagged(df))


@BOOK.add(
    "j3_profile_join",
    f"WITH {OPV}, freq AS (SELECT cma1, cma3, cma4, count(*) AS frequency FROM opv WHERE cma1 IS NOT NULL AND cma3 IS NOT NULL AND cma4 IS NOT NULL GROUP BY cma1, cma3, cma4)"
    " SELECT row_key, cma1, cma3, cma4, frequency FROM opv LEFT JOIN freq USING (cma1, cma3, cma4)",
)
def profile_join(spark, sf_dir):
    cols = ["cma1", "cma3", "cma4"]
    df = opv(spark, sf_dir).select("row_key", *cols)
    return with_profile(df, profile_frequency(df, cols), cols).select("row_key", *cols, "frequency")


@BOOK.add(
    "j4_attach",
    f"WITH {OPV}, s AS (SELECT row_key, round(cma4 * 100 + cma5, 6) AS score FROM opv) SELECT row_key, {', '.join(IDS)}, score FROM opv JOIN s USING (row_key)",
)
def attach_scores(spark, sf_dir):
    df = opv(spark, sf_dir)
    scores = rounded(df.select("row_key", (F.col("cma4") * 100 + F.col("cma5")).alias("score")), "score")
    return attach(df.select("row_key", *IDS), scores)


@BOOK.add(
    "j4_row_keys",
    "WITH k AS (SELECT CAST(l_orderkey AS varchar) AS k, count(*) AS n FROM lineitem GROUP BY 1)"
    " SELECT CASE WHEN n = 1 THEN k ELSE concat(k, '#', unnest(range(1, n + 1))) END AS row_key FROM k",
)
def row_keys(spark, sf_dir):
    # An order stands for several lines, which get an ordinal; the keys then pass the gate of the joins.
    keyed = with_row_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"])
    return require_unique(keyed, ["row_key"]).select("row_key")


@BOOK.add(
    "j5_label_assignment",
    _FENCED + " SELECT row_key, cma4, cma5, coalesce(deviation_type, 'Core') AS status FROM opv LEFT JOIN flagged USING (row_key)",
)
def label_assignment(spark, sf_dir):
    df = opv(spark, sf_dir)
    return annotate_status(df.select("row_key", "cma4", "cma5"), _flagged(df))


@BOOK.add(
    "j6_apply_mapping",
    f"WITH {OPV}, m AS (SELECT v, concat('MB', row_number() OVER (ORDER BY v)) AS masked FROM (SELECT DISTINCT material_batch_nr AS v FROM opv WHERE cma1 IS NOT NULL))"
    " SELECT row_key, masked AS material_batch_nr FROM opv LEFT JOIN m ON v = material_batch_nr",
)
def mapped(spark, sf_dir):
    df = opv(spark, sf_dir)
    # Batches unseen when the mapping was made get no code.
    mapping = build_mapping(df.filter("cma1 is not null"), "material_batch_nr", "MB")
    return apply_mapping(df.select("row_key", "material_batch_nr"), mapping, "material_batch_nr")


def labels(spark, sf_dir, seeds=(10, 20, 30, 40)):
    """Labelings of the orders that agree on the expensive ones, four unless more are asked for."""
    chosen = F.substring(F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("seed").cast("string"))), 1, 1).isin("0", "1")
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_totalprice", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
        .select("o_orderkey", "seed", F.when(chosen | (F.col("o_totalprice") > 300000), -1).otherwise(1).alias("label"))
    )


def rand_sql(cells: str, a: str, b: str, n: str) -> str:
    expected = f"(({a}) * ({b}) / ({n} * ({n} - 1) / 2.0))"
    return f"(({cells}) - {expected}) / ((({a}) + ({b})) / 2.0 - {expected})"


def labels_sql(seeds: str = "[10, 20, 30, 40]") -> str:
    return f"""labels AS (SELECT o_orderkey, seed, CASE WHEN substr(md5(concat_ws('|', o_orderkey, seed)), 1, 1) IN ('0', '1')
   OR o_totalprice > 300000 THEN -1 ELSE 1 END AS label FROM orders, (SELECT unnest({seeds}) AS seed))"""


def pairs_sql(source: str = "labels", tag: str = "") -> str:
    """CTE ari{tag}(seed_pair, ari) over every pair of runs in ``source`` (o_orderkey, seed, label)."""
    return f"""pairs{tag} AS (SELECT a.seed AS s1, b.seed AS s2, a.label AS la, b.label AS lb, CAST(count(*) AS double) AS n
   FROM {source} a JOIN {source} b ON a.o_orderkey = b.o_orderkey AND a.seed < b.seed GROUP BY ALL),
cell{tag} AS (SELECT s1, s2, sum(n * (n - 1) / 2) AS c, sum(n) AS n FROM pairs{tag} GROUP BY s1, s2),
side_a{tag} AS (SELECT s1, s2, sum(n * (n - 1) / 2) AS sa FROM (SELECT s1, s2, la, sum(n) AS n FROM pairs{tag} GROUP BY s1, s2, la) GROUP BY s1, s2),
side_b{tag} AS (SELECT s1, s2, sum(n * (n - 1) / 2) AS sb FROM (SELECT s1, s2, lb, sum(n) AS n FROM pairs{tag} GROUP BY s1, s2, lb) GROUP BY s1, s2),
ari{tag} AS (SELECT concat(s1, '-', s2) AS seed_pair, {rand_sql('c', 'sa', 'sb', 'n')} AS ari
   FROM cell{tag} JOIN side_a{tag} USING (s1, s2) JOIN side_b{tag} USING (s1, s2))"""


LABELS, PAIRS = labels_sql(), pairs_sql()


@BOOK.add("j7_seed_pairs", f"WITH {LABELS}, {PAIRS} SELECT seed_pair, round(ari, 9) AS ari FROM ari")
def seed_pairs(spark, sf_dir):
    return rounded(stability_pairs(labels(spark, sf_dir), [10, 20, 30, 40], key="o_orderkey", by=()), "ari", places=9)


@BOOK.add("j7_hundred_runs", f"WITH {labels_sql('range(1, 101)')}, {PAIRS} SELECT seed_pair, round(ari, 9) AS ari FROM ari")
def hundred_runs(spark, sf_dir):
    runs = list(range(1, 101))
    return rounded(stability_pairs(labels(spark, sf_dir, runs), runs, key="o_orderkey", by=()), "ari", places=9)


@BOOK.add(
    "j8_parameter_grid",
    f"WITH {OPV}, cut AS (" + " UNION ALL ".join(
        f"SELECT CAST({c} AS double) AS contamination, {s} AS n_estimators, {quantile_sql('opv', col, c)} AS q" for s, col in ((4, "cma4"), (5, "cma5")) for c in (0.03, 0.05, 0.1)
    ) + ") SELECT contamination, n_estimators, count(*) FILTER (CASE n_estimators WHEN 4 THEN cma4 ELSE cma5 END < q) AS outliers_flagged FROM opv, cut GROUP BY ALL",
)
def grid(spark, sf_dir):
    return contamination_grid(opv(spark, sf_dir), [4, 5], [0.03, 0.05, 0.1], prefix="cma").select(
        "contamination", "n_estimators", "outliers_flagged"
    )


@BOOK.add(
    "j9_constants_per_row",
    f"WITH {OPV}, {fences_sql('opv', ['cma1', 'cma2'])} SELECT row_key, cma1, cma2, round(cma1_lo, 6) AS cma1_lower, round(cma1_hi, 6) AS cma1_upper,"
    " round(cma2_lo, 6) AS cma2_lower, round(cma2_hi, 6) AS cma2_upper FROM opv, fences",
)
def constants(spark, sf_dir):
    df = opv(spark, sf_dir).select("row_key", "cma1", "cma2")
    out = with_constants(df, iqr_fences(df, ["cma1", "cma2"]))
    return rounded(out, "cma1_lower", "cma1_upper", "cma2_lower", "cma2_upper")

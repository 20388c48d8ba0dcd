"""Isolation forests: growth, scores, labels, grids, stability, and the whole chain.

The SQL grows the same trees level by level: one pair of subqueries per level,
the node's range and the rows moved to its children.
"""

from pyspark.sql import functions as F

from batchlens.operators import evaluation as ev
from batchlens.operators.forest import IsolationForest, score
from batchlens.operators.ranking import exact_sample
from batchlens.operators.reporting import flagged_report
from batchlens.plans import clean, curate, explain_outliers, final_model
from batchlens.sources import run_folder, settle, write_table
from queries.fixture import FILLED, FILLED_DOUBLES, IDS, Book, filled, opv, quantile_sql, r, rounded, table
from queries.joins import LABELS, PAIRS, labels, pairs_sql

BOOK = Book()
COLS = ["l_quantity", "l_extendedprice", "l_discount"]

LINES = """base AS MATERIALIZED (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS row_key,
         TRUE AS sampled, l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2 FROM lineitem)"""


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd")).alias("row_key"), *COLS
    )


def owed_sql(n: str) -> str:
    return (
        f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1.0::double) + 0.5772156649015329::double) - 2 * ({n} - 1.0::double) / {n} WHEN {n} = 2 THEN 1.0::double ELSE 0.0::double END"
    )


DEEPEST = 20  # levels spelled out where depth follows from the rows, enough for 2 ** 20 of them


def forest_sql(base: str, d: int, trees: int, levels: int | None, seed: int | None, tag: str = "") -> str:
    """CTEs that end in leaf{tag}(row_key, tree, path): path lengths in units of 1e-9.

    Without ``levels``, trees are as deep as the logarithm of the sampled rows.  Without
    ``seed``, ``base`` holds as many sampled rows for each value of its column ``seed``,
    and trees are called 'seed|tree'.
    """
    tree, first = ("tree", f"'{seed}|', tree, '|', node") if seed is not None else ("concat(seed, '|', tree) AS tree", "tree, '|', node")
    of_seed = "" if seed is not None else f" WHERE seed = (SELECT min(seed) FROM {base})"
    xs = [f"x{i}" for i in range(d)]
    limit = f"{levels}" if levels is not None else f"(SELECT l FROM deepest{tag})"
    levels = DEEPEST if levels is None else levels
    parts = [
        f"deepest{tag} AS MATERIALIZED (SELECT CAST(ceil(log2(greatest(count(*) FILTER (sampled), 2))) AS integer) AS l FROM {base}{of_seed})",
        f"s0{tag} AS MATERIALIZED (SELECT {tree}, row_key, sampled, {', '.join(xs)}, CAST(1 AS bigint) AS node FROM {base}, (SELECT unnest(range(1, {trees + 1})) AS tree))"
    ]
    leaves = []
    for level in range(levels + 1):
        ranges = ", ".join(f"min({x}) FILTER (sampled) AS lo{i}, max({x}) FILTER (sampled) AS hi{i}" for i, x in enumerate(xs))
        varies = [f"(CASE WHEN hi{i} > lo{i} THEN 1 ELSE 0 END)" for i in range(d)]
        before = lambda i: " + ".join(varies[:i]) or "0"
        digest = f"md5(concat({first}))"
        draw = lambda k: f"(CAST('0x' || substr({digest}, {8 * k + 1}, 8) AS bigint) / 4294967296.0::double)"
        feature = "CASE " + " ".join(f"WHEN {varies[i]} = 1 AND {before(i)} = pick THEN {i}" for i in range(d)) + " END"
        low = "CASE feature " + " ".join(f"WHEN {i} THEN lo{i}" for i in range(d)) + " END"
        high = "CASE feature " + " ".join(f"WHEN {i} THEN hi{i}" for i in range(d)) + " END"
        value = "CASE feature " + " ".join(f"WHEN {i} THEN x{i}" for i in range(d)) + " END"
        parts += [
            f"a{level}{tag} AS (SELECT tree, node, count(*) FILTER (sampled) AS n, {ranges} FROM s{level}{tag} GROUP BY tree, node)",
            f"b{level}{tag} AS (SELECT *, {' + '.join(varies)} AS m, CAST(floor({draw(0)} * ({' + '.join(varies)})) AS integer) AS pick, {draw(1)} AS u FROM a{level}{tag})",
            f"f{level}{tag} AS (SELECT *, CASE WHEN m = 0 OR n <= 1 OR {level} >= {limit} THEN NULL ELSE {feature} END AS feature FROM b{level}{tag})",
            f"t{level}{tag} AS (SELECT *, {low} AS lo, {high} AS hi, {low} + u * ({high} - ({low})) AS raw FROM f{level}{tag})",
            f"c{level}{tag} AS MATERIALIZED (SELECT tree, node, n, feature, CASE WHEN raw >= hi THEN lo ELSE raw END AS threshold FROM t{level}{tag})",
        ]
        leaves.append(
            f"SELECT row_key, s.tree, CAST(round(({level} + {owed_sql('n')}) * 1000000000) AS bigint) AS path FROM s{level}{tag} s JOIN c{level}{tag} c ON s.tree = c.tree AND s.node = c.node WHERE feature IS NULL"
        )
        if level < levels:
            parts.append(
                f"s{level + 1}{tag} AS MATERIALIZED (SELECT s.tree, row_key, sampled, {', '.join(xs)}, 2 * s.node + (CASE WHEN {value} > threshold THEN 1 ELSE 0 END) AS node"
                f" FROM s{level}{tag} s JOIN c{level}{tag} c ON s.tree = c.tree AND s.node = c.node WHERE feature IS NOT NULL)"
            )
    parts.append(f"leaf{tag} AS MATERIALIZED ({' UNION ALL '.join(leaves)})")
    return ", ".join(parts)


def scores_sql(base: str, sizes, psi: str, tag: str = "") -> str:
    """CTE scored{tag}(row_key, score_<size>, decision_<size>)."""
    sums = ", ".join(f"CAST(sum(CASE WHEN tree <= {s} THEN path ELSE 0 END) AS double) AS p{s}" for s in sizes)
    score = lambda s: f"pow(2.0::double, -(p{s} / {s}e9::double) / norm)"
    cols = ", ".join(f"{score(s)} AS score_{s}, 0.5::double - {score(s)} AS decision_{s}" for s in sizes)
    return (
        f"sums{tag} AS (SELECT row_key, {sums} FROM leaf{tag} GROUP BY row_key), norm{tag} AS (SELECT {owed_sql(f'({psi})')} AS norm FROM (SELECT 1)),"
        f" scored{tag} AS MATERIALIZED (SELECT row_key, {cols} FROM sums{tag}, norm{tag})"
    )


_ALL = "SELECT count(*) FROM base"
_TEN = f"WITH {LINES}, {forest_sql('base', 3, 10, 6, 42)}, {scores_sql('base', (5, 10), _ALL)}"
_FOREST = IsolationForest(trees=10, max_depth=6)


@BOOK.add("m15_forest_paths", _TEN + " SELECT row_key, round(score_10, 9) AS score FROM scored")
def forest_paths(spark, sf_dir):
    return _FOREST.fit_score(lines(spark, sf_dir), COLS).select("row_key", r("score", 9).alias("score"))


@BOOK.add(
    "m15_forest_split_by_counting",
    _TEN + " SELECT row_key, round(score_10, 9) AS score FROM scored",
)
def forest_split_by_counting(spark, sf_dir):
    # Nodes above 4,096 rows are split by counting passes before any task sees whole nodes.
    forest = IsolationForest(trees=10, max_depth=6, group_rows=4096)
    return forest.fit_score(lines(spark, sf_dir), COLS).select("row_key", r("score", 9).alias("score"))


_FULL = f"WITH {LINES}, {forest_sql('base', 3, 10, None, 42)}, {scores_sql('base', (10,), _ALL)} SELECT row_key, round(score_10, 9) AS score, round(decision_10, 9) AS decision FROM scored"


@BOOK.add("m15_forest_full_depth", _FULL)
def forest_full_depth(spark, sf_dir):
    return rounded(IsolationForest(trees=10).fit_score(lines(spark, sf_dir), COLS), "score", "decision", places=9)


@BOOK.add("m15_forest_full_depth_by_counting", _FULL)
def forest_full_depth_by_counting(spark, sf_dir):
    # As above, with groups of 4,096 rows at most, and tops of which the driver holds no more than 20,000 nodes at once.
    forest = IsolationForest(trees=10, group_rows=4096, table_nodes=20_000)
    return rounded(forest.fit_score(lines(spark, sf_dir), COLS), "score", "decision", places=9)


@BOOK.add("m15_stored_forest_in_batches", _FULL)
def stored_forest_in_batches(spark, sf_dir):
    # Whole trees go to the rows as many at a time as 300,000 nodes hold.
    df, path = lines(spark, sf_dir), run_folder(spark, "forest")
    write_table(IsolationForest(trees=10).fit(df, COLS), path)
    return rounded(score(df, COLS, spark.read.parquet(path), df.count(), table_nodes=300_000), "score", "decision", places=9)


@BOOK.add("m15_forest_of_samples")
def forest_of_samples(spark, sf_dir):
    return rounded(IsolationForest(trees=100, max_samples=256).fit_score(lines(spark, sf_dir), COLS), "score", "decision", places=9)


@BOOK.add(
    "m15_node_table",
    f"WITH {LINES}, {forest_sql('base', 3, 10, 6, 42)} " + " UNION ALL ".join(
        f"SELECT CAST(tree AS integer) AS tree, node, {k} AS depth, feature, threshold, n FROM c{k}" for k in range(7)
    ),
)
def node_table(spark, sf_dir):
    # Thresholds are compared to the last bit: rounding is where engines would differ.
    return _FOREST.fit(lines(spark, sf_dir), COLS)


@BOOK.add("m15_stored_forest", _TEN + " SELECT row_key, round(score_10, 9) AS score FROM scored")
def stored_forest(spark, sf_dir):
    df, path = lines(spark, sf_dir), run_folder(spark, "forest")
    write_table(_FOREST.fit(df, COLS), path)
    return score(df, COLS, spark.read.parquet(path), df.count()).select("row_key", r("score", 9).alias("score"))


@BOOK.add("m16_decision_values", _TEN + " SELECT row_key, round(decision_10, 9) AS decision FROM scored")
def decision_values(spark, sf_dir):
    return _FOREST.fit_score(lines(spark, sf_dir), COLS).select("row_key", r("decision", 9).alias("decision"))


@BOOK.add(
    "m17_labels",
    _TEN + f", cut AS (SELECT {quantile_sql('scored', 'decision_10', 0.05)} AS q) SELECT row_key, CASE WHEN decision_10 < q THEN -1 ELSE 1 END AS label FROM scored, cut",
)
def outlier_labels(spark, sf_dir):
    scores = settle(_FOREST.fit_score(lines(spark, sf_dir), COLS))
    return ev.label_outliers(scores, 0.05).select("row_key", "label")


_CELLS = [(s, c) for s in (5, 10) for c in (0.03, 0.05, 0.1)]
_CUTS = ", cut AS MATERIALIZED (SELECT " + ", ".join(f"{quantile_sql('scored', f'decision_{s}', c)} AS q_{s}_{int(c * 100)}" for s, c in _CELLS) + ")"


@BOOK.add(
    "m18_contamination_grid",
    _TEN + _CUTS + " " + " UNION ALL ".join(
        f"SELECT CAST({c} AS double) AS contamination, {s} AS n_estimators, count(*) FILTER (decision_{s} < q_{s}_{int(c * 100)}) AS outliers_flagged, round(min(decision_{s}), 9) AS score_min,"
        f" round(max(decision_{s}), 9) AS score_max, round(quantile_cont(decision_{s}, 0.5), 9) AS score_median, round(stddev_samp(decision_{s}), 9) AS score_std FROM scored, cut"
        for s, c in _CELLS
    ),
)
def contamination_grid(spark, sf_dir):
    scores = settle(_FOREST.fit_score(lines(spark, sf_dir), COLS, sizes=[5, 10]))
    grid = ev.contamination_grid(scores, [5, 10], [0.03, 0.05, 0.1])
    return rounded(grid, "score_min", "score_max", "score_median", "score_std", places=9)


@BOOK.add(
    "m19_estimator_sweep",
    _TEN + _CUTS + " " + " UNION ALL ".join(
        f"SELECT CAST({c} AS double) AS contamination, {s} AS n_estimators, count(*) FILTER (decision_{s} < q_{s}_{int(c * 100)}) AS outliers_flagged FROM scored, cut"
        for s, c in _CELLS if c < 0.1
    ),
)
def estimator_sweep(spark, sf_dir):
    scores = settle(_FOREST.fit_score(lines(spark, sf_dir), COLS, sizes=[5, 10]))
    return ev.estimator_sweep(scores, [5, 10], [0.03, 0.05])


@BOOK.add(
    "m20_exact_sample",
    "WITH k AS (SELECT *, row_number() OVER (ORDER BY md5(concat(CAST(o_orderkey AS varchar), '|10')), o_orderkey) AS rn, count(*) OVER () AS n FROM orders)"
    " SELECT o_orderkey, o_totalprice FROM k WHERE rn <= round_even(0.8::double * n, 0)",
)
def sample(spark, sf_dir):
    return exact_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 0.8, 10, "o_orderkey")


@BOOK.add("m21_label_stability", f"WITH {LABELS}, {PAIRS} SELECT CAST(0.03 AS double) AS contamination, seed_pair, round(ari, 9) AS ari FROM ari")
def label_stability(spark, sf_dir):
    marked = labels(spark, sf_dir).withColumn("contamination", F.lit(0.03))
    return rounded(ev.stability_pairs(marked, [10, 20, 30, 40], key="o_orderkey"), "ari", places=9)


def _stability_sql(seeds, contaminations, trees, levels, head=LINES, xs=("x0", "x1", "x2"), median=False) -> str:
    """Forest, cutoff and labels per seed on that seed's 80 % sample; then every pair, or the pairs' median."""
    chosen = "row_number() OVER (PARTITION BY seed ORDER BY md5(concat(row_key, '|', seed)), row_key) <= round_even(0.8::double * (SELECT count(*) FROM base), 0)"
    place = lambda c: f"((n - 1) * CAST({c} AS double))"
    at = lambda c, side: f"max(CASE WHEN rn = CAST({side}({place(c)}) AS bigint) THEN d END)"
    ctes = [
        head,
        f"every_seed AS MATERIALIZED (SELECT row_key, seed, {chosen} AS sampled, {', '.join(xs)} FROM base, (SELECT unnest([{', '.join(map(str, seeds))}]) AS seed))",
        forest_sql("every_seed", len(xs), trees, levels, None),
        f"norm AS (SELECT {owed_sql('(n)')} AS norm FROM (SELECT count(*) AS n FROM every_seed WHERE sampled AND seed = {seeds[0]}))",
        "scored AS MATERIALIZED (SELECT row_key, seed, 0.5::double - pow(2.0::double, -(p / {t}e9::double) / norm) AS d FROM (SELECT row_key,"
        " CAST(split_part(tree, '|', 1) AS integer) AS seed, CAST(sum(path) AS double) AS p FROM leaf GROUP BY ALL), norm)".replace("{t}", str(trees)),
        "known AS MATERIALIZED (SELECT seed, d, row_number() OVER (PARTITION BY seed ORDER BY d) - 1 AS rn, count(*) OVER (PARTITION BY seed) AS n FROM scored JOIN every_seed USING (row_key, seed) WHERE sampled)",
        "cut AS MATERIALIZED (" + " UNION ALL ".join(
            f"SELECT seed, CAST({c} AS double) AS contamination, lo + (hi - lo) * part AS q FROM (SELECT seed, {at(c, 'floor')} AS lo, {at(c, 'ceil')} AS hi, max({place(c)} - floor({place(c)})) AS part FROM known GROUP BY seed)"
            for c in contaminations
        ) + ")",
        "every AS MATERIALIZED (SELECT row_key AS o_orderkey, contamination, seed, CASE WHEN d < q THEN -1 ELSE 1 END AS label FROM scored JOIN cut USING (seed))",
    ]
    ctes += [pairs_sql(f"(SELECT * FROM every WHERE contamination = CAST({c} AS double))", f"{i}") for i, c in enumerate(contaminations)]
    shown = "round(quantile_cont(ari, 0.5), 9) AS median_ari" if median else "seed_pair, round(ari, 9) AS ari"
    outs = [f"SELECT CAST({c} AS double) AS contamination, {shown} FROM ari{i}" for i, c in enumerate(contaminations)]
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(outs)}"


@BOOK.add("m21_seed_stability", _stability_sql((10, 20, 30), (0.03, 0.05), 5, 5))
def seed_stability(spark, sf_dir):
    pairs = ev.seed_stability(lines(spark, sf_dir), COLS, (10, 20, 30), (0.03, 0.05), trees=5, max_depth=5)
    return rounded(pairs, "ari", places=9)


# -- the whole chain on the busiest slice ------------------------------------------------

_SLICE_BASE = "base AS MATERIALIZED (SELECT row_key, TRUE AS sampled, " + ", ".join(f"{c} AS x{i}" for i, c in enumerate(FILLED)) + " FROM filled)"
_XS = tuple(f"x{i}" for i in range(len(FILLED)))
_SLICE_FOREST = (
    f"WITH {FILLED_DOUBLES}, {_SLICE_BASE}, {forest_sql('base', 6, 400, None, 42)}, {scores_sql('base', (400,), _ALL)},"
    f" cut AS (SELECT {quantile_sql('scored', 'decision_400', 0.05)} AS q), flagged AS (SELECT row_key FROM scored, cut WHERE decision_400 < q)"
)


def _slice_labels(spark, sf_dir):
    # The published final model is one of the product slice under study: 400 trees over all of its rows.
    df = filled(spark, sf_dir, whole=False)
    scores = settle(IsolationForest(trees=400).fit_score(df, FILLED))
    return df, ev.label_outliers(scores, 0.05)


@BOOK.add("f8_forest_outliers", _SLICE_FOREST + " SELECT row_key, (SELECT count(*) FROM flagged) AS n_outliers FROM flagged")
def forest_outliers(spark, sf_dir):
    return ev.outlier_keys(_slice_labels(spark, sf_dir)[1])


@BOOK.add("m28_forest_report", _SLICE_FOREST + f" SELECT 'IsolationForest' AS flagged_by, row_key, {', '.join(IDS)}, n_tests, {', '.join(FILLED)} FROM filled WHERE row_key IN (SELECT row_key FROM flagged)")
def forest_report(spark, sf_dir):
    df, marked = _slice_labels(spark, sf_dir)
    return flagged_report(df, marked.filter("label = -1"))


# The published grid, sweep and stability run, at their sizes.
SIZES, GRID, SWEEP, SEEDS = (100, 200, 300, 400, 500, 600), (0.03, 0.05, 0.1), (0.03, 0.05), tuple(range(10, 110, 10))
_SIZED = f"WITH {FILLED_DOUBLES}, {_SLICE_BASE}, {forest_sql('base', 6, 600, None, 42)}, {scores_sql('base', SIZES, _ALL)}"


def _cells_sql(sizes, contaminations) -> str:
    cells = [(s, c) for s in sizes for c in contaminations]
    return ", cell AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT {s} AS n_estimators, CAST({c} AS double) AS contamination, {quantile_sql('scored', f'decision_{s}', c)} AS cutoff" for s, c in cells
    ) + "), long AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {s} AS n_estimators, decision_{s} AS v FROM scored" for s in sizes) + ")"


def _sized(spark, sf_dir):
    return settle(IsolationForest(trees=600).fit_score(filled(spark, sf_dir, whole=False), FILLED, sizes=SIZES))


@BOOK.add(
    "m18_published_grid",
    _SIZED + _cells_sql(SIZES[:5], GRID) + " SELECT contamination, n_estimators, count(*) FILTER (v < cutoff) AS outliers_flagged, round(min(v), 9) AS score_min,"
    " round(max(v), 9) AS score_max, round(quantile_cont(v, 0.5), 9) AS score_median, round(stddev_samp(v), 9) AS score_std FROM cell JOIN long USING (n_estimators) GROUP BY ALL",
)
def published_grid(spark, sf_dir):
    grid = ev.contamination_grid(_sized(spark, sf_dir), SIZES[:5], GRID)
    return rounded(grid, "score_min", "score_max", "score_median", "score_std", places=9)


@BOOK.add(
    "a21_published_histograms",
    _SIZED + _cells_sql(SIZES[:5], GRID) + ", m AS (SELECT min(v) AS lo, max(v) AS hi FROM long), w AS (SELECT lo, CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS w FROM m),"
    " b AS (SELECT n_estimators, CAST(least(floor((v - lo) / w * 30), 29) AS integer) AS bin, count(*) AS n FROM long, w GROUP BY ALL)"
    " SELECT n_estimators, contamination, round(cutoff, 9) AS cutoff, bin, n, round(lo + bin * (w / 30), 9) AS bin_from, round(lo + (bin + 1) * (w / 30), 9) AS bin_to"
    " FROM b JOIN cell USING (n_estimators), w",
)
def published_histograms(spark, sf_dir):
    return rounded(ev.histogram_grid(_sized(spark, sf_dir), SIZES[:5], GRID), "cutoff", "bin_from", "bin_to", places=9)


@BOOK.add(
    "m19_published_sweep",
    _SIZED + _cells_sql(SIZES, SWEEP) + " SELECT contamination, n_estimators, count(*) FILTER (v < cutoff) AS outliers_flagged FROM cell JOIN long USING (n_estimators) GROUP BY ALL",
)
def published_sweep(spark, sf_dir):
    return ev.estimator_sweep(_sized(spark, sf_dir), SIZES, SWEEP)


_SLICE_HEAD = f"{FILLED_DOUBLES}, {_SLICE_BASE}"


@BOOK.add("m21_published_stability", _stability_sql(SEEDS, SWEEP, 400, None, _SLICE_HEAD, _XS))
def published_stability(spark, sf_dir):
    return rounded(ev.seed_stability(filled(spark, sf_dir, whole=False), FILLED), "ari", places=9)


@BOOK.add("a16_published_median_index", _stability_sql(SEEDS, SWEEP, 400, None, _SLICE_HEAD, _XS, median=True))
def published_median_index(spark, sf_dir):
    pairs = ev.seed_stability(filled(spark, sf_dir, whole=False), FILLED)
    return rounded(ev.stability_summary(pairs), "median_ari", places=9)


@BOOK.add("m17_final_model")
def chain(spark, sf_dir):
    # curate → clean → standardise → components → standardise → forest → label → explain
    df = settle(clean(curate(opv(spark, sf_dir)))[0])
    marked = final_model(df, FILLED, forest=IsolationForest(trees=400))
    return explain_outliers(df, marked, FILLED)


@BOOK.add("m15_components_forest")
def components_forest(spark, sf_dir):
    # Whole order lines: standardised, turned into components, scored in one pass by sampled trees.
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd")).alias("row_key"), *cols
    )
    marked = final_model(df, cols, forest=IsolationForest(trees=100, max_samples=256))
    return rounded(marked.select("row_key", "score", "decision", "label"), "score", "decision", places=9)



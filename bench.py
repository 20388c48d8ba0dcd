"""Headline timings: one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS``
the cores.  Every query is run to the end (all rows, all columns) once after a
warm-up of the session, and checked for nothing but speed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from batchlens.operators.evaluation import estimator_sweep, label_outliers, seed_stability  # noqa: E402
from batchlens.operators.forest import IsolationForest  # noqa: E402
from batchlens.operators.roles import prefix_columns  # noqa: E402
from batchlens.plans import clean, curate, explain_outliers, final_model  # noqa: E402
from batchlens.plans.detect import component_scores  # noqa: E402
from batchlens.sources import settle  # noqa: E402
from queries import all_queries  # noqa: E402
from queries.fixture import ATTRS, FILLED, opv, table  # noqa: E402

REGISTERED = [
    "f2_focus_slice",
    "a4_group_sizes",
    "a9_decimal_median",
    "a12_exact_quantiles",
    "m1_mask",
    "m6_clean",
    "m7_standardize",
    "m9_component_scores",
    "m20_exact_sample",
    "m22_fences",
    "m24_deviation_type",
    "m24_deviation_with_gaps",
    "m26_attribute_ranking",
    "m29_frequent_rare",
    "m30_coded_profiles",
    "m31_profile_projection",
]

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, sf_dir):
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd"))
    return table(spark, sf_dir, "lineitem").select(key.alias("row_key"), *LINE_COLS)


def final_400_trees(spark, sf_dir):
    """The published final model, on the busiest slice: 400 trees over every row, labels, explanation."""
    df = settle(clean(curate(opv(spark, sf_dir)))[0])
    return explain_outliers(df, final_model(df, FILLED, forest=IsolationForest(trees=400)), FILLED)


def sweep_600_trees(spark, sf_dir):
    """The published sweep, on the busiest slice: sizes 100 … 600 out of one forest of 600."""
    df = settle(clean(curate(opv(spark, sf_dir)))[0])
    scores, _ = component_scores(df, FILLED)
    sizes = [100, 200, 300, 400, 500, 600]
    decided = settle(IsolationForest(trees=600).fit_score(scores, prefix_columns(scores, "PC"), sizes=sizes))
    return estimator_sweep(decided, sizes, [0.03, 0.05])


def stability_4000_trees(spark, sf_dir):
    """The published stability run, on the busiest slice: ten seeds of 400 trees, 90 indices."""
    df = settle(clean(curate(opv(spark, sf_dir)))[0])
    scores, _ = component_scores(df, FILLED)
    return seed_stability(scores, prefix_columns(scores, "PC"))


def all_rows_50_trees(spark, sf_dir):
    """Every order line in every tree, grown to full depth."""
    return IsolationForest(trees=50).fit_score(_lines(spark, sf_dir), LINE_COLS)


def samples_400_trees(spark, sf_dir):
    """400 trees of 256 rows, every order line scored and labelled."""
    scores = settle(IsolationForest(trees=400, max_samples=256).fit_score(_lines(spark, sf_dir), LINE_COLS))
    return label_outliers(scores, 0.05)


FORESTS = [final_400_trees, sweep_600_trees, stability_4000_trees, all_rows_50_trees, samples_400_trees]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("batchlens-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    jobs = {name: known[name] for name in REGISTERED} | {f.__name__: f for f in FORESTS}
    wanted = os.environ.get("BENCH_ONLY")
    if wanted:
        jobs = {k: v for k, v in jobs.items() if k in wanted.split(",")}
    opv(spark, sf_dir).select(*ATTRS).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name, run in jobs.items():
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

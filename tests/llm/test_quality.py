"""Rule statistics by hand; the verdict against labels; forests on planted outliers."""

import re

import numpy as np
from pyspark.sql import functions as F

from batchlens.llm.quality import (
    COUNTS,
    FORESTS,
    at_least,
    calibrate,
    fit_forests,
    grow,
    keep_good,
    quality_rules,
    rule_statistics,
    smallest_by_hash,
    text_counts,
    unsplit,
)
from batchlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_op2_statistics_and_base(spark, texts):
    rows = QUERIES["op2_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        if len(text) > 6000:  # the quadratic check
            continue
        n, chars, symbols, dup, repeat = by_hand(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_verdict_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = QUERIES["op2_quality_rules"](spark, sf).filter("not base_failed").join(labels, "doc_id")
    tally = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert tally.get((1, False), 0) <= 0.02 * tally[(1, True)]
    assert tally.get((0, True), 0) <= 0.1 * tally[(0, False)]


def test_counts_of_odd_texts():
    assert text_counts(None)[:5] == text_counts("")[:5] == text_counts(" \n\t ")[:5] == (0, 0, 0, 0, 0)
    assert text_counts("a a a a")[4] == 4 and text_counts("a b")[4] == 0
    assert text_counts("x\ny\nx\n \n \n")[3] == 1
    assert text_counts("a\xa0b é")[:2] == (2, 4)


def test_planted_outlier_has_the_shortest_path():
    rng = np.random.default_rng(1)
    table = rng.normal(0, 1, (256, 2))
    table[7] = 40
    lengths = np.zeros(256)
    for k in range(50):
        tree = grow(table, (0, 1), 8, np.random.default_rng(k))
        node = np.zeros(256, int)
        for _ in range(tree.depth):
            f = tree.feature[node]
            node = np.where(f < 0, node, tree.left[node] + (table[np.arange(256), np.maximum(f, 0)] >= tree.split[node]))
        lengths += tree.length[node]
    assert lengths.argmin() == 7 and lengths[7] / 50 < 0.5 * unsplit(256)


def test_odd_rows_and_missing_labels(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 0), (1, 0, 0)], "doc_id bigint, quality bigint, toxic bigint")
    rows = quality_rules(odd, labels).collect()
    assert len(rows) == odd.count() and all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 3, 4, 5))
    assert quality_rules(empty, labels).count() == 0
    assert keep_good(odd, labels).columns == odd.columns
    assert keep_good(empty, labels.limit(0)).count() == 0


def test_no_labels_keeps_what_passes_the_base(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, quality bigint")
    statistics = rule_statistics(documents)
    forests = calibrate(fit_forests(statistics, trees=10), statistics, none)
    assert forests.thresholds == (None,) * len(FORESTS)
    kept = keep_good(documents, none).count()
    base = statistics.filter((F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))).count()
    assert kept == base


def test_pool_is_the_rows_of_smallest_hash(spark):
    columns = [F.pmod(F.col("id") * (k + 3), F.lit(k + 7)).cast("bigint").alias(c) for k, c in enumerate(COUNTS)]
    some = spark.range(9000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("doc_id"), *columns)
    hot = spark.range(6000).select(F.lit(1).cast("bigint").alias("doc_id"), *[F.lit(1).cast("bigint").alias(c) for c in COUNTS])
    rows = some.unionByName(hot)
    for size in (1, 40, 700, 5000, 14_999, 15_000, 99_999):
        want = rows.orderBy(F.xxhash64("doc_id", *COUNTS), "doc_id", *COUNTS).limit(size).select(*COUNTS).collect()
        assert smallest_by_hash(rows, size).tolist() == [list(r) for r in want]
    assert smallest_by_hash(rows.limit(0), 5).shape == (0, len(COUNTS))


def test_few_labels_need_a_clearer_case():
    hits, of = np.array([0, 5, 20, 19, 186, 9100]), np.array([0, 5, 20, 20, 200, 10_000])
    assert (at_least(hits, of, 1.2816) >= 0.9).tolist() == [False, False, True, False, True, True]
    assert np.all(at_least(hits, of, 1.2816) <= hits / np.maximum(of, 1))

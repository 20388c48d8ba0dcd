"""Quality rules: isolation forests on rule statistics, thresholds from labelled rows.

Fixed rules come first (too few words, too much repetition).  For the rest, each
statistic has an isolation forest of its own and all of them share one more: trees
of random splits over bounded samples of documents, where a short path marks a
document as unusual.  Unusual isn't bad by itself, so a forest only rejects beyond
a threshold at which labelled documents show it to be right: the lowest score at
or above which at least ``precision`` of the labelled documents are of low quality.
A forest without such a score rejects nothing, and so do all of them when there
are no labels.

Words are ``[^\\x20\\x09-\\x0D]+``.  A null text has no words and fails the base
rules.  Rows are judged one by one, repeated ones alike; a null id is carried
along but has no label.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.llm.common import map_slices, settle, slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")
RATES = ("mean word length", "symbols a word", "repeated lines", "repeated words", "distinct words")
FORESTS = ((0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4))
BINS = 1000  # of scores from 0 to 1, for the thresholds

_SYMBOLS = b"#*$%&|<>"


def text_counts(text: str | None) -> tuple[int, ...]:
    """The numbers of ``COUNTS`` for one text."""
    body = (text or "").encode()
    words = body.split()  # at ASCII white space
    n, ids = len(words), {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeated = 0
    if n >= 3:
        m = len(ids)
        pairs = codes[:-2] * m + codes[1:-1]
        if m > 2_000_000:  # else three of them fit 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, which, times = np.unique(pairs * m + codes[2:], return_inverse=True, return_counts=True)
        twice = times[which] > 1
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= twice
        repeated = int(inside.sum())
    lines = [line for line in body.split(b"\n") if line.strip()]
    symbols = len(body) - len(body.translate(None, _SYMBOLS))
    chars = len(b"".join(words).decode())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(ids)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the columns of ``COUNTS``."""

    def work(doc_ids: list, texts: list) -> pa.RecordBatch:
        counts = np.array([text_counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        arrays = [pa.array(doc_ids, pa.int64()), *(pa.array(c) for c in counts.T.copy())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *COUNTS])

    return map_slices(docs, ["doc_id", "text"], work, ", ".join(f"{c} bigint" for c in ("doc_id", *COUNTS)))


def rates(counts: np.ndarray) -> np.ndarray:
    """Rows of ``COUNTS`` as rows of ``RATES``."""
    n_words, chars, symbols, dup_lines, repeated, lines, distinct = counts.astype(float).T
    words, lines = np.maximum(n_words, 1), np.maximum(lines, 1)
    return np.stack([chars / words, symbols / words, dup_lines / lines, repeated / words, distinct / words], axis=1)


@dataclass(frozen=True)
class BaseRules:
    min_words: int = 50
    max_repeat_percent: int = 50

    def failed(self, n_words: Column | np.ndarray, n_repeat_words: Column | np.ndarray) -> Column | np.ndarray:
        return (n_words < self.min_words) | (100 * n_repeat_words > self.max_repeat_percent * n_words)


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray  # -1 at a leaf
    split: np.ndarray
    left: np.ndarray  # the right child comes next to it
    length: np.ndarray  # path length to a leaf, with what an unsplit rest would add
    depth: int


def unsplit(n: int) -> float:
    """Mean path length below a node with ``n`` rows that is not split further."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(rows: np.ndarray, features: Sequence[int], limit: int, rng: np.random.Generator) -> Tree:
    feature, split, left, length = [-1], [0.0], [0], [0.0]
    todo, deepest = [(0, np.arange(len(rows)), 0)], 0
    while todo:
        node, members, depth = todo.pop()
        deepest = max(deepest, depth)
        values = rows[members]
        low, high = (values.min(0), values.max(0)) if len(members) else (np.zeros(1), np.zeros(1))
        varied = [f for f in features if len(members) > 1 and low[f] < high[f]]
        if depth >= limit or not varied:
            length[node] = depth + unsplit(len(members))
            continue
        f = int(rng.choice(varied))
        at = rng.uniform(low[f], high[f])
        if not low[f] < at <= high[f]:
            at = high[f]
        below = values[:, f] < at
        feature[node], split[node], left[node] = f, at, len(feature)
        for child, keep in ((len(feature), below), (len(feature) + 1, ~below)):
            todo.append((child, members[keep], depth + 1))
        for column, blank in ((feature, -1), (split, 0.0), (left, 0), (length, 0.0)):
            column += [blank, blank]
    return Tree(np.array(feature), np.array(split), np.array(left), np.array(length), deepest)


@dataclass(frozen=True)
class Forests:
    """``trees[k]`` for the statistics in ``FORESTS[k]``; ``thresholds[k]`` in bins of the score, or none."""

    trees: tuple[tuple[Tree, ...], ...]
    sample: int
    thresholds: tuple[int | None, ...] = ()
    base: BaseRules = BaseRules()

    def scores(self, table: np.ndarray) -> np.ndarray:
        """A column of scores in bins for each forest; high is unusual."""
        out = np.zeros((len(table), len(self.trees)), np.int64)
        every = np.arange(len(table))
        for k, trees in enumerate(self.trees):
            total = np.zeros(len(table))
            for tree in trees:
                node = np.zeros(len(table), np.int64)
                for _ in range(tree.depth):
                    f = tree.feature[node]
                    down = tree.left[node] + (table[every, np.maximum(f, 0)] >= tree.split[node])
                    node = np.where(f < 0, node, down)
                total += tree.length[node]
            if trees and unsplit(self.sample):
                out[:, k] = np.floor(BINS * 2 ** (-total / len(trees) / unsplit(self.sample)))
        return out

    def rejects(self, counts: np.ndarray) -> np.ndarray:
        """The verdict on rows of ``COUNTS``, base rules left out."""
        scores = self.scores(rates(counts))
        bad = np.zeros(len(counts), bool)
        for k, threshold in enumerate(self.thresholds):
            if threshold is not None:
                bad |= scores[:, k] >= threshold
        return bad


def smallest_by_hash(rows: DataFrame, size: int) -> np.ndarray:
    """The ``COUNTS`` of the ``size`` rows whose hash is smallest, of all rows if there are fewer.

    Counts per prefix of the hash find the prefix in which the last of them lies, and a
    longer prefix narrows it until it holds no more than ``size`` rows.  What meets on
    the driver is at most 4,096 counts a step and then twice ``size`` rows, however
    many rows there are; rows that are equal come as one with a count.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*rows.columns))
    bits, prefix, wanted = 64, 0, size
    while bits:
        here = hashed if bits == 64 else hashed.filter(F.shiftright("_hash", bits) == prefix)
        bits = max(bits - 12, 0)
        parts = here.groupBy(F.shiftright("_hash", bits).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
        before = np.cumsum([0, *(r["n"] for r in parts)])
        if before[-1] < wanted:  # only at the first step: fewer rows than wanted
            last = hashed
            break
        nth = int(np.searchsorted(before, wanted)) - 1
        prefix, wanted = parts[nth]["part"], wanted - int(before[nth])
        last = hashed.filter(F.col("_hash") <= ((prefix + 1) << bits) - 1)
        if parts[nth]["n"] <= size:
            break
    found = last.groupBy("_hash", *rows.columns).agg(F.count(F.lit(1)).alias("_n")).collect()
    found.sort(key=lambda r: (r["_hash"], r["doc_id"] is not None, r["doc_id"] or 0, *(r[c] for c in COUNTS)))
    counts = np.array([[r[c] for c in COUNTS] for r in found], np.int64).reshape(-1, len(COUNTS))
    left = size - np.cumsum([0, *(r["_n"] for r in found)])[:-1]
    return np.repeat(counts, [max(min(r["_n"], room), 0) for r, room in zip(found, left)], axis=0)


def at_least(hits: np.ndarray, of: np.ndarray, z: float) -> np.ndarray:
    """Lower end of Wilson's interval for a share of which ``hits`` in ``of`` were seen; 0 where none were."""
    n = np.maximum(of, 1)
    share = hits / n
    low = share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return np.where(of > 0, low / (1 + z * z / n), 0.0)


def fit_forests(statistics: DataFrame, trees: int = 100, sample: int = 256, seed: int = 7, base: BaseRules = BaseRules()) -> Forests:
    """Forests over documents that pass the base rules.

    A tree sees ``sample`` rows, as the method has it; they come from a pool of
    ``trees * sample`` rows, those whose hash is smallest in the whole table.
    """
    passed = statistics.filter(~base.failed(F.col("n_words"), F.col("n_repeat_words")))
    table = rates(smallest_by_hash(passed.select("doc_id", *COUNTS), trees * sample))
    size = min(sample, len(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, k])
                rows = table[rng.choice(len(table), size, replace=False)]
                tree = grow(rows, FORESTS[k // trees], ceil(log2(max(size, 2))), rng)
                parts = (tree.feature, tree.split, tree.left, tree.length)
                arrays = [pa.array([k]), *(pa.array([p.astype(float)]) for p in parts), pa.array([tree.depth])]
                yield pa.RecordBatch.from_arrays(arrays, names=["k", "f", "s", "l", "p", "d"])

    if not size:
        return Forests(tuple(() for _ in FORESTS), 0, tuple(None for _ in FORESTS), base)
    spark = statistics.sparkSession
    grown = spark.range(0, len(FORESTS) * trees, 1, 2 * len(FORESTS)).mapInArrow(
        run, "k bigint, f array<double>, s array<double>, l array<double>, p array<double>, d bigint"
    )
    made: list[list[Tree]] = [[] for _ in FORESTS]
    for r in sorted(grown.collect(), key=lambda r: r["k"]):  # at most twice ``sample`` nodes a tree
        whole = [np.array(r[c]).astype(np.int64) for c in "fl"]
        made[r["k"] // trees].append(Tree(whole[0], np.array(r["s"]), whole[1], np.array(r["p"]), r["d"]))
    return Forests(tuple(map(tuple, made)), size, tuple(None for _ in FORESTS), base)


def calibrate(
    forests: Forests, statistics: DataFrame, labels: DataFrame, precision: float = 0.95, surely: float = 0.9, z: float = 1.2816
) -> Forests:
    """The forests with thresholds from all labelled documents that pass the base rules.

    A forest rejects from the lowest score beyond which the share of low quality is
    ``precision`` or more, and ``surely`` or more by the lower end of its interval
    (``z`` = 1.2816: in nine cases of ten the true share is above it), so that few
    labels need a clearer case than many.
    ``labels`` has ``doc_id, quality``; 0 is low.  What meets on the driver is a
    count per forest, score bin and label.
    """
    said = labels.select("doc_id", F.col("quality").alias("_quality")).filter(F.col("_quality").isin(0, 1))
    base = forests.base.failed(F.col("n_words"), F.col("n_repeat_words"))
    known = statistics.filter(~base).join(said, "doc_id").select("_quality", *COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            scores = forests.scores(rates(np.stack(columns[1:], axis=1)))
            for k in range(scores.shape[1]):
                arrays = [pa.array(np.full(len(scores), k)), pa.array(scores[:, k].copy()), pa.array(columns[0].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["k", "bin", "quality"])

    counted = known.mapInArrow(run, "k bigint, bin bigint, quality bigint").groupBy("k", "bin", "quality")
    tally = np.zeros((len(FORESTS), BINS + 1, 2))
    for r in counted.agg(F.count(F.lit(1)).alias("n")).collect():
        tally[r["k"], r["bin"], r["quality"]] = r["n"]
    thresholds = []
    for of in tally:
        low, good = np.cumsum(of[::-1], axis=0)[::-1].T
        right = (low >= precision * (low + good)) & (at_least(low, low + good, z) >= surely) & (of.sum(1) > 0)
        thresholds.append(int(np.flatnonzero(right)[0]) if right.any() else None)
    return Forests(forests.trees, forests.sample, tuple(thresholds), forests.base)


def judge(statistics: DataFrame, forests: Forests) -> DataFrame:
    """``statistics`` with ``base_failed`` and ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            failed = forests.base.failed(counts[:, 0], counts[:, 4])
            kept = ~failed & ~forests.rejects(counts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(failed), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "kept"]
            )

    schema = ", ".join(f"{c} bigint" for c in ("doc_id", *COUNTS)) + ", base_failed boolean, kept boolean"
    return statistics.select("doc_id", *COUNTS).mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, the columns of ``COUNTS``, ``base_failed``, ``kept``."""
    statistics = settle(rule_statistics(docs))
    return judge(statistics, calibrate(fit_forests(statistics), statistics, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns.  Fitted on narrow statistics, then applied in one scan."""
    statistics = settle(rule_statistics(docs))
    forests = calibrate(fit_forests(statistics), statistics, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                counts = np.array([text_counts(t) for t in batch.column(at).to_pylist()], np.int64)
                failed = forests.base.failed(counts[:, 0], counts[:, 4])
                yield batch.filter(pa.array(~failed & ~forests.rejects(counts)))

    return docs.mapInArrow(run, docs.schema)

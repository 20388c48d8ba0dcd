"""Near-duplicates: consistent weighted samples over TF-IDF shingles, banded and verified.

A shingle of five words weighs its count in the text times its inverse document
frequency, the mean of those of its words; document frequencies are counted over
all rows in ``BUCKETS`` hash buckets of words, a table of fixed size.  Improved
consistent weighted sampling draws one (shingle, level) a hash so that two texts
draw the same with the probability of their weighted Jaccard similarity; its random
triples come from a pool per hash.  Texts that share two of twelve bands of three
hashes are candidates: 99.7 % of the pairs at similarity 0.8, and hardly any of the
many that only share a passage, so buckets are groups of near-copies.

Equal texts are one text throughout.  All texts of a bucket (of two bands) are
compared with its centre, the first in an order by hash, by their exact weighted
Jaccard similarity; no bucket is cut off and none is paired out.  This only joins what
is quick to join.  After it, in each bucket whose texts are not all in one class yet,
every pair of texts of different classes is compared, block by block through an index
of shingles, so that only similar pairs leave a task (``unmet_links``).  So classes are
exactly the connected components of all similar pairs that share a bucket, whatever the
size of the buckets; the texts of a bucket that its centre leaves out each pass all of
the bucket once.

Result: per row ``doc_id``, ``class_id`` (the smallest id in the class), its
number of rows, of links of the row's text, and ``kept`` (true for one row of each
class).  A null text is in a class of its own; texts without words are alike only
if equal; texts of fewer than five words are a single shingle.  Rows with a null id
belong to classes like others and come last when one is kept.  Rows repeated with
their id: one is kept.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.llm.common import content_key, slices, written
from batchlens.llm.components import components
from batchlens.llm.words import hash_words, mix, shingles

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
MEETING, MEETING_CHARS = 1024, 8 << 20  # members of a bucket that are held together in one task, and their characters
BUCKETS = 1 << 16
_POOL_BITS = 14


def bucket_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.int64)


def inverse_frequencies(docs: DataFrame, fold: bool = False) -> np.ndarray:
    """log((1 + documents) / (1 + documents with a word of the bucket)) + 1 for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for whole in batches:
            for batch in slices(whole):
                words, bounds = hash_words(batch.column(0).to_pylist(), fold)
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                seen = np.unique(owner * BUCKETS + bucket_of(words)) % BUCKETS
                counts[:BUCKETS] += np.bincount(seen, minlength=BUCKETS)
                rows += batch.num_rows
        counts[BUCKETS] = rows
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    total = np.zeros(BUCKETS + 1)
    counted = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # one row a bucket
        total[r["bucket"]] = r["n"]
    return np.log((1 + total[BUCKETS]) / (1 + total[:BUCKETS])) + 1


def weighted_shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text, sorted, and their weights."""
    every = shingles(words, SHINGLE)
    if not len(every):
        return every, np.zeros(0)
    sums = np.concatenate([[0.0], np.cumsum(idf[bucket_of(words)])])
    n = min(SHINGLE, len(words))
    mean = np.round((sums[n:] - sums[:-n]) / n, 6)  # running sums differ in the last bits from text to text
    distinct, first, times = np.unique(every, return_index=True, return_counts=True)
    return distinct, mean[first] * times


@lru_cache(maxsize=1)
def _pool() -> tuple[np.ndarray, ...]:
    """For each hash: an odd multiplier, and r, log c, beta of the sampling at each place of the pool."""
    rng, shape = np.random.default_rng(11), (BANDS * ROWS, 1 << _POOL_BITS)
    odd = rng.integers(0, 2**63, shape[0], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.gamma(2, 1, shape), np.log(rng.gamma(2, 1, shape)), rng.uniform(0, 1, shape)


def band_keys(found: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys for each text; none of the texts may be without shingles."""
    odd, r_of, c_of, beta_of = _pool()
    hashes, logw = np.concatenate(found), np.log(np.concatenate(weights))
    starts = np.concatenate([[0], np.cumsum([len(f) for f in found])[:-1]])
    drawn = np.zeros((len(found), len(odd)), np.uint64)
    lengths = [len(f) for f in found]
    for k, multiplier in enumerate(odd):
        place = ((hashes * multiplier) >> np.uint64(64 - _POOL_BITS)).astype(np.int64)
        r, beta = r_of[k][place], beta_of[k][place]
        level = np.floor(logw / r + beta)
        value = c_of[k][place] - r * (level - beta + 1)
        best = np.array([a + value[a : a + n].argmin() for a, n in zip(starts.tolist(), lengths)])
        drawn[:, k] = mix(hashes[best] + level[best].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys = np.zeros((len(found), BANDS), np.uint64)
    for k in range(ROWS):
        keys = mix(keys + drawn[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.int64)


def _with_bands(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """``doc_id, key, bands, weight`` (of all shingles); no bands for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                words, bounds = hash_words(batch.column(2).to_pylist())
                pairs = [weighted_shingles(words[a:b], idf) for a, b in zip(bounds, bounds[1:])]
                full = [i for i, (s, _) in enumerate(pairs) if len(s)]
                bands: list = [None] * len(pairs)
                if full:
                    keys = band_keys([pairs[i][0] for i in full], [pairs[i][1] for i in full])
                    for i, row in zip(full, keys):
                        bands[i] = row
                sums = pa.array([float(w.sum()) for _, w in pairs], pa.float64())
                arrays = [batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64())), sums]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "bands", "weight"])

    rows = docs.select("doc_id", content_key().alias("key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, key binary, bands array<bigint>, weight double")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the smaller weights by the sum of the larger."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    less = np.minimum(a[1][i], b[1][j]).sum()
    return float(less / (a[1].sum() + b[1].sum() - less)) if less else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """``pairs`` (centre, key) with ``linked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sides = []
                for k in (2, 3):
                    words, bounds = hash_words(batch.column(k).to_pylist())
                    sides.append([weighted_shingles(words[a:b], idf) for a, b in zip(bounds, bounds[1:])])
                linked = [similarity(a, b) >= threshold for a, b in zip(*sides)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(linked)], names=["centre", "key", "linked"])

    both = pairs.join(texts, "key").join(
        texts.select(F.col("key").alias("centre"), F.col("text").alias("_other")), "centre"
    )
    return both.select("centre", "key", "text", "_other").mapInArrow(run, "centre binary, key binary, linked boolean")


class _Block:
    """Members of one bucket, by their shingles: which of them hold a shingle, and with which weight."""

    def __init__(self, keys: list, roots: list, texts: list, bands: np.ndarray, main: np.ndarray, idf: np.ndarray) -> None:
        self.keys, self.bands, self.main = keys, bands, main
        self.number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        self.roots = np.array([self.number[r] for r in roots])
        words, bounds = hash_words(texts)
        self.members = [weighted_shingles(words[a:b], idf) for a, b in zip(bounds, bounds[1:])]
        self.weights = np.array([w.sum() for _, w in self.members])
        every = np.concatenate([s for s, _ in self.members])
        owner = np.repeat(np.arange(len(keys)), [len(s) for s, _ in self.members])
        order = np.argsort(every, kind="stable")
        self.owner, self.weight = owner[order], np.concatenate([w for _, w in self.members])[order]
        self.shingles, self.starts, self.counts = np.unique(every[order], return_index=True, return_counts=True)

    def similar(self, one: tuple[np.ndarray, np.ndarray], asked: np.ndarray, threshold: float) -> list[int]:
        """Places of the ``asked`` members whose similarity to ``one`` reaches the threshold."""
        found, weights = one
        at = np.minimum(np.searchsorted(self.shingles, found), len(self.shingles) - 1)
        hit = self.shingles[at] == found
        starts, counts = self.starts[at[hit]], self.counts[at[hit]]
        places = np.arange(counts.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(counts) else np.zeros(0, np.int64)
        less = np.minimum(self.weight[places], np.repeat(weights[hit], counts))
        overlap = np.bincount(self.owner[places], less, len(self.keys))
        near = overlap >= (threshold - 1e-6) * (self.weights + weights.sum() - overlap)
        return [k for k in np.flatnonzero(near & asked).tolist() if similarity(self.members[k], one) >= threshold]


def unmet_links(members: DataFrame, texts: DataFrame, seen: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """``centre, key``: similar pairs of ``members`` (key, band, i, j) of a bucket that are not in one class yet.

    A bucket's members are held in blocks of bounded size, by their shingles, and all of its
    members that are not in its largest class stream past each block; so a member travels once
    a block, and only similar pairs leave a task.  A pair that shares several buckets is
    compared only in that of its first two equal ``bands`` (of ``texts``).
    """
    roots = written(components(seen.filter("linked").select(F.col("centre").alias("a"), F.col("key").alias("b"))))
    own = members.join(roots, F.col("key") == F.col("node"), "left").select(*members.columns, F.coalesce("root", "key").alias("root"))
    own = written(own.join(texts.select("key", F.length("text").alias("_chars")), "key"))
    sizes = own.groupBy("band", "root").agg(F.count(F.lit(1)).alias("_n"), F.sum("_chars").alias("_chars")).groupBy("band")
    sizes = sizes.agg(F.max_by("root", F.struct("_n", "root")).alias("_main"), F.sum("_n").alias("_n"), F.sum("_chars").alias("_chars"), F.count(F.lit(1)).alias("_roots"))
    parts = F.ceil(F.greatest(F.col("_n") / MEETING, F.col("_chars") / MEETING_CHARS)).cast("int").alias("_parts")
    open_ = sizes.filter("_roots > 1").select("band", "_main", F.greatest(parts, F.lit(1)).alias("_parts"))
    some = own.join(open_, "band").join(texts, "key")
    row = ["band", "part", "asks", "key", "root", "in_main", "j", "bands", "text"]
    some = some.withColumn("in_main", F.col("root") == F.col("_main"))
    held = some.withColumns({"part": F.pmod(F.xxhash64("key", "band"), F.col("_parts")).cast("int"), "asks": F.lit(False)})
    asks = some.filter(~F.col("in_main")).withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)), "asks": F.lit(True)})
    dealt = held.select(*row).unionByName(asks.select(*row)).repartition("band", "part").sortWithinPartitions("band", "part", "asks")

    def meet(block: _Block, rows: dict) -> list[tuple]:
        words, bounds = hash_words(rows["text"])
        out = []
        for key, root, j, bands, a, b in zip(rows["key"], rows["root"], rows["j"], rows["bands"], bounds, bounds[1:]):
            equal = block.bands == np.array(bands)
            # in this bucket: the second of the pair's equal bands is the j-th; members of the main class ask nobody
            asked = (equal[:, : j + 1].sum(axis=1) == 2) & equal[:, j] & (block.roots != block.number.get(root, -1))
            asked &= block.main | np.array([k > key for k in block.keys])
            if asked.any():
                one = weighted_shingles(words[a:b], idf)
                out += [(min(key, block.keys[k]), max(key, block.keys[k])) for k in block.similar(one, asked, threshold)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block, kept = None, None, []
        for whole in batches:
            for batch in slices(whole):
                rows = batch.to_pydict()
                names = list(zip(rows["band"], rows["part"], rows["asks"]))
                edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
                for a, b in zip(edges, edges[1:]):
                    part = {c: v[a:b] for c, v in rows.items()}
                    if names[a][:2] != group:
                        group, block, kept = names[a][:2], None, []
                    if not names[a][2]:
                        kept.append(part)
                        continue
                    if block is None:
                        if not kept:
                            continue
                        all_ = {c: [x for p in kept for x in p[c]] for c in ("key", "root", "text", "bands", "in_main")}
                        block, kept = _Block(all_["key"], all_["root"], all_["text"], np.array(all_["bands"]), np.array(all_["in_main"]), idf), []
                    pairs = meet(block, part)
                    if pairs:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs)], names=["centre", "key"])

    return dealt.mapInArrow(run, "centre binary, key binary").distinct()


def near_links(docs: DataFrame, rows: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """``a, b``: links between keys of distinct texts."""
    per_text = rows.filter("bands is not null").groupBy("key").agg(F.first("bands").alias("bands"), F.first("weight").alias("weight"))
    one = written(per_text.select("key", F.posexplode("bands").alias("_nth", "_band")))
    shared = written(one.groupBy("_nth", "_band").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    own = one.join(shared, ["_nth", "_band"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_nth", "_band"))).alias("_own"))
    other = own.select("key", F.posexplode("_own").alias("_at", "_a"), "_own")  # at most one a band
    both = F.transform(F.slice("_own", F.col("_at") + 2, F.lit(BANDS)), lambda b: F.struct(F.xxhash64("_a", b).alias("band"), b["_nth"].alias("j")))
    bands = written(other.select("key", F.col("_a._nth").alias("i"), F.explode(both).alias("_b")).select("key", "i", "_b.*"))

    # an order alike in all buckets, so that a group's buckets mostly share a centre
    centres = bands.groupBy("band").agg(F.min_by("key", F.xxhash64("key", F.lit(0))).alias("centre"), F.count(F.lit(1)).alias("_n"))
    every = written(bands.join(centres.filter("_n > 1").drop("_n"), "band"))
    body = docs.filter("text is not null").select(content_key().alias("key"), "text")
    wanted = every.select("key").distinct()
    texts = written(body.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")))
    pairs = every.filter("key <> centre").select(F.least("centre", "key").alias("centre"), F.greatest("centre", "key").alias("key"))
    seen = written(_verified(pairs.distinct(), texts, idf, threshold))
    # a bucket's first centre has met all its members
    body = texts.join(per_text.select("key", "bands"), "key")
    links = seen.filter("linked").select("centre", "key").unionByName(unmet_links(every.filter("key <> centre").drop("centre"), body, seen, idf, threshold))
    return written(links.distinct().select(F.col("centre").alias("a"), F.col("key").alias("b")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, class_rows, n_links, kept`` for every row."""
    known = docs.select("doc_id", "text")
    idf = inverse_frequencies(known)
    rows = written(_with_bands(known, idf))
    links = near_links(known, rows, idf, threshold)
    return _classes(rows, links)


def _classes(rows: DataFrame, links: DataFrame) -> DataFrame:
    roots = written(components(links))
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degree = written(roots.join(ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links")), "node", "left"))
    some = written(
        rows.filter("key is not null")
        .join(degree, F.col("key") == F.col("node"), "left")
        .select("doc_id", "key", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    classes = written(some.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_rows")))
    first = _first_rows(some)
    joined = some.join(classes, "root").join(
        first.select(F.col("root"), F.col("_key"), F.col("_id")), "root"
    )
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    out = joined.select("doc_id", "class_id", "class_rows", "n_links", same.alias("kept"))
    alone = rows.filter("key is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_rows"),
        F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept"),
    )
    return out.unionByName(alone)


def _first_rows(some: DataFrame) -> DataFrame:
    """Per class the row that stays: the smallest id, nulls last, then the smallest key."""
    order: Column = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("key").alias("k"))
    least = some.groupBy("root").agg(F.min(order).alias("_least"))
    return written(least.select("root", F.col("_least.k").alias("_key"), F.col("_least.d").alias("_id")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each class, and all with a null text."""
    known = docs.select("doc_id", "text")
    idf = inverse_frequencies(known)
    rows = written(_with_bands(known, idf))
    links = near_links(known, rows, idf, threshold)
    roots = written(components(links))
    some = rows.filter("key is not null").join(roots, F.col("key") == F.col("node"), "left")
    first = _first_rows(some.select("doc_id", "key", F.coalesce("root", "key").alias("root")))
    columns = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), content_key().alias("_key"), F.col("doc_id").alias("_id"))
    same = first.select(F.col("_key").alias("_k"), F.col("_id").alias("_d"))
    chosen = (
        held.filter("_key is not null")
        .join(same, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d")), "left_semi")
        .groupBy("_key")
        .agg(F.first("row").alias("row"))  # the same row may be there more than once
    )
    return chosen.select("row.*").unionByName(held.filter("_key is null").select("row.*"))

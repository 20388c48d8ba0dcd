"""How five filters interact, in every order, with a Bloom sketch that spares unique texts the shuffle.

1. One pass over the texts gives a narrow row a document: its part, which of the filters A to
   D it fails, and two 64-bit hashes of its text.
2. A counting Bloom sketch of these hashes: each distinct text a task sees raises its slots, by
   two if the task sees it again; counters stop at two.  Tasks send the slots they raised, and
   Spark merges them a stretch of slots at a time.  The sketch has ``SLOTS_PER_TEXT`` slots a
   row but never more than ``MOST_SLOTS`` (64 MB as two bits a slot), so it can be sent to
   every task.  A text with a slot below two is unique for certain.  Beyond some 30 million
   rows the sketch fills up: more unique texts pass for possible repeats, and travel; none is
   ever judged by it.
3. Only the texts of possible repeats are shuffled, to find the smallest id of each by the whole
   text; copies collapse before they travel.
4. Where distinct texts do not share both hashes, which is counted, the smallest ids meet the
   narrow rows by the hashes; where they do, by the texts.
5. Documents are counted by part, mask of failed filters and labels.  All 120 orders of the
   filters follow from these counts, as each order's steps are sums over masks.

A null text counts as empty and a null source as ``''``.  A null id is no smaller and no larger
than another: its rows never fail E, and no row fails because of them.  Rows that repeat an id
with the same text do not fail because of each other.  An id that is labelled more than once has
the larger of its labels.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm.common import settle
from batchlens.llm.words import mix

FILTERS = "ABCDE"
SLOTS_PER_TEXT, HASHES, MOST_SLOTS = 16, 4, 1 << 28
STRETCH = 1 << 16  # slots that are merged together
HELD = 1 << 20  # rows whose slots a task holds before it sends them
_SEPARATORS = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, _SEPARATORS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint")
    fails = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def slots_of(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """(texts, HASHES): the slots of each text, a power of two of which there are."""
    step = mix(second.view(np.uint64)) | np.uint64(1)
    place = mix(first.view(np.uint64))[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)
    return (place & np.uint64(size - 1)).astype(np.int64)


def sketch(hashes: DataFrame, size: int) -> np.ndarray:
    """Two bits a slot in one array of bytes: how many distinct texts or copies raised it, at most two."""

    def sent(first: list, second: list) -> pa.RecordBatch:
        keys = np.stack([np.concatenate(first), np.concatenate(second)], axis=1)
        texts, times = np.unique(keys, axis=0, return_counts=True)
        slots = np.sort(slots_of(texts[:, 0].copy(), texts[:, 1].copy(), size), axis=1)
        again = np.zeros(slots.shape, bool)
        again[:, 1:] = slots[:, 1:] == slots[:, :-1]  # a text raises a slot once, also if two of its hashes meet there
        raised = np.where(again, 0, np.minimum(times, 2)[:, None]).ravel()
        order = np.argsort(slots.ravel(), kind="stable")
        flat, raised = slots.ravel()[order], raised[order]
        at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        return _stretches(flat[at], np.minimum(np.add.reduceat(raised, at), 2))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, held = [], [], 0
        for batch in batches:
            first.append(batch.column(0).to_numpy())
            second.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= HELD:
                yield sent(first, second)
                first, second, held = [], [], 0
        if held:
            yield sent(first, second)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, counts = None, None
        for batch in batches:
            for number, slots, raised in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if number != stretch:
                    if stretch is not None:
                        yield _packed(stretch, counts)
                    stretch, counts = number, np.zeros(min(size, STRETCH), np.uint8)
                at = np.frombuffer(slots.as_py(), np.uint16)
                counts[at] = np.minimum(counts[at] + np.frombuffer(raised.as_py(), np.uint8), 2)
        if stretch is not None:
            yield _packed(stretch, counts)

    parts = hashes.mapInArrow(local, "stretch int, slots binary, raised binary")
    whole = parts.repartition("stretch").sortWithinPartitions("stretch").mapInArrow(merged, "stretch int, bits binary")
    out = np.zeros(size // 4, np.uint8)
    for r in whole.toLocalIterator():  # MOST_SLOTS / 4 bytes at most
        bits = np.frombuffer(r["bits"], np.uint8)
        out[r["stretch"] * len(bits) : (r["stretch"] + 1) * len(bits)] = bits
    return out


def _stretches(slots: np.ndarray, raised: np.ndarray) -> pa.RecordBatch:
    """A row a stretch of sorted slots: places in it, and how far each is raised."""
    numbers = slots // STRETCH
    starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    ends = [*starts[1:], len(slots)]
    places, raised = (slots % STRETCH).astype(np.uint16), raised.astype(np.uint8)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(numbers[starts], pa.int32()),
            pa.array([places[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            pa.array([raised[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        ],
        names=["stretch", "slots", "raised"],
    )


def _packed(stretch: int, counts: np.ndarray) -> pa.RecordBatch:
    two = counts.reshape(-1, 4)
    bits = (two << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return pa.RecordBatch.from_arrays([pa.array([stretch], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["stretch", "bits"])


def possible_repeat(spark: SparkSession, bits: np.ndarray):
    """A function of both hashes: false where the sketch shows that no other row has the text."""
    shared, size = spark.sparkContext.broadcast(bits), 4 * len(bits)

    @F.pandas_udf("boolean")
    def possible(first: pd.Series, second: pd.Series) -> pd.Series:
        slots = slots_of(first.to_numpy(), second.to_numpy(), size)
        counts = shared.value[slots >> 2] >> ((slots & 3) << 1).astype(np.uint8) & 3
        return pd.Series((counts >= 2).all(axis=1))

    return possible


def _hashes(text: Column, kept: int) -> list[Column]:
    """Two hashes of a text; ``kept`` bits of each (fewer than 64 only to test what happens when texts share them)."""
    both = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    return [F.shiftrightunsigned(h, 64 - kept).alias(name) if kept < 64 else h.alias(name) for h, name in zip(both, ("_h1", "_h2"))]


def failed_filters(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``doc_id, part, mask`` of every row: bit 0 for A to bit 4 for E."""
    text = F.coalesce("text", F.lit("")).alias("_text")
    known = docs.select(F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text)
    narrow = settle(known.select("doc_id", "part", failures(F.col("_text")).alias("mask"), *_hashes(F.col("_text"), hash_bits)))
    n = narrow.count()
    size = min(MOST_SLOTS, max(1 << 16, 1 << (SLOTS_PER_TEXT * n - 1).bit_length()))
    possible = possible_repeat(docs.sparkSession, sketch(narrow.select("_h1", "_h2"), size))

    texts = known.select("doc_id", "_text", *_hashes(F.col("_text"), hash_bits))
    asked = texts.filter(F.col("doc_id").isNotNull()).filter(possible("_h1", "_h2"))
    distinct = asked.groupBy("_text").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"))
    by_hash = settle(
        distinct.select(*_hashes(F.col("_text"), hash_bits), "_least", "_most")
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_texts"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))
        .filter("_texts > 1 or _least < _most")
    )
    # whatever shares both hashes with a repeated text raised the same slots, so it was asked for and is counted
    alone = by_hash.filter("_texts = 1").select("_h1", "_h2", "_least")
    judged = narrow.join(alone, ["_h1", "_h2"], "left")
    met = by_hash.filter("_texts > 1").select("_h1", "_h2")
    if not met.isEmpty():
        some = known.select("doc_id", "part", "_text", *_hashes(F.col("_text"), hash_bits)).join(met, ["_h1", "_h2"], "left_semi")
        least = some.groupBy("_text").agg(F.min("doc_id").alias("_least"))
        told = some.join(least, "_text").select("_h1", "_h2", "doc_id", "part", failures(F.col("_text")).alias("mask"), "_least")
        judged = judged.join(met, ["_h1", "_h2"], "left_anti").unionByName(told)
    late = F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False))
    return judged.select("doc_id", "part", (F.col("mask") + F.when(late, 16).otherwise(0)).alias("mask"))


def _steps() -> list[tuple]:
    """Per order of the filters, step and mask: what a document with that mask adds to each count."""
    every = range(1 << len(FILTERS))
    rows = []
    for order in permutations(range(len(FILTERS))):
        earlier = 0
        for step, i in enumerate(order, 1):
            own = 1 << i
            for mask in every:
                fails, gone = bool(mask & own), bool(mask & earlier)
                # a filter removes what fails it wherever it stands first among the failed ones: in an even share of the orders
                share = 120 // mask.bit_count() if fails else 0
                left = not mask & (earlier | own)
                rows.append(("".join(FILTERS[k] for k in order), step, mask, *map(int, (left, fails and not gone, fails and gone, mask == own)), share))
            earlier |= own
    return rows


def audit_filters(docs: DataFrame, labels: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Per part, order of the filters and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    rows = failed_filters(docs, hash_bits)
    told = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        (F.max("quality") == 1).cast("bigint").alias("good"), (F.max("toxic") == 1).cast("bigint").alias("toxic")
    )
    named = rows.filter("doc_id is not null").join(told, "doc_id", "left").select("part", "mask", "good", "toxic")
    nameless = rows.filter("doc_id is null").select("part", "mask", F.lit(None).cast("bigint").alias("good"), F.lit(None).cast("bigint").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counts = named.unionByName(nameless).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))
    fields = "filter_order string, step int, mask int, left_ int, removed_ int, redundant_ int, unique_ int, share_ int"
    steps = docs.sparkSession.createDataFrame(_steps(), fields)
    added = lambda how, what, name: F.sum(F.col(how) * F.col(what)).alias(name)
    return (
        counts.join(F.broadcast(steps), "mask")  # 120 orders of 5 steps, 32 masks
        .groupBy("part", "filter_order", "step")
        .agg(
            added("left_", "n", "kept"),
            added("removed_", "n", "removed"),
            added("redundant_", "n", "redundant"),
            added("unique_", "n", "unique_fails"),
            added("removed_", "good", "good_lost"),
            added("removed_", "toxic", "toxic_lost"),
            added("share_", "n", "shapley"),
        )
    )

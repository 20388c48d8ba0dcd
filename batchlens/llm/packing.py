"""Best-fit packing of token sequences, planned over a histogram of lengths.

1. Every text becomes pieces of at most ``capacity`` tokens (its ids, then the
   end id).  Only longer documents are cut; the remainder comes first.
2. Pieces are counted by length.  Best fit, longest first, then runs over these
   counts: all sequences with the same room form one run of numbers, so the plan
   has a size set by ``capacity`` alone, however many documents there are.
3. A piece's rank among those of its length leads to its slot.  Ranks are counted
   within (length, hash slice), and slices are offset by the counts before them,
   so a length that a third of all pieces share is still ranked by many tasks.

Null texts count as empty (one end token).  Repeated rows are packed each for
itself.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchlens.llm.common import map_slices, settle
from batchlens.llm.tokens import encoder

SLICE_PIECES = 200_000  # pieces of one length that one task ranks, on average


def plan_best_fit(counts: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, pieces a sequence, offset), ranks from 0 and inclusive.

    Lengths are taken from the longest down.  Each time the fullest sequences with
    room are filled first, as many to each as fit; what is left over opens new ones.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    levels: list[int] = []  # the keys of ``room``, sorted
    plan, made = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                levels.insert(bisect_left(levels, left), left)
                room[left] = []
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect_left(levels, length)
            if at < len(levels):
                left = levels[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], levels[at]
            else:
                left, first, n = capacity, made, -(-todo // (capacity // length))
                made += n
            each = left // length
            full = min(n, todo // each)
            if full:
                plan.append((length, rank, rank + full * each - 1, first, each, capacity - left))
                put(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            rest = n - full
            if rest and 0 < todo < each:
                plan.append((length, rank, rank + todo - 1, first + full, each, capacity - left))
                put(left - todo * length, first + full, 1)
                todo, full, rest = 0, full + 1, rest - 1
            put(left, first + full, rest)
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the pieces of every text, without their ids."""

    def work(doc_ids: list, texts: list) -> pa.RecordBatch:
        rows: tuple[list, ...] = ([], [], [], [], [])
        end = int(end_id).to_bytes(4, "little")
        for doc_id, ids in zip(doc_ids, encoder(tokenizer).encode([t or "" for t in texts])):
            ids += end
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n, capacity), n]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for column, value in zip(rows, (doc_id, piece, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b]))):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=list("abcde"))

    return map_slices(docs, ["doc_id", "text"], work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def rank_within_length(pieces: DataFrame, n: int) -> DataFrame:
    """Adds ``_rank`` from 0 among the pieces of each length."""
    slices = max(64, n // SLICE_PIECES)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    cut = pieces.withColumn("_slice", F.pmod(F.xxhash64(*order, "length"), F.lit(slices)))
    before = (
        cut.groupBy("length", "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_slice")) - F.col("_n"))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*order))
    return (
        cut.withColumn("_inside", inside)
        .join(before, ["length", "_slice"])
        .withColumn("_rank", F.col("_before") + F.col("_inside") - 1)
        .drop("_slice", "_before", "_inside")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = settle(token_pieces(docs, tokenizer, capacity, end_id))
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(plan_best_fit(counts, capacity), dtype=np.int64).reshape(-1, 6)
    names = ["length", "_from", "_to", "_sequence", "_each", "_offset"]
    steps = spark.createDataFrame([tuple(map(int, row)) for row in plan], ", ".join(f"{c} bigint" for c in names))
    # one row per length; the plan's size depends on the capacity only
    steps = steps.groupBy("length").agg(F.array_sort(F.collect_list(F.struct(*names[1:]))).alias("_steps"))
    ranked = rank_within_length(pieces, sum(counts.values()))
    step = F.filter("_steps", lambda s: F.col("_rank").between(s["_from"], s["_to"]))[0]
    nth = F.col("_rank") - F.col("_step._from")
    return (
        ranked.join(F.broadcast(steps), "length")
        .withColumn("_step", step)
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("_step._sequence") + F.floor(nth / F.col("_step._each"))).alias("sequence_id"),
            (F.col("_step._offset") + nth % F.col("_step._each") * F.col("length")).alias("offset"),
        )
    )

"""Exact removal of repeated byte strings, by prefix-free parsing.

A rolling hash of ``GRAM`` bytes sets triggers, some 30 bytes apart, wherever its
top bits are zero; the text from one trigger to the end of the next is a phrase.
Triggers depend on the bytes at their place alone, so equal strings are parsed
alike, and what is sorted is phrases instead of bytes.

For the windows of ``length`` bytes that start in a phrase, the order of suffixes
matters only as far as such a window reaches.  So each phrase is put in order by two
keys: the bytes after the next trigger (windows that are equal share them), then
the whole context, from the phrase's start past the end of its last window.

* A context that occurs twice: all windows that start in the phrase are repeated.
* Else, if no other context has the same bytes after the trigger: none of them is.
* Else the edge of a repeated passage is near.  Only there single windows are put in
  order, together with those of one phrase for each context that occurs twice.

Windows in phrases so long that they don't reach ``ANCHOR`` bytes beyond the next
trigger (under one in a hundred) are put in order singly from the start.

Keys are exchanged in packed blocks.  A block of documents sends each key once
however often it has it, so a string that a third of all documents share arrives
once a block.  Strings are compared by 64-bit hashes.

Result: per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.  A null text is
empty; texts shorter than ``length`` lose nothing; repeated rows are repeats of each
other.  An empty table gives an empty result.  Other columns are ignored.  A task
needs some 40 bytes of memory for each byte of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.llm.common import settle, slices
from batchlens.llm.words import mix

GRAM, TRIGGER_BITS, ANCHOR = 12, 5, 40
PART_BYTES = 16 << 20  # of text whose keys one task puts in order
DUP, EDGE = 1, 2  # what a phrase is told; both for one that stands for its context at an edge

_STEP = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64)
_MESSAGE = "bucket int, slice bigint, first binary, second binary, doc binary, code binary, keys array<binary>"


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(size, base % 2**64, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_STEP), of(pow(_STEP, -1, 2**64))


class Parsed:
    """One text's phrases with windows: ``low`` to ``high`` (inclusive) start in them; ``far``: windows on their own."""

    def __init__(self, body: bytes, length: int) -> None:
        data = np.frombuffer(body, np.uint8)
        n = self.n = len(data)
        self.length = length
        self.low = self.high = self.next = self.far = self.others = np.zeros(0, np.int64)
        self.first = self.second = np.zeros(0, np.uint64)
        if n < length:
            return
        size = 1 << 18
        while size <= n:
            size *= 2
        power, self._inverse = _powers(size)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=self._sums[1:])
        grams = (self._sums[GRAM:] - self._sums[:-GRAM]) * self._inverse[: n - GRAM + 1]
        triggers = np.flatnonzero((grams * _SPREAD) >> np.uint64(64 - TRIGGER_BITS) == 0)
        starts = np.concatenate([[0], triggers[triggers > 0]])
        follow = np.append(starts[1:], n)
        every, some = follow, starts <= n - length
        starts, follow = starts[some], follow[some]
        last = np.minimum(follow - 1, n - length)
        at = np.searchsorted(triggers, last + length - GRAM)
        end = np.append(triggers + GRAM, n)[at]
        low = np.maximum(starts, follow + ANCHOR - length)
        near = low <= last
        self.low, self.high, self.next = low[near], last[near], follow[near]
        self.first = self.hash(self.next, self.next + ANCHOR)
        self.second = self.hash(starts[near], end[near])
        self.far = _ranges(starts, np.minimum(last, low - 1))
        self.others = np.setdiff1d(every[every + ANCHOR <= n], self.next)

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self._sums[b] - self._sums[a]) * self._inverse[a] + (b - a).astype(np.uint64))

    def windows(self, at: np.ndarray) -> np.ndarray:
        return self.hash(at, at + self.length)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both keys and the code of each phrase, then of each far window, then of the rest of what follows a trigger.

        The last have no windows of their own to ask for but are inside others' windows.
        """
        single, rest = self.far[:0].astype(np.uint64), self.far[:0].astype(np.uint64)
        if len(self.far):
            single = self.windows(self.far)
        if len(self.others):
            rest = self.hash(self.others, self.others + ANCHOR)
        first = np.concatenate([self.first, single, rest])
        second = np.concatenate([self.second, single, np.zeros_like(rest)])
        code = np.arange(len(first)) << 1
        code[len(first) - len(rest) :] |= 1
        return first, second, code

    def told(self, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Repeated windows known by now, and windows at edges that are still open, negative ones (-1 - place) for show only."""
        said = np.zeros(len(self.low) + len(self.far), np.int64)
        for blob in codes:
            code = np.frombuffer(blob, np.uint32).astype(np.int64)
            np.bitwise_or.at(said, code >> 2, code & 3)
        phrase = said[: len(self.low)]
        dup = (phrase & DUP) > 0
        known = np.concatenate([_ranges(self.low[dup], self.high[dup]), self.far[said[len(self.low) :] > 0]])
        edge = (phrase & EDGE) > 0
        open_ = _ranges(self.low[edge], self.high[edge])
        show = np.repeat(dup[edge], (self.high - self.low + 1)[edge])
        # a window that holds the bytes after a trigger which nothing else has is unique
        alone = np.sort(self.next[phrase == 0])
        inside = np.searchsorted(alone, open_ + self.length - ANCHOR, "right") - np.searchsorted(alone, open_)
        open_, show = open_[inside == 0], show[inside == 0]
        return known, np.where(show, -1 - open_, open_)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each ``low`` to its ``high``."""
    sizes = np.maximum(high - low + 1, 0)
    return np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _exchange(
    rows: DataFrame, columns: list[str], read: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int
) -> DataFrame:
    """``key, codes``: what each text's entries are told.

    ``read(*values)`` gives the two keys of a text's entries and their codes, a
    number times two, plus one for an entry that only shows itself and gets no answer.
    """
    buckets = 4 * parts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole):
                at += 1
                keys = batch.column(0).to_pylist()
                found = [read(*values) for values in zip(*(c.to_pylist() for c in batch.columns[1:]))]
                first, second, code = (np.concatenate([f[k] for f in found]) for k in range(3))
                doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                order = np.lexsort((second, first))
                first, second, code, doc = first[order], second[order], code[order], doc[order]
                new = np.ones(len(first), bool)
                new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(first)))
                many = np.repeat(times > 1, times)
                told = many & (code & 1 == 0)  # found twice right here
                yield _message(-1, at, doc[told], (code[told] >> 1 << 2) | DUP, keys=keys)
                bucket = ((first >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                sent = np.flatnonzero(new)
                sent = sent[np.argsort(bucket[sent], kind="stable")]
                cuts = np.searchsorted(bucket[sent], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    own = sent[cuts[b] : cuts[b + 1]]
                    yield _message(int(b), at, doc[own], code[own] << 1 | many[own], first[own], second[own])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            if (bucket < 0).any():
                yield batch.filter(pa.array(bucket < 0))
            kept += [r for r in batch.filter(pa.array(bucket >= 0)).to_pylist()]
        if not kept:
            return
        sizes = [len(r["doc"]) // 2 for r in kept]
        of = np.repeat([r["slice"] for r in kept], sizes)
        first, second = (np.frombuffer(b"".join(r[c] for r in kept), np.uint64) for c in ("first", "second"))
        doc = np.frombuffer(b"".join(r["doc"] for r in kept), np.uint16)
        code = np.frombuffer(b"".join(r["code"] for r in kept), np.uint32)
        kept.clear()
        by = np.lexsort((second, first))
        first, second, code, doc, of = first[by], second[by], code[by], doc[by], of[by]
        new_first = np.append(True, first[1:] != first[:-1])
        new = new_first | np.append(True, second[1:] != second[:-1])
        runs = np.flatnonzero(new)
        times = np.add.reduceat(1 + (code & 1).astype(np.int64), runs)
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_first))
        several = np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(new_first), len(first))))
        twice = np.repeat(times > 1, np.diff(np.append(runs, len(first))))
        said = DUP * twice + EDGE * (several & (new | ~twice))
        answer = (said > 0) & (code & 2 == 0)
        pick = np.flatnonzero(answer)
        pick = pick[np.argsort(of[pick], kind="stable")]
        cuts = np.flatnonzero(np.diff(of[pick], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(pick))):
            own = pick[a:b]
            yield _message(-1, int(of[own[0]]), doc[own], (code[own] >> 2 << 2) | said[own].astype(np.uint32))

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_keys, out = [], []
            for messages in batch.column(1).to_pylist():
                keys = next(m["keys"] for m in messages if m["keys"] is not None)
                doc = np.frombuffer(b"".join(m["doc"] for m in messages), np.uint16)
                code = np.frombuffer(b"".join(m["code"] for m in messages), np.uint32)
                by = np.lexsort((code, doc))
                doc, code = doc[by], code[by]
                cuts = np.flatnonzero(np.diff(doc.astype(int), prepend=-1))
                for a, b in zip(cuts, np.append(cuts[1:], len(doc))):
                    out_keys.append(keys[doc[a]])
                    out.append(code[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.binary()), pa.array(out, pa.binary())], names=["key", "code"])

    sent = rows.select(*columns).mapInArrow(send, _MESSAGE)
    # messages without keys to compare go to any task and pass through
    place = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("slice"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    answers = sent.repartition(parts, place).mapInArrow(order, _MESSAGE).select("slice", F.struct("doc", "code", "keys").alias("m"))
    per_slice = settle(answers).groupBy("slice").agg(F.collect_list("m").alias("m"))  # a slice is a megabyte of text
    told = per_slice.mapInArrow(hand_out, "key binary, code binary")
    return told.groupBy("key").agg(F.collect_set("code").alias("codes"))  # equal texts are told much the same


def _message(bucket: int, of: int, doc: np.ndarray, code: np.ndarray, first=None, second=None, keys=None) -> pa.RecordBatch:
    def blob(values, kind) -> pa.Array:
        return pa.array([None if values is None else values.astype(kind).tobytes()], pa.binary())

    arrays = [pa.array([bucket], pa.int32()), pa.array([of], pa.int64()), blob(first, np.uint64), blob(second, np.uint64)]
    arrays += [blob(doc, np.uint16), blob(code, np.uint32), pa.array([keys], pa.list_(pa.binary()))]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "slice", "first", "second", "doc", "code", "keys"])


def _cut(body: bytes, known: np.ndarray, length: int) -> tuple[int, int, str]:
    """Bytes removed, runs of them, digest of the rest."""
    change = np.zeros(len(body) + 1, np.int64)
    np.add.at(change, known, 1)
    np.add.at(change, known + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1))
    rest = np.frombuffer(body, np.uint8)[~gone].tobytes()
    return int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    if length < ANCHOR + 2 * GRAM:
        raise ValueError("windows are too short for the parse")
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.md5(body)).alias("key"), body.alias("text"))
    narrow = settle(
        rows.select("doc_id", "key", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("_whole"))
    )
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES)

    def phrases(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return Parsed(text.encode(), length).entries()

    told = _exchange(rows, ["key", "text"], phrases, parts)
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))
    held = settle(texts.join(told, "key"))  # texts with anything repeated

    def edges(text: str, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parsed = Parsed(text.encode(), length)
        _, open_ = parsed.told(codes)
        at = np.where(open_ < 0, -1 - open_, open_)
        hashes = parsed.windows(at) if len(at) else np.zeros(0, np.uint64)
        return hashes, hashes, at << 1 | (open_ < 0)

    more = _exchange(held, ["key", "text", "codes"], edges, parts).withColumnRenamed("codes", "more")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                keys, texts_, codes, found = (c.to_pylist() for c in batch.columns)
                done = []
                for text, code, extra in zip(texts_, codes, found):
                    body = text.encode()
                    known, _ = Parsed(body, length).told(code)
                    at = [np.frombuffer(b, np.uint32).astype(np.int64) >> 2 for b in extra or ()]
                    done.append(_cut(body, np.unique(np.concatenate([known, *at])), length))
                removed, spans, digests = zip(*done)
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
                arrays = [pa.array(v, k) for v, k in zip((keys, removed, spans, digests), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_removed", "n_spans", "kept"])

    both = held.join(more, "key", "left").select("key", "text", "codes", "more")
    done = settle(both.mapInArrow(cut, "key binary, n_removed bigint, n_spans bigint, kept string"))
    return narrow.join(done, "key", "left").select(
        "doc_id", "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept", "_whole").alias("kept_sha256"),
    )

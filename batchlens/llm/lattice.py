"""Language-model scores from a lattice of subwords.

A word, begun by a mark, can be cut into pieces of a vocabulary in many ways, its
bytes included, so nothing is out of vocabulary.  Its probability is the sum over
all cuts of the product of the pieces' probabilities, found by a forward recursion
over the characters in log space; a document's is the product over its words and
of the end.  The vocabulary exists already; its scores give the first weights
(a score that is a negative rank r counts as 1 / (r + 1)), and rounds of expected
counts over all distinct training words, each weighted by how often it occurs,
turn them into the corpus's own probabilities.

Beside it stands a smoothed word unigram model of the same training tokens.

Counts of words stay distributed.  A table of the most frequent words goes to every
task, cut off at a count so that it has at most ``FREQUENT`` entries; all other
words of a document meet their counts in a join.

Rows are held out by their id; a null id counts as an empty one.  A null text is
empty: its only token is the end.  Repeated rows are learnt and scored each for
itself.  An empty table gives an empty result, and without training rows the
vocabulary's own weights are used.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.llm.common import settle, slices

FREQUENT = 100_000  # words, some 25 MB in a task
HELD_OUT = 10  # one row in so many
CELLS = 40_000  # characters scored at a time
MARK = "▁"
LN10 = log(10)

_UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_WORD = re.compile("[^\x20\x09-\x0d]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER)) if text else []


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by a hash of their characters: open addressing, ``keys[slot]`` and ``ids[slot]`` (0 and ``size`` where empty)."""

    keys: np.ndarray
    ids: np.ndarray
    longest: int
    bytes: np.ndarray  # ids of the 256 byte pieces
    size: int
    weights: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece with each hash, or ``size``."""
        out = np.full(hashes.shape, self.size, np.int64)
        slot = _slot(hashes)
        key = self.keys[slot]
        same = key == hashes
        out[same] = self.ids[slot[same]]
        open_ = np.nonzero(~same & (key != 0))
        while len(open_[0]):  # a few per mille, and fewer at each step
            at = (slot[open_] + 1) & (len(self.keys) - 1)
            slot[open_] = at
            key = self.keys[at]
            same = key == hashes[open_]
            out[tuple(i[same] for i in open_)] = self.ids[at[same]]
            open_ = tuple(i[~same & (key != 0)] for i in open_)
        return out


_BASE, _SPREAD, _SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 20


def _slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    of_byte, weights = np.full(256, -1), np.zeros(n)
    scores = [model.get_score(i) for i in range(n)]
    ranks = min(scores) < -100  # log probabilities don't fall that low
    pieces: dict[str, int] = {}
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            of_byte[int(piece[1:-1], 16)], weights[i] = i, 1e-6
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and MARK not in piece[1:]:
            pieces[piece] = i
            weights[i] = 1 / (1 - scores[i]) if ranks else np.exp(scores[i])
    if (of_byte < 0).any():
        raise ValueError("the vocabulary has no byte pieces, so not every text has a segmentation")
    keys, ids = np.zeros(1 << _SLOT_BITS, np.uint64), np.full(1 << _SLOT_BITS, n)
    if len(pieces) > len(keys) // 4:
        raise ValueError("the vocabulary is too large for its table")
    for piece, i in pieces.items():
        key = np.zeros(1, np.uint64)
        for c in piece:
            key = key * _BASE + np.uint64(ord(c))
        slot = int(_slot(key)[0])
        while keys[slot]:
            slot = (slot + 1) % len(keys)
        keys[slot], ids[slot] = key[0], i
    return Vocabulary(keys, ids, max(map(len, pieces)), of_byte, n, weights / weights.sum())


def _characters(words: list[str]) -> np.ndarray:
    """Code points, one column a word, zeros below its end."""
    lengths = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    table = np.zeros((lengths.max(), len(words)), np.uint32)
    column = np.repeat(np.arange(len(words)), lengths)
    row = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    table[row, column] = codes
    return table


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    stack = np.stack(terms)
    top = stack.max(0)
    return top + np.log(np.exp(stack - top).sum(0))


def _score_block(words: list[str], logp: np.ndarray, vocab: Vocabulary, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    chars = _characters(words)
    height = len(chars)
    distinct, of_char = np.unique(chars, return_inverse=True)
    of_char = of_char.reshape(chars.shape)
    spelt = [vocab.bytes[np.frombuffer(chr(c).encode(), np.uint8)] if c else np.array([], int) for c in distinct]
    by_bytes = np.array([logp[s].sum() for s in spelt])[of_char]  # 0 below a word's end: nothing is added there
    longer = np.append(logp, -np.inf)
    found, weight = [], []
    hashes = np.zeros(chars.shape, np.uint64)
    for length in range(1, min(vocab.longest, height) + 1):
        hashes = hashes[: height - length + 1] * _BASE + chars[length - 1 :]
        found.append(vocab.find(hashes))
        weight.append(longer[found[-1]])
    forward = np.zeros((height + 1, len(words)))
    for e in range(1, height + 1):
        arcs = [forward[e - k - 1] + weight[k][e - k - 1] for k in range(min(e, len(weight)))]
        forward[e] = _log_sum([forward[e - 1] + by_bytes[e - 1], *arcs])
    if counts is None:
        return forward[height], None
    backward = np.zeros_like(forward)
    for s in range(height - 1, -1, -1):
        arcs = [backward[s + k + 1] + weight[k][s] for k in range(min(height - s, len(weight)))]
        backward[s] = _log_sum([backward[s + 1] + by_bytes[s], *arcs])
    expected = np.zeros(vocab.size)
    before = forward[:-1] - forward[height]
    for k, (ids, w) in enumerate(zip(found, weight)):
        at, word = np.nonzero(ids < vocab.size)
        share = np.exp(before[at, word] + w[at, word] + backward[at + k + 1, word]) * counts[word]
        expected += np.bincount(ids[at, word], share, minlength=vocab.size)
    each = np.bincount(of_char.ravel(), (np.exp(before + by_bytes + backward[1:]) * counts).ravel(), minlength=len(distinct))
    for s, n in zip(spelt, each):
        np.add.at(expected, s, n)
    return forward[height], expected


def score_words(words: list[str], logp: np.ndarray, vocab: Vocabulary, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each word (with its mark) and, with ``counts``, the expected count of each piece.

    Words of similar length share a block, whose size in characters is bounded.
    """
    out, expected = np.zeros(len(words)), np.zeros(vocab.size)
    marked = [MARK + w for w in words]
    order = sorted(range(len(words)), key=lambda i: len(marked[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * len(marked[order[to]]) <= CELLS:
            to += 1
        chosen = order[at:to]
        out[chosen], more = _score_block([marked[i] for i in chosen], logp, vocab, None if counts is None else counts[chosen])
        if more is not None:
            expected += more
        at = to
    return out, expected


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HELD_OUT == 0


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c``: how often each word of any row occurs in training rows (0 for words of others); tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["w", "c"])
            counts.clear()
            return done

        for whole in batches:
            for batch in slices(whole):
                for text, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = words_of(text)
                    counts.update(dict.fromkeys(words, 0) if out else words)
                if len(counts) > 200_000:
                    yield flush()
        yield flush()

    seen = docs.select("text", held_out(F.col("doc_id")).alias("out")).mapInArrow(run, "word string, c bigint")
    return seen.groupBy("word").agg(F.sum("c").alias("c"))


def train(words: DataFrame, ends: int, path: str, rounds: int) -> np.ndarray:
    """Log probabilities of the pieces, and last that of the end; each round is one pass over the distinct words.

    What reaches the driver is a number per piece of the vocabulary.
    """
    vocab = vocabulary(path)
    pieces = vocab.weights

    def with_end(expected: np.ndarray) -> np.ndarray:
        smoothed = np.append(expected, ends) + 0.1
        usable = np.append(vocab.weights > 0, True)
        return np.where(usable, np.log(smoothed / smoothed[usable].sum()), -np.inf)

    logp = np.append(np.log(np.where(pieces > 0, pieces, 1)) + np.where(pieces > 0, 0, -np.inf) + np.log(0.99), np.log(0.01))
    for _ in range(rounds):
        current = logp[:-1]

        def run(batches: Iterator[pa.RecordBatch], current: np.ndarray = current) -> Iterator[pa.RecordBatch]:
            total = np.zeros(vocabulary(path).size)
            for batch in batches:
                counts = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                total += score_words(batch.column(0).to_pylist(), current, vocabulary(path), counts)[1]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

        counted = words.filter("c > 0").mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        expected = np.zeros(vocab.size)
        for r in counted.collect():
            expected[r["piece"]] = r["n"]
        if not expected.any():
            break
        logp = with_end(expected)
    return logp


def _frequent(words: DataFrame) -> DataFrame:
    """All words above a count that at most ``FREQUENT`` words reach."""
    bin_of = F.floor(F.log2("c") * 8)
    sizes = words.filter("c > 0").groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    room, least = FREQUENT, None
    for r in sorted(sizes, key=lambda r: -r["bin"]):  # a few hundred bins
        if r["n"] > room:
            break
        room, least = room - r["n"], r["bin"]
    return words.filter(bin_of >= least if least is not None else F.lit(False))


def lattice_scores(docs: DataFrame, path: str, rounds: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row; scores are log10."""
    counted = settle(word_counts(docs))
    sums = counted.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("bigint")).alias("v")).first()
    ends = docs.filter(~held_out(F.col("doc_id"))).count()
    n_all, distinct = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    logp = train(counted, ends, path, rounds)
    pieces, p_end = logp[:-1], logp[-1] / LN10

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _ = score_words(batch.column(0).to_pylist(), pieces, vocabulary(path))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found / LN10)], names=["word", "c", "p"])

    words = settle(counted.mapInArrow(score, "word string, c bigint, p double"))

    def base(c: float) -> float:
        return np.log10((c + 0.1) / (n_all + 0.1 * (distinct + 1)))

    frequent = {r["word"]: (r["c"], r["p"]) for r in _frequent(words).collect()}  # at most ``FREQUENT``
    known = {w: (float(base(c)), p) for w, (c, p) in frequent.items()}
    end = (float(base(ends)), float(p_end))
    names = ["doc_id", "held_out", "row", "word", "n", "n_tokens", "n_known", "base", "p"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole):
                out: list[list] = [[] for _ in names]
                for doc_id, held, text in zip(*(c.to_pylist() for c in batch.columns)):
                    words, row = words_of(text), row + 1
                    rare: Counter[str] = Counter()
                    b, p, found = end[0], end[1], int(ends > 0)
                    for w in words:
                        at = known.get(w)
                        if at is None:
                            rare[w] += 1
                        else:
                            b, p, found = b + at[0], p + at[1], found + 1
                    for c, value in zip(out, (doc_id, held, row, None, None, len(words) + 1, found, b, p)):
                        c.append(value)
                    for w, n in rare.items():
                        for c, value in zip(out, (None, None, row, w, n, None, None, None, None)):
                            c.append(value)
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.string(), *[pa.int64()] * 3, *[pa.float64()] * 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    schema = "doc_id bigint, held_out boolean, row bigint, word string, n bigint, n_tokens bigint, n_known bigint, base double, p double"
    walked = settle(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(walk, schema))
    smooth = F.lit(n_all + 0.1 * (distinct + 1))
    rare = (
        walked.filter("word is not null").select("row", "word", "n")
        .join(words, "word")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"),
            F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / smooth)).alias("_base"),
            F.sum(F.col("n") * F.col("p")).alias("_p"),
        )
    )
    rest = walked.filter("word is null").drop("word", "n")
    return rest.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("p") + F.coalesce("_p", F.lit(0.0))).alias("score"),
    )

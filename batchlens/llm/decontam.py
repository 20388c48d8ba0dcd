"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items (long ones in parts of ``PART`` words, each half over the one
   before, so that a run of 64 words lies whole in one) are queries, taken in blocks
   of ``BLOCK``.  A block's terms are its words that are not in too many documents
   (and all words of items that have few such words); words weigh their inverse document frequency over all documents.
2. A randomised SVD of the passages' TF-IDF matrix over these terms: every task adds
   up its passages' share of A'A times a random matrix, the shares are summed, and a
   Nyström step gives singular values and term vectors.  The block's own items are
   rows of the matrix too, with many times the corpus's energy, so that the latent
   space has room for each of them (a block has fewer items than the rank).
3. Search: each window of ``WINDOW`` words of every document is compared with all
   items in the latent space; the cosine is taken with the norms of the whole
   vectors, so a window with little of an item in it comes out low.
4. Candidates at ``CANDIDATE`` and above (lower for parts of a few words, which fill
   little of a window) are checked word by word.  A leak is a ``copy`` if ``RUN``
   words in a row, or all of a shorter part, stand there unchanged, or if the longest
   common subsequence of the part and the words around the window holds ``copied`` of
   the part's words; a ``paraphrase`` if it holds ``paraphrased`` and the item's
   answer is there too.  Without an ``answer`` column
   the last sentence of the item counts as its answer.

Words are compared in lower case without ASCII punctuation.

Result of ``leaks``: ``doc_id, item_id, kind, cosine, n_common, n_words``, the best
part and window per row of ``docs`` and item.  Null and empty texts leak nothing and
null or wordless items are not looked for; a null id is carried along; repeated rows
and items are searched each for itself.  No documents or no items: no rows.  Other
columns are ignored.  One scan per block of items draws the sketch, another searches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.llm.common import slices
from batchlens.llm.neardup import BUCKETS, bucket_of, inverse_frequencies
from batchlens.llm.passages import common_subsequence
from batchlens.llm.words import hash_words

PART, BLOCK, RANK = 128, 200, 224
WINDOW, STRIDE = 64, 32
CANDIDATE = 0.2
ITEM_ENERGY = 100  # of the items in the matrix, times the corpus's, so no item falls out of the rank
COMMON = 0.1  # a term in more of the documents than this tells nothing
RUN = 50  # equal words in a row that are a copy by themselves
_DEEP = 64  # rows added one after the other
_ROWS = 16  # terms of the sketch in one row of a shuffle

_SENTENCE = re.compile(r"[^.!?\n]*\w[^.!?\n]*")


@dataclass(frozen=True)
class Items:
    """A block of item parts: their words, and those of the answer of their item."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]

    def bounds(self) -> np.ndarray:
        """The cosine from which a window is a candidate for each part; half of what a whole copy has at least."""
        sizes = np.array([len(w) for w in self.words])
        return np.minimum(CANDIDATE, 0.5 * np.sqrt(sizes / WINDOW))


def _parts(words: np.ndarray) -> list[np.ndarray]:
    """An item's words in parts of ``PART`` that overlap by half; none for no words."""
    if len(words) <= PART:
        return [words] if len(words) else []
    return [words[at : at + PART] for at in range(0, len(words) - PART // 2, PART // 2)]


def _share_run(a: np.ndarray, b: np.ndarray, n: int) -> bool:
    """Whether ``n`` words in a row stand in both."""
    if not n or min(len(a), len(b)) < n:
        return False
    powers = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
    runs = [np.lib.stride_tricks.sliding_window_view(words, n) @ powers for words in (a, b)]
    return bool(np.isin(runs[1], runs[0]).any())


def read_items(benchmark: DataFrame) -> list[Items]:
    """The benchmark, the query set of this search, in blocks; it has to fit the driver."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    parts: list[tuple] = []
    for r in benchmark.filter("text is not null").select("item_id", "text", answer.alias("answer")).orderBy("item_id", "text").collect():
        words = hash_words([r["text"]], fold=True)[0]
        sentences = _SENTENCE.findall(r["text"])
        said = hash_words([r["answer"] or (sentences[-1] if sentences else "")], fold=True)[0]
        parts += [(r["item_id"], part, said) for part in _parts(words)]
    return [Items(*map(list, zip(*parts[i : i + BLOCK]))) for i in range(0, len(parts), BLOCK)]


@dataclass(frozen=True)
class Terms:
    """The terms of a block, sorted, and their weights; all words' weights by bucket."""

    hashes: np.ndarray
    weights: np.ndarray
    all_weights: np.ndarray

    @staticmethod
    def of(items: Items, idf: np.ndarray) -> Terms:
        known = np.unique(np.concatenate(items.words))
        weights = idf[bucket_of(known)]
        some = weights > 1 - np.log(COMMON)
        for words in items.words:  # an item of common words keeps them all
            own = np.searchsorted(known, words)
            energy = weights[own] ** 2
            if energy[some[own]].sum() < energy.sum() / 2:
                some[own] = True
        return Terms(known[some], weights[some].astype(np.float32), idf.astype(np.float32))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of terms among ``words``, and which terms."""
        table = self._prefixes()
        maybe = np.flatnonzero(table[(words >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.hashes, words[maybe])
        at[at == len(self.hashes)] = 0
        right = self.hashes[at] == words[maybe]
        return maybe[right], at[right]

    def _prefixes(self) -> np.ndarray:
        table = self.__dict__.get("_table")
        if table is None:
            table = np.zeros(1 << 20, bool)
            table[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
            object.__setattr__(self, "_table", table)
        return table


def _row_sums(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of ``table[rows[starts[i]:starts[i + 1]]]`` for each i.

    The nth rows of all groups are added together, which needs no copy of all rows;
    groups of more than ``_DEEP`` are cut, so there are never more than that many steps.
    """
    sizes = np.diff(np.append(starts, len(rows)))
    pieces = -(-sizes // _DEEP)
    ahead = np.cumsum(pieces) - pieces
    nth = np.arange(pieces.sum()) - np.repeat(ahead, pieces)
    first = np.repeat(starts, pieces) + nth * _DEEP
    size = np.minimum(np.repeat(sizes, pieces) - nth * _DEEP, _DEEP)
    by = np.argsort(-size, kind="stable")
    first, size = first[by], size[by]
    sums = table[rows[first]]
    for step in range(1, int(size[0])):
        some = int(np.searchsorted(-size, -step))
        sums[:some] += table[rows[first[:some] + step]]
    out = np.empty_like(sums)
    out[by] = sums
    return np.add.reduceat(out, ahead, axis=0) if len(out) > len(starts) else out


def _sketch_share(weighted: np.ndarray, term: np.ndarray, passage: np.ndarray, into: np.ndarray) -> None:
    """Adds A'A times omega of some passages (occurrences in order of passage); ``weighted`` is omega times the weights, which ``into`` still lacks."""
    if not len(term):
        return
    new = np.diff(passage, prepend=-1) != 0
    sums = _row_sums(weighted, term, np.flatnonzero(new))
    by = np.argsort(term, kind="stable")
    starts = np.flatnonzero(np.diff(term[by], prepend=-1))
    into[term[by][starts]] += _row_sums(sums, (np.cumsum(new) - 1)[by], starts)


def latent_space(docs: DataFrame, items: Items, idf: np.ndarray, seed: int = 17) -> tuple[Terms, np.ndarray]:
    """The block's terms and their vectors in the latent space."""
    terms = Terms.of(items, idf)
    n, rank = len(terms.hashes), min(RANK, len(terms.hashes))
    omega = np.random.default_rng(seed).standard_normal((n, rank)).astype(np.float32)
    weighted, squares = omega * terms.weights[:, None], terms.weights.astype(float) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, energy = np.zeros((n, rank), np.float32), 0.0
        for whole in batches:
            for batch in slices(whole):
                words, bounds = hash_words(batch.column(0).to_pylist(), fold=True)
                at, term = terms.find(words)
                doc = np.searchsorted(bounds, at, "right") - 1
                passages = np.concatenate([[0], np.cumsum(-(-np.diff(bounds) // WINDOW))])
                _sketch_share(weighted, term, passages[doc] + (at - bounds[doc]) // WINDOW, share)
                energy += float(squares[term].sum())
        share *= terms.weights[:, None]
        salt = TaskContext.get().partitionId() % 64
        yield _rows([-1], [salt], [np.array([energy]).tobytes()])
        for a in range(0, n, _ROWS * 64):
            blocks = range(a // _ROWS, min(a // _ROWS + 64, -(-n // _ROWS)))
            yield _rows(blocks, [salt] * len(blocks), [share[b * _ROWS : (b + 1) * _ROWS].astype(np.float64).tobytes() for b in blocks])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                values = np.frombuffer(blob)
                total[block] = total[block] + values if block in total else values
        for block, values in total.items():
            yield _rows([block], [0], [values.tobytes()])

    schema = "block bigint, salt int, share binary"
    shares = docs.select("text").mapInArrow(run, schema).repartition("block", "salt").mapInArrow(add_up, schema)
    sums = shares.repartition("block").mapInArrow(add_up, schema).collect()  # terms times rank numbers
    sketch, energy = np.zeros((n, rank)), 0.0
    for r in sums:
        values = np.frombuffer(r["share"])
        if r["block"] < 0:
            energy = float(values[0])
        else:
            sketch[r["block"] * _ROWS : r["block"] * _ROWS + len(values) // rank] = values.reshape(-1, rank)
    own, own_energy = np.zeros((n, rank), np.float32), 0.0
    for words in items.words:
        at, term = terms.find(words)
        _sketch_share(weighted, term, np.zeros(len(term), np.int64), own)
        own_energy += float(squares[term].sum())
    sketch += own.astype(float) * terms.weights[:, None] * (ITEM_ENERGY * max(energy, 1.0) / max(own_energy, 1e-9))
    return terms, _nystrom(sketch, omega.astype(float)).astype(np.float32)


def _rows(blocks, salts, shares) -> pa.RecordBatch:
    arrays = [pa.array(list(blocks), pa.int64()), pa.array(list(salts), pa.int32()), pa.array(list(shares), pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "salt", "share"])


def _nystrom(sketch: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Singular vectors of A from A'A omega: A'A is about sketch (omega' sketch)^-1 sketch'."""
    core = omega.T @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max(initial=0) * 1e-10
    if not keep.any():
        return np.linalg.qr(omega)[0]
    left, singular, _ = np.linalg.svd(sketch @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return left[:, singular > singular.max() * 1e-6]


@dataclass(frozen=True)
class Search:
    """What a task needs to search a block's items in texts."""

    items: Items
    terms: Terms
    vectors: np.ndarray
    copied: float
    paraphrased: float

    def _weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Term vectors times their weights, and the parts in the latent space."""
        found = self.__dict__.get("_latent")
        if found is None:
            table = self.vectors * self.terms.weights[:, None]
            parts = np.zeros((len(self.items.words), table.shape[1]), np.float32)
            for i, words in enumerate(self.items.words):
                weight = self.terms.all_weights[bucket_of(words)]
                parts[i] = table[self.terms.find(words)[1]].sum(0) / (float(np.sqrt((weight.astype(float) ** 2).sum())) or 1.0)
            found = table, parts
            object.__setattr__(self, "_latent", found)
        return found

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, first word in it, part, cosine) of all windows near a part; a window is two steps of ``STRIDE`` words."""
        weight = self.terms.all_weights[bucket_of(words)].astype(float)
        squares = np.concatenate([[0.0], np.cumsum(weight**2)])
        at, term = self.terms.find(words)
        own = np.concatenate([[0.0], np.cumsum(self.terms.weights[term].astype(float) ** 2)])
        sizes = np.diff(bounds)
        steps = -(-sizes // STRIDE)
        ahead = np.concatenate([[0], np.cumsum(steps)])  # steps of the texts before
        windows = np.where(sizes > 0, np.maximum(1, steps - 1), 0)
        text = np.repeat(np.arange(len(sizes)), windows)
        nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        first = bounds[text] + nth * STRIDE
        end = np.minimum(first + WINDOW, bounds[text + 1])
        a, b = np.searchsorted(at, first), np.searchsorted(at, end)
        norm = np.sqrt(squares[end] - squares[first])
        needed = self.items.bounds()
        some = np.flatnonzero((b > a) & (np.sqrt(own[b] - own[a]) >= needed.min() * norm) & (norm > 0))
        if not len(some):
            return []
        owner = np.searchsorted(bounds, at, "right") - 1
        step = ahead[owner] + (at - bounds[owner]) // STRIDE
        starts = np.flatnonzero(np.diff(step, prepend=-1))
        table, queries = self._weighted()
        sums = np.concatenate([_row_sums(table, term, starts), np.zeros((1, table.shape[1]), np.float32)])
        place = np.full(ahead[-1] + 1, len(sums) - 1)  # steps without a term are zero
        place[step[starts]] = np.arange(len(starts))
        out = []
        for chunk in np.array_split(some, -(-len(some) // 512)):
            here = ahead[text[chunk]] + nth[chunk]
            next_one = np.where(nth[chunk] + 1 < steps[text[chunk]], place[here + 1], len(sums) - 1)
            cosine = ((sums[place[here]] + sums[next_one]) @ queries.T) / norm[chunk, None]
            for k, part in zip(*np.nonzero(cosine >= needed)):
                w = chunk[k]
                out.append((int(text[w]), int(first[w] - bounds[text[w]]), int(part), float(cosine[k, part])))
        return out

    def check(self, words: np.ndarray, first: int, part: int, cosine: float) -> tuple[str, int] | None:
        item, answer = self.items.words[part], self.items.answers[part]
        near = words[max(0, first - len(item)) : first + WINDOW + len(item)]
        common, run = common_subsequence(item, near), min(RUN, len(item))
        if common >= run and _share_run(item, near, run):
            return "copy", common
        if cosine < CANDIDATE:  # words of a very short item may stand anywhere: only all of it in a row tells
            return None
        if common >= self.copied * len(item):
            return "copy", common
        if common >= self.paraphrased * len(item) and len(answer) and common_subsequence(answer, near) >= 0.8 * len(answer):
            return "paraphrase", common
        return None

    def leaks(self, texts: list[str | None]) -> list[tuple[int, object, str, float, int, int]]:
        """(text, item, kind, cosine, common words, words of the part), the best for each text and item."""
        words, bounds = hash_words(texts, fold=True)
        best: dict[tuple, tuple] = {}
        for text, first, part, cosine in self.candidates(words, bounds):
            found = self.check(words[bounds[text] : bounds[text + 1]], first, part, cosine)
            if found:
                size = len(self.items.words[part])
                row = (found[0] == "copy", found[1] / size, round(cosine, 6), *found, size)
                key = (text, self.items.ids[part])
                best[key] = max(best.get(key, row), row)
        return [(text, item, kind, cosine, common, size) for (text, item), (_, _, cosine, kind, common, size) in best.items()]


def searches(docs: DataFrame, benchmark: DataFrame, copied: float = 0.7, paraphrased: float = 0.5) -> list[Search]:
    """One per block of items, fitted on all of ``docs``."""
    blocks = read_items(benchmark)
    idf = inverse_frequencies(docs, fold=True) if blocks else np.ones(BUCKETS)
    return [Search(items, *latent_space(docs, items, idf), copied, paraphrased) for items in blocks]


def leaks(docs: DataFrame, benchmark: DataFrame, copied: float = 0.7, paraphrased: float = 0.5) -> DataFrame:
    """``doc_id, item_id, kind, cosine, n_common, n_words``."""
    schema = "doc_id bigint, item_id bigint, kind string, cosine double, n_common bigint, n_words bigint"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())

    def over(search: Search) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole):
                    ids = batch.column(0).to_pylist()
                    rows = [(ids[text], *rest) for text, *rest in search.leaks(batch.column(1).to_pylist())]
                    columns = zip(*rows) if rows else [()] * len(kinds)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list("abcdef"))

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    found = [over(search) for search in searches(docs.select("text"), benchmark, copied, paraphrased)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = F.max_by(F.struct("kind", "cosine", "n_common", "n_words"), F.struct(F.col("n_common") / F.col("n_words"), "cosine"))
    if len(found) > 1:  # parts of one item may be in two blocks
        out = out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, copied: float = 0.7, paraphrased: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that leak nothing, all columns."""
    at, out = docs.columns.index("text"), docs
    for search in searches(docs.select("text"), benchmark, copied, paraphrased):

        def run(batches: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole):
                    clean = np.ones(batch.num_rows, bool)
                    clean[[text for text, *_ in search.leaks(batch.column(at).to_pylist())]] = False
                    yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out

"""Exact top-k by inner product, pruned with segment means and deviations from coarse to fine.

Cut two vectors into segments of equal length l.  With the means m and deviations s of
their segments, Cauchy and Schwarz give for each segment

    |x - y|^2 >= l ((mx - my)^2 + (sx - sy)^2),   so   x . y <= l (mx my + sx sy).

As ``x . y = (|x|^2 + |y|^2 - |x - y|^2) / 2``, the sums over all segments are a lower
bound of the distance and an upper bound of the score, and finer segments give closer
bounds.  Candidates are written in blocks of bounded size by a hash; every query meets
every block.  In a block, the candidates with the best bounds of the middle resolution
are scored first; the k-th best of these scores is what a candidate has to reach.
Bounds, rounded up by more than all rounding errors, rule candidates out level by level,
and the scores of all that are left are computed exactly.

Components are whole numbers (``floor(256 * x)``), and scores are exact: doubles where they
provably hold them, Python's whole numbers beyond.  A task holds one block of candidates
and one slice of queries; queries stream through it, so no query set is too large.

Queries are the rows with an id divisible by ``every``; a query's candidates are all rows
but itself (a repeated row is another row).  Result: ``query_id, rank, vec_id, score``; ties
go to the smaller ``vec_id``, null ids last.  Vectors that are null or hold a null or
non-finite component take no part; a shorter vector counts as if it ended in zeros, an empty
one as zeros alone.  Rows with a null id are candidates only.  Repeated query rows have
their rows each.  With fewer than k candidates all are returned; an empty table gives an
empty result.  Other columns are ignored.  A score is null where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchlens.llm.common import settle
from batchlens.llm.vectors import LONG, as_exact, matrix, usable, whole_numbers

BLOCK_ROWS = 32_768  # candidates that one task holds at once, on average
SLICE = 128  # queries that meet a block together
LEVELS = (1, 4, 16)  # segments of a vector, coarse to fine
ROUNDING = 2.0**-30  # relative; the bounds lose less than 2 ** -40
_NO_ID = np.iinfo(np.int64).max  # null ids come last


def segment_statistics(x: np.ndarray, level: int) -> np.ndarray:
    """(rows, 2 * level): means and deviations of each segment, times the root of its length.

    The product of two vectors' rows bounds their score from above.  A last segment that is
    shorter is filled with zeros.
    """
    n, d = x.shape
    length = max(1, -(-d // level))
    whole = np.zeros((n, level * length))
    whole[:, :d] = x.astype(float)
    parts = whole.reshape(n, level, length)
    means, deviations = parts.mean(axis=2), parts.std(axis=2)
    return np.concatenate([means, deviations], axis=1) * np.sqrt(length)


class Block:
    """Candidates of one block, with what their bounds need."""

    def __init__(self, uid: np.ndarray, vec_id: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(vec_id, kind="stable")  # so that places in the block settle ties
        self.uid, self.vec_id, self.x = uid[order], vec_id[order], x[order]
        self.place = {u: i for i, u in enumerate(self.uid.tolist())}
        self.norms = np.sqrt((self.x * self.x).sum(axis=1))
        self.statistics = [segment_statistics(self.x, level) for level in LEVELS]

    def best(self, uid: np.ndarray, q: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
        """(query, place, score) of each query's k best here, and how many exact scores that took."""
        n, (rows, d) = len(q), self.x.shape
        exact = as_exact(np.concatenate([self.x, q]), d)
        x, queries = exact[:rows], exact[rows:]
        slack = np.sqrt((q * q).sum(axis=1))[:, None] * self.norms * ROUNDING
        of_queries = [segment_statistics(q, level) for level in LEVELS]
        own = [(i, self.place[u]) for i, u in enumerate(uid.tolist()) if u in self.place]  # queries that are in the block

        # what has to be reached: the k-th best score among those with the best bounds
        middle = of_queries[1] @ self.statistics[1].T + slack
        for i, j in own:
            middle[i, j] = -np.inf
        first = min(rows, 4 * k + 1)
        tried = np.argpartition(-middle, first - 1, axis=1)[:, :first]
        reach = np.empty(n)
        taken = n * first
        own_of = dict(own)
        for i in range(n):
            places = tried[i][tried[i] != own_of.get(i, -1)]
            scores = np.sort((x[places] @ queries[i]).astype(float))
            reach[i] = scores[-k] if len(scores) >= k else -np.inf
        known = np.isfinite(reach)
        reach[known] -= np.abs(reach[known]) * ROUNDING

        # coarse to fine: the first levels on all, the last and the scores on what is left
        coarse = of_queries[0] @ self.statistics[0].T + slack
        asked = (coarse >= reach[:, None]) & (middle >= reach[:, None])
        for i, j in own:
            asked[i, j] = False
        a, b = np.nonzero(asked)
        many = x.dtype != object and len(a) > asked.size // 8
        dense = queries @ x.T if many else None  # whole numbers, so the order of the sums does not matter
        out, step = [], 1 << 16
        for start in range(0, len(a), step):
            i, j = a[start : start + step], b[start : start + step]
            left = np.einsum("ij,ij->i", of_queries[2][i], self.statistics[2][j]) + slack[i, j] >= reach[i]
            i, j = i[left], j[left]
            taken += len(i)
            scores = dense[i, j] if many else (queries[i] * x[j]).sum(axis=1)
            out.append(_best_of_each(i, j, scores, k))
        if not out:
            return [], taken
        i, j, scores = _best_of_each(*(np.concatenate(c) for c in zip(*out)), k)
        return list(zip(i.tolist(), j.tolist(), map(int, scores))), taken


def _best_of_each(query: np.ndarray, place: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query; ties go to the first places."""
    by_score = np.array(sorted(range(len(scores)), key=lambda n: (-scores[n], place[n])), dtype=np.int64) if scores.dtype == object else np.lexsort((place, -scores))
    order = by_score[np.argsort(query[by_score], kind="stable")]
    mine = query[order]
    kept = order[np.arange(len(mine)) - np.searchsorted(mine, mine) < k]
    return query[kept], place[kept], scores[kept]


def _search(k: int, d: int):
    """Over rows in the order (block, candidates first): holds a block, lets queries stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number, block = None, None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(numbers)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                part = batch.slice(a, b - a)
                if numbers[a] != number:
                    number, held, block = numbers[a], [], None
                asks = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                split = int(np.searchsorted(asks, True))
                if split:
                    held.append(part.slice(0, split))
                if split == len(asks):
                    continue
                if block is None and held:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]
                    held, block = [], Block(whole.column(2).to_numpy(), _ids(whole.column(3)), matrix(whole.column(4), d))
                if block is None:
                    continue
                queries = part.slice(split)
                for start in range(0, queries.num_rows, SLICE):
                    some = queries.slice(start, SLICE)
                    uid, ids = some.column(2).to_numpy(), some.column(3)
                    found, _ = block.best(uid, matrix(some.column(4), d), k)
                    if found:
                        yield _rows(found, uid, ids, block)

    return run


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _rows(found: list, uid: np.ndarray, ids: pa.Array, block: Block) -> pa.RecordBatch:
    at, place, score = zip(*found)
    places = np.array(place)
    vec_id = block.vec_id[places]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(uid[list(at)]),
            ids.take(pa.array(at)),
            pa.array(vec_id, mask=vec_id == _NO_ID),
            pa.array([s if abs(s) <= LONG else None for s in score], pa.int64()),
            pa.array([float(s) for s in score], pa.float64()),
        ],
        names=["uid", "query_id", "vec_id", "score", "about"],
    )


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best candidates by exact inner product."""
    spark, column = vectors.sparkSession, F.col("embedding")
    some = vectors.filter(usable(column)).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole_numbers(column).alias("q"))
    rows = settle(some.withColumn("uid", F.monotonically_increasing_id()))
    n, d = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    blocks = max(1, -(-n // block_rows), min(n // 256, 2 * spark.sparkContext.defaultParallelism))
    candidates = rows.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "uid", "vec_id", "q")
    queries = rows.filter(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "uid", "vec_id", "q"
    )
    dealt = candidates.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    fields = "uid bigint, query_id bigint, vec_id bigint, score bigint, about double"
    found = dealt.mapInArrow(_search(k, max(d, 1)), fields)
    order = [F.col("about").desc(), F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    best = Window.partitionBy("uid").orderBy(*order)  # at most k rows a block reach it
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Clusters of whole-number vectors around centroids, with Ptolemaic lower bounds from pivots.

For pivots s, t, a vector x and a centroid c, Ptolemy's inequality in Euclidean space
gives ``d(x, c) >= |d(x, s) d(c, t) - d(x, t) d(c, s)| / d(s, t)``.  The pivots are
chosen once among the first centroids and paired once; a vector's distances to them
are computed once and stored beside it.  In each round a vector's bounds to all
centroids come from these distances; its exact distance to the centroid with the least
bound is the first upper bound, and only centroids whose bound, rounded down by more
than all rounding errors together, does not exceed it are compared exactly.

Components are whole numbers, and so are squared distances, sums and the new
centroids (``floor(sum / count)``), whatever the order of rows and tasks: doubles where
they provably hold all numbers exactly, Python's whole numbers beyond.  Rounds are
passes over one written table; a task sends one row of sums a cluster, and nothing but
the centroids reaches the driver.

Only vectors with exactly ``dimensions`` components, none null or non-finite, take part;
others have no row in the result.  The first centroids are the ``clusters`` vectors with
the smallest SHA-256 of ``<prefix><vec_id>`` (ties: by their components; rows with a null
id come last and have a row in the result like others).  With fewer vectors there are
fewer clusters; repeated rows count each for itself, and so may lead to equal centroids,
of which the one with the smaller number gets the vectors.  An empty table gives an empty
result.  Other columns are ignored.  ``distance`` and the inertias are null where they do
not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.llm.common import settle
from batchlens.llm.vectors import EXACT, LONG, as_exact, as_longs, matrix, usable, whole_numbers

PIVOTS = 8
ROUNDING = 2.0**-40  # relative; what the bounds below lose is below 2 ** -48


@dataclass(frozen=True)
class Pivots:
    """``points`` and the pairs of them (``first``, ``second``, each ``apart`` > 0) that bounds are made from."""

    points: np.ndarray
    first: np.ndarray
    second: np.ndarray
    apart: np.ndarray

    @classmethod
    def among(cls, centroids: np.ndarray) -> Pivots:
        """Points that lie far from those already chosen; each is paired with the next and the one across."""
        chosen = [0]
        nearest = distances(centroids, centroids[:1])[:, 0]
        while len(chosen) < min(PIVOTS, len(centroids)) and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(centroids, centroids[chosen[-1:]])[:, 0])
        n = len(chosen)
        pairs = sorted({tuple(sorted((i, (i + step) % n))) for i in range(n) for step in {1, n // 2}} - {(i, i) for i in range(n)})
        first, second = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
        points = centroids[chosen]
        return cls(points, first, second, distances(points, points)[first, second])

    def lower_bounds(self, to_vectors: np.ndarray, to_centroids: np.ndarray) -> np.ndarray:
        """(vectors, centroids): what the distance is at least, rounded down; from distances to the pivots."""
        best = np.zeros((len(to_vectors), len(to_centroids)))
        for s, t, apart in zip(self.first, self.second, self.apart):
            a = to_vectors[:, s, None] * to_centroids[None, :, t]
            b = to_vectors[:, t, None] * to_centroids[None, :, s]
            np.maximum(best, (np.abs(a - b) - (a + b) * ROUNDING) / apart, out=best)
        return best * (1 - ROUNDING)


def squares(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one point, or to a point each."""
    both = vectors - point
    return (both * both).sum(axis=1)


def distances(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(vectors, points), as doubles close to the true distances."""
    out = np.empty((len(vectors), len(points)))
    for k, p in enumerate(points):
        out[:, k] = np.sqrt(squares(vectors, p).astype(float))
    return out


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each vector's nearest centroid, and how many distances that took."""
    n, d = vectors.shape
    exact = as_exact(np.concatenate([vectors, centroids]), d, 4)  # differences are at most twice as large
    vectors, points = exact[:n], exact[n:]
    bounds = pivots.lower_bounds(to_pivots, distances(points, pivots.points))
    cluster = bounds.argmin(axis=1)
    least = squares(vectors, points[cluster])
    # a bound beyond a known distance rules a centroid out; equal ones are compared, as the smaller number wins
    reach = np.sqrt(least.astype(float)) * (1 + ROUNDING)
    asked = bounds <= reach[:, None]
    asked[np.arange(n), cluster] = False
    for k in np.flatnonzero(asked.any(axis=0)):
        rows = np.flatnonzero(asked[:, k])
        found = squares(vectors[rows], points[k])
        better = (found < least[rows]) | ((found == least[rows]) & (k < cluster[rows]))
        cluster[rows[better]], least[rows[better]] = k, found[better]
    return cluster, least, n + int(asked.sum())


def first_centroids(vectors: DataFrame, n: int, clusters: int, prefix: str) -> np.ndarray:
    """The vectors with the smallest hashes, found by a cutoff that lets few through; no task sends more than ``clusters``."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).cast("binary"), 256).alias("hash"), "q")
    want, share = min(clusters, n), min(1.0, 4.0 * clusters / max(n, 1))
    while True:
        low = hashed if share >= 1 else hashed.filter(F.col("hash") <= f"{int(share * (16**12 - 1)):012x}" + "f" * 52)
        rows = low.orderBy(F.col("hash").asc_nulls_last(), "q").limit(want).collect()  # at most ``clusters`` rows
        if len(rows) == want or share >= 1:
            return np.array([r["q"] for r in rows], dtype=float).reshape(len(rows), -1)
        share *= 16


def cluster_vectors(
    vectors: DataFrame, clusters: int = 40, rounds: int = 5, dimensions: int = 64, prefix: str = "2:"
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that takes part."""
    spark, column = vectors.sparkSession, F.col("embedding")
    fit = usable(column) & (F.size(column) == dimensions)
    rows = settle(vectors.filter(fit).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole_numbers(column).alias("q")))
    n = rows.count()
    fields = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not n:
        return spark.createDataFrame([], fields)
    centroids = first_centroids(rows, n, clusters, prefix)
    pivots = Pivots.among(as_exact(centroids, dimensions, 4))

    def with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(1), dimensions)
            both = as_exact(np.concatenate([q, pivots.points.astype(float)]), dimensions, 4)
            near = distances(both[: len(q)], both[len(q) :])
            held = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, held], names=["vec_id", "q", "near"])

    rows = settle(rows.mapInArrow(with_pivots, "vec_id bigint, q array<double>, near array<double>"))
    for _ in range(rounds):
        centroids = _moved(rows, centroids, pivots)
    return _assigned(rows, centroids, pivots)


def _batches(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: Pivots):
    for batch in batches:
        q = matrix(batch.column(1), centroids.shape[1])
        near = matrix(batch.column(2), len(pivots.points))
        yield batch, q, *nearest(q, near, centroids, pivots)[:2]


def _moved(rows: DataFrame, centroids: np.ndarray, pivots: Pivots) -> np.ndarray:
    """``floor(sum / count)`` of each cluster's vectors; empty clusters stay."""
    k, d = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, d), dtype=object), np.zeros(k, dtype=np.int64)
        for _, q, cluster, _ in _batches(batches, centroids, pivots):
            count += np.bincount(cluster, minlength=k)
            small = float(np.abs(q).max(initial=0.0)) * len(q) < 2.0**53
            for c in np.unique(cluster):
                mine = q[cluster == c]
                part = mine.sum(axis=0) if small else np.frompyfunc(int, 1, 1)(mine).sum(axis=0)
                total[c] += np.array([int(v) for v in part], dtype=object)
        held = [c for c in range(k) if count[c]]
        # a sum in two numbers, its multiples of 10 ** 15 and the rest: both are added up without loss
        high = [[int(v // 10**15) for v in total[c]] for c in held]
        low = [[int(v % 10**15) for v in total[c]] for c in held]
        of = pa.list_(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array([count[c] for c in held], pa.int64()), pa.array(high, of), pa.array(low, of)],
            names=["cluster", "n", "high", "low"],
        )

    added = rows.mapInArrow(sums, "cluster int, n bigint, high array<decimal(38,0)>, low array<decimal(38,0)>").groupBy("cluster").agg(
        F.sum("n").alias("n"),
        *[F.array(*[F.sum(F.col(part)[i]) for i in range(d)]).alias(part) for part in ("high", "low")],
    )
    moved = centroids.astype(object)
    for r in added.collect():  # one row a cluster
        sums_ = [int(h) * 10**15 + int(low) for h, low in zip(r["high"], r["low"])]
        moved[r["cluster"]] = [s // r["n"] for s in sums_]
    return moved.astype(float) if np.abs(moved).max() < EXACT else moved


def _assigned(rows: DataFrame, centroids: np.ndarray, pivots: Pivots) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, least in _batches(batches, centroids, pivots):
            arrays = [batch.column(0), pa.array(cluster, pa.int32()), as_longs(least)]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cluster", "distance"])

    done = settle(rows.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"))
    each = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("beyond"))
    totals = {r["cluster"]: None if r["beyond"] else int(r["total"]) for r in each.collect()}  # one row a cluster
    all_ = None if None in totals.values() else sum(totals.values())
    fit = lambda v: None if v is None or v > LONG else v
    digests = {c: hashlib.sha256(",".join(str(int(v)) for v in centroids[c]).encode()).hexdigest() for c in totals}
    named = [(c, fit(total), fit(all_), digests[c]) for c, total in totals.items()]
    facts = done.sparkSession.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select(  # a row a cluster
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

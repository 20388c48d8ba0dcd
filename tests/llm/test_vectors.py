"""Clusters and top-k of vectors against brute force in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from batchlens.llm.centroids import Pivots, cluster_vectors, distances, nearest
from batchlens.llm.topk import Block, segment_statistics, top_k
from batchlens.llm.vectors import LARGEST

SCHEMA = "vec_id bigint, embedding array<double>, label int, q int, uid int, near int, cluster int, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, 1, 2, 3, 4, 5) for i, e in rows], SCHEMA)


def whole(e):
    return [math.floor(256 * x) for x in e]


def fine(e):
    return e is not None and all(x is not None and math.isfinite(x) and abs(x) <= LARGEST for x in e)


def odd_vectors(d, seed, large=False):
    """Nulls, wrong lengths, ties, repeated rows and ids, and a vector that many rows share."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(0, 1, d) + 3 * (i % 4)).tolist()) for i in range(120)]
    hot = rng.normal(0, 1, d).tolist()
    rows += [(200 + i, hot) for i in range(60)]
    rows += [(50, rows[50][1]), (50, hot), (None, hot), (None, None), (301, None), (302, []), (303, [None] * d), (304, [math.nan] * d)]
    rows += [(305, [math.inf] * d), (306, hot[: d - 1]), (307, [0.0] * d), (350, [-x for x in hot])]
    if large:
        rows += [(400 + i, (rng.normal(0, 1, d) * 1e20).tolist()) for i in range(6)] + [(450, [3e38] * d)]
    return rows


def clusters_by_hand(rows, clusters, rounds, d):
    kept = [(i, whole(e)) for i, e in rows if fine(e) and len(e) == d]
    hash_ = lambda i: "~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centres = [q for _, q in sorted(kept, key=lambda r: (hash_(r[0]), r[1]))[:clusters]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        own = [min((square(q, c), k) for k, c in enumerate(centres)) for _, q in kept]
        if r < rounds:
            groups = {}
            for (_, q), (_, k) in zip(kept, own):
                groups.setdefault(k, []).append(q)
            centres = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centres)]
    total = {}
    for s, k in own:
        total[k] = total.get(k, 0) + s
    fit = lambda v: v if v < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    whole_ = all(s < 2**63 for s, _ in own)
    held = {k: all(s < 2**63 for s, j in own if j == k) for k in total}
    return [
        (i, k, fit(s), fit(total[k]) if held[k] else None, fit(sum(total.values())) if whole_ else None, digest[k])
        for (i, _), (s, k) in zip(kept, own)
    ]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("d,clusters", [(4, 7), (8, 40)])
def test_clusters_equal_brute_force(spark, d, clusters, large):
    rows = odd_vectors(d, d, large)
    got = cluster_vectors(frame(spark, rows).repartition(5), clusters, 5, d).collect()
    assert ordered(map(tuple, got)) == ordered(clusters_by_hand(rows, clusters, 5, d))


def test_fewer_vectors_than_clusters_and_empty_tables(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [9.0, 9.0])]
    got = cluster_vectors(frame(spark, rows), 40, 5, 2).collect()
    assert ordered(map(tuple, got)) == ordered(clusters_by_hand(rows, 40, 5, 2))
    for some in ([], [(1, None)], [(1, [1.0])]):
        assert cluster_vectors(frame(spark, some), 40, 5, 2).collect() == []


def test_ptolemaic_bounds_stay_below_and_spare_distances():
    rng = np.random.default_rng(3)
    centres = np.floor(rng.normal(0, 1, (40, 64)) * 256)
    vectors = np.concatenate([np.floor(centres[rng.integers(0, 40, 2000)] + rng.normal(0, 20, (2000, 64))), centres])
    pivots = Pivots.among(centres)
    near = distances(vectors, pivots.points)
    bounds = pivots.lower_bounds(near, distances(centres, pivots.points))
    true = ((vectors[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (bounds**2 <= true).all()
    cluster, least, taken = nearest(vectors, near, centres, pivots)
    assert (cluster == true.argmin(axis=1)).all() and (least == true.min(axis=1)).all()
    assert taken < 0.25 * true.size


def top_by_hand(rows, k, every=50):
    kept = [(i, whole(e)) for i, e in rows if fine(e)]
    out = []
    for n, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, x)), j is None, j or 0, j) for m, (j, x) in enumerate(kept) if m != n]
        for rank, (s, _, _, j) in enumerate(sorted(scored, key=lambda t: t[:3])[:k], 1):
            out.append((i, rank, j, -s if abs(s) < 2**63 else None))
    return out


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("d,block_rows", [(6, 16), (64, 10_000)])
def test_top_k_equals_brute_force(spark, d, block_rows, large):
    rows = odd_vectors(d, d + 1, large)
    got = top_k(frame(spark, rows).repartition(3), k=5, every=50, block_rows=block_rows).collect()
    assert ordered(map(tuple, got)) == ordered(top_by_hand(rows, 5))


def test_top_k_of_few_and_no_candidates(spark):
    assert top_k(frame(spark, [])).collect() == []
    assert top_k(frame(spark, [(50, [1.0])])).collect() == []
    assert top_k(frame(spark, [(50, []), (51, None)])).collect() == []
    got = top_k(frame(spark, [(50, [1.0]), (0, [2.0, 5.0]), (-50, [])])).collect()
    assert ordered(map(tuple, got)) == ordered(top_by_hand([(50, [1.0]), (0, [2.0, 5.0]), (-50, [])], 5))


def test_segment_bounds_tighten_and_spare_scores():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (30, 64)) + np.repeat(rng.normal(0, 2, (30, 16)), 4, axis=1)
    x = np.floor((centres[rng.integers(0, 30, 4000)] + rng.normal(0, 0.1, (4000, 64))) * 256)
    q, scores = x[:50], x[:50] @ x.T
    levels = [segment_statistics(q, n) @ segment_statistics(x, n).T for n in (1, 4, 16, 64)]
    for coarse, fine_ in zip(levels, [*levels[1:], scores]):
        assert (fine_ <= coarse + 1e-3).all()
    uid = np.arange(4000)
    block = Block(uid, uid, x)
    found, taken = block.best(uid[:50], q, 5)
    np.fill_diagonal(scores, -np.inf)
    for i in range(50):
        best = sorted(range(4000), key=lambda j: (-scores[i, j], j))[:5]
        assert [block.vec_id[p] for n, p, _ in found if n == i] == best
    assert taken < 0.25 * scores.size

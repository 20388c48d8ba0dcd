"""Array kernels of the isolation forest, run inside Spark tasks.

A node is named by its place in a binary heap: the root is 1, the children of
``k`` are ``2k`` and ``2k + 1``.  A split depends on the seed, the tree, the node
and the range of the sampled rows in it, and on nothing else; so any task that
knows those draws the same split, whichever way the rows were distributed.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable

import numpy as np
from pyspark import cloudpickle

# Path lengths are added up as whole multiples of 1e-9: exact, in any order.
PATH_UNIT = 1_000_000_000
EULER_GAMMA = 0.5772156649015329

# Tasks get these functions by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` rows: what an unsplit leaf still owes."""
    n = np.asarray(n, dtype=np.float64)
    big = np.maximum(n, 3.0)
    owed = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, owed, np.where(n == 2, 1.0, 0.0))


def leaf_path(depth, n) -> np.ndarray:
    return np.rint((depth + average_path(n)) * PATH_UNIT).astype(np.int64)


def depth_of(nodes: np.ndarray) -> np.ndarray:
    return np.frexp(nodes.astype(np.float64))[1].astype(np.int64) - 1


def draws(seed: int, tree: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in [0, 1) per node, from the first two words of md5('seed|tree|node')."""
    start = hashlib.md5(f"{seed}|{tree}|".encode())
    digests = bytearray()
    for node in nodes.tolist():
        h = start.copy()
        h.update(b"%d" % node)
        digests += h.digest()
    words = np.frombuffer(bytes(digests), dtype=">u4").reshape(-1, 4)
    return words[:, 0] / 4294967296.0, words[:, 1] / 4294967296.0


def choose_splits(seed: int, tree: int, nodes, low, high) -> tuple[np.ndarray, np.ndarray]:
    """Feature and threshold of each node; ``low`` and ``high`` are (feature × node).

    Every feature that varies in the node is equally likely; every node given
    must have one.  Values up to the threshold go left.
    """
    varies = high > low
    u_feature, u_value = draws(seed, tree, nodes)
    pick = np.floor(u_feature * varies.sum(axis=0)).astype(np.int64)
    feature = (varies & (np.cumsum(varies, axis=0) == pick + 1)).argmax(axis=0)
    at = np.arange(len(nodes))
    lo, hi = low[feature, at], high[feature, at]
    threshold = lo + u_value * (hi - lo)
    return feature, np.where(threshold >= hi, lo, threshold)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal neighbours starts, and how long it is."""
    if not values.size:
        return values, values
    starts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
    return starts, np.diff(starts, append=values.size)


def ranked(columns: Iterable[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each feature's values as places in the sorted list of its distinct values, and these lists."""
    places, values = [], []
    for column in columns:
        distinct, at = np.unique(column, return_inverse=True)
        places.append(at.astype(np.int32))
        values.append(distinct)
    return np.stack(places), values


def grow(x, node, sampled, seed: int, tree: int, limit: int, record: list | None = None, values=None) -> np.ndarray:
    """Split rows until they are alone, alike, or ``limit`` deep; returns each row's path length.

    ``x`` is (feature × row).  Rows may start at different nodes.  ``sampled``
    marks the rows that shape the tree (None: all of them); the others only fall
    through it.  With ``record``, every node met is appended as
    (node, depth, feature or -1, threshold, sampled rows).  ``values`` says that
    ``x`` holds places in these lists, as ``ranked`` gives them: half the bytes,
    for many trees over the same rows.
    """
    path = np.zeros(x.shape[1], dtype=np.int64)
    # Rows stay sorted by node, in each node the sampled ones first; so nodes are known by their sizes.
    rows = np.argsort(node, kind="stable") if sampled is None else np.lexsort((~sampled, node))
    # Two places for the values are used in turn: new ones for each level would take as long as filling them.
    d, places = len(x), np.empty((2, x.size), dtype=x.dtype)
    x = np.take(x, rows, axis=1, out=places[0].reshape(x.shape), mode="clip")
    starts, sizes = runs(node[rows])
    ids = node[rows[starts]]
    counts = sizes if sampled is None or not rows.size else np.add.reduceat(sampled[rows], starts, dtype=np.int64)
    while rows.size:
        starts = np.cumsum(sizes) - sizes
        edges, at = (starts, slice(None)) if sampled is None else _sampled_edges(starts, sizes, counts)
        low, high = (reduce.reduceat(x, edges, axis=1)[:, at] for reduce in (np.minimum, np.maximum))
        depth = depth_of(ids)
        splits = (high > low).any(axis=0) & (depth < limit) & (counts > 1)
        ends = leaf_path(depth, counts)
        if record is None:
            # Two sampled rows that differ are alone one level down, whatever the draw.
            pairs = splits & (sizes == 2) & (counts == 2)
            ends[pairs] = (depth[pairs] + 1) * PATH_UNIT
            splits &= ~pairs
        feature = np.full(ids.size, -1, dtype=np.int64)
        threshold = np.zeros(ids.size)
        if splits.any():
            low, high = low[:, splits], high[:, splits]
            if values is not None:
                low, high = (np.stack([own.take(at) for own, at in zip(values, side)]) for side in (low, high))
            feature[splits], threshold[splits] = choose_splits(seed, tree, ids[splits], low, high)
        if record is not None:
            record.append((ids, depth, feature, threshold, counts))
        if values is not None:
            threshold = _places_of(values, feature, threshold)
        kept = None
        if not splits.all():
            onward = np.repeat(splits, sizes)
            path[rows[~onward]] = np.repeat(ends[~splits], sizes[~splits])
            kept = np.flatnonzero(onward)
            ids, sizes, counts, feature, threshold = (of[splits] for of in (ids, sizes, counts, feature, threshold))
            if not kept.size:
                break
        place = np.repeat(feature * x.shape[1], sizes)
        place += np.arange(place.size) if kept is None else kept
        right = x.ravel().take(place) > np.repeat(threshold, sizes)
        starts = np.cumsum(sizes) - sizes
        rights = np.add.reduceat(right, starts, dtype=np.int64)
        lefts = sizes - rights
        # Stable partition of every group into its left and right child.
        order = np.empty(right.size, dtype=np.int64)
        for side, n, before in ((~right, lefts, np.cumsum(rights) - rights), (right, rights, np.cumsum(lefts))):
            place = np.repeat(before, n)
            place += np.arange(place.size)
            side = np.flatnonzero(side)
            order[place] = side if kept is None else kept.take(side)
        rows, places = rows.take(order), places[::-1]
        x = np.take(x, order, axis=1, out=places[0, : d * order.size].reshape(d, order.size), mode="clip")
        ids = np.stack([2 * ids, 2 * ids + 1], axis=1).ravel()
        if sampled is not None:
            edges, at = _sampled_edges(starts, sizes, counts)
            chosen = np.add.reduceat(right, edges, dtype=np.int64)[at]
            counts = np.stack([counts - chosen, chosen], axis=1).ravel()
        sizes = np.stack([lefts, rights], axis=1).ravel()
        counts = sizes if sampled is None else counts
    return path


def _places_of(values: list[np.ndarray], feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The place of the largest value up to each threshold."""
    out = np.zeros(feature.size, dtype=np.int32)
    for i, own in enumerate(values):
        mine = np.flatnonzero(feature == i)
        out[mine] = np.searchsorted(own, threshold[mine], "right") - 1
    return out


def _sampled_edges(starts, sizes, counts) -> tuple[np.ndarray, np.ndarray]:
    """Where to cut rows so that the first ``counts`` of each node are a piece, and the places of these pieces."""
    others = (counts > 0) & (counts < sizes)
    at = np.arange(starts.size) + np.cumsum(others) - others
    edges = np.empty(starts.size + np.count_nonzero(others), dtype=np.int64)
    edges[at] = starts
    edges[at[others] + 1] = (starts + counts)[others]
    return edges, at


def tree_table(tree, node, feature, threshold) -> dict:
    """Some trees, or the tops of some trees, as flat arrays for walking rows down.

    Slot numbers run over all nodes of all trees; ``feature`` is -1 where a walk
    ends.  A plain dict of arrays, so that it can be broadcast as it is;
    ``order`` maps slots back to the rows passed in.
    """
    order = np.lexsort((node, tree))
    tree, node = np.asarray(tree, dtype=np.int64)[order], np.asarray(node, dtype=np.int64)[order]
    feature = np.asarray(feature)[order].astype(np.int64)
    left, right, roots = np.arange(order.size), np.arange(order.size), {}
    inner = np.flatnonzero(feature >= 0)
    # A side no row has reached yet: the walk ends where it stands.
    for child, side in ((left, 0), (right, 1)):
        at = slots_of(tree, node, tree[inner], 2 * node[inner] + side)
        child[inner] = np.where(at < 0, inner, at)
    for i in np.flatnonzero(node == 1).tolist():
        roots[int(tree[i])] = i
    return {
        "tree": tree,
        "node": node,
        "feature": feature,
        "threshold": np.asarray(threshold, dtype=np.float64)[order],
        "left": left,
        "right": right,
        "roots": roots,
        "order": order,
    }


def slots_of(tree: np.ndarray, node: np.ndarray, of_tree: np.ndarray, of_node: np.ndarray) -> np.ndarray:
    """Where each wanted (tree, node) lies in a table sorted by both; -1 where it is not there."""
    found = np.full(len(of_tree), -1, dtype=np.int64)
    for t in np.unique(of_tree).tolist():
        lo, hi = np.searchsorted(tree, t, "left"), np.searchsorted(tree, t, "right")
        wanted = np.flatnonzero(of_tree == t)
        at = lo + np.searchsorted(node[lo:hi], of_node[wanted])
        there = at < hi
        there[there] = node[at[there]] == of_node[wanted[there]]
        found[wanted[there]] = at[there]
    return found


def walk(table: dict, x: np.ndarray, tree: int) -> np.ndarray:
    """The slot at which each row's walk through ``tree`` ends."""
    return descend(table, x, np.full(x.shape[1], table["roots"][tree], dtype=np.int64))


def descend(table: dict, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The slot at which each row's walk ends that begins at slot ``at``."""
    features, thresholds, lefts, rights = (table[k] for k in ("feature", "threshold", "left", "right"))
    n, flat, at = x.shape[1], x.ravel(), at.copy()
    moving, slot = np.arange(n), at.copy()
    while moving.size:
        feature = features.take(slot)
        if feature.min() < 0:
            inner = np.flatnonzero(feature >= 0)
            moving, slot, feature = moving.take(inner), slot.take(inner), feature.take(inner)
        onward = np.where(flat.take(feature * n + moving) > thresholds.take(slot), rights.take(slot), lefts.take(slot))
        at[moving] = onward
        stuck = onward == slot
        if stuck.any():
            moving, onward = moving[~stuck], onward[~stuck]
        slot = onward
    return at

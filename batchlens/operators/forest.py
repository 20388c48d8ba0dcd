"""Isolation forest as Spark jobs.

Two ways to choose the rows a tree is grown from:

* a number ψ: every tree sees ψ rows.  The trees are then small whatever the
  table; growing them costs trees × ψ rows, and scoring is one pass without an
  exchange.  This is the way to run on a table of any size.
* ``"all"``: every tree sees every (sampled) row, so the work is rows × trees by
  definition.  Large nodes are split by counting passes over the table, their
  splits held in a table of at most ``table_nodes`` nodes that goes to every task;
  where that table would grow too large, nodes still above ``group_rows`` rows are
  split level by level in the frame, where no split reaches the driver.  Once a
  node fits, its rows meet in one task that finishes it.  Trees of a few levels
  are counted to their leaves, and no row is moved.

Scores do not depend on how rows are distributed, on ``group_rows``, or on how
many trees a task grows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import pairwise
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchlens.functions import hash_text, isolation
from batchlens.operators.ranking import global_rank, sample_flag
from batchlens.sources.shared import discard, lot_of, lots_for, settle, stored, stored_in_lots

TABLE_NODES = 2_000_000  # nodes of a tree table that may be sent to every task (about 50 bytes each)
_LEVELS = 8  # trees no deeper than this are grown by counting passes alone
_LOT = 1 << 18  # rows that meet a part of a tree in one task
_ON_THE_WAY = 1 << 30  # rows, each once a tree, that are exchanged at a time
_FEW = 1 << 20  # rows of a table that is written out and spread before it is worked on
_GROUP = ("seed", "first_tree", "last_tree", "bin")  # rows that one task works on together
_PATH_FIELDS = "id bigint, seed bigint, last_tree int, path bigint"
_NODE_FIELDS = "tree int, node bigint, depth int, feature int, threshold double, n bigint"


@dataclass(frozen=True)
class IsolationForest:
    """``max_samples`` is "all" or a number of rows per tree; ``max_depth`` None means ⌈log2 ψ⌉.

    What a task holds is bounded by ``group_rows`` and ``table_nodes``, whatever the table.
    """

    trees: int = 100
    max_samples: int | str = "all"
    seed: int = 42
    max_depth: int | None = None
    group_rows: int = 1 << 21
    table_nodes: int = TABLE_NODES

    def fit_score(
        self,
        df: DataFrame,
        cols: Sequence[str],
        key: str = "row_key",
        sampled: str | None = None,
        sizes: Sequence[int] = (),
    ) -> DataFrame:
        """Grow the forest and score every row: ``key``, ``score_<size>``, ``decision_<size>``.

        Trees are drawn one by one, so the first 100 of 500 are a forest of 100:
        ``sizes`` asks for several forests out of one growth.  Without it the
        columns are ``score`` and ``decision``.  ``sampled`` names a boolean
        column marking the rows trees are grown from; all rows are scored.
        """
        cuts = sorted(set(sizes)) or [self.trees]
        if cuts[-1] > self.trees:
            raise ValueError("a size exceeds the number of trees")
        totals, psi = self._totals(df, list(cols), key, {self.seed: sampled}, cuts)
        names = {(self.seed, c): f"_{c}" if sizes else "" for c in cuts}
        return _scores(totals, key, names, psi)

    def fit_score_seeds(
        self, df: DataFrame, cols: Sequence[str], sampled: Mapping[int, str | None], key: str = "row_key", keep: bool = False
    ) -> DataFrame:
        """One forest per seed, grown and walked together: ``key``, ``score_<seed>``, ``decision_<seed>``.

        ``sampled`` maps each seed to the boolean column marking its rows; with ``keep``
        these columns are passed on.
        """
        totals, psi = self._totals(df, list(cols), key, sampled, [self.trees])
        flags = [F.col(_flag(seed)).alias(column) for seed, column in sampled.items() if column] if keep else []
        return _scores(totals, key, {(seed, self.trees): f"_{seed}" for seed in sampled}, psi, flags)

    def _totals(self, df, cols, key, sampled: Mapping[int, str | None], cuts) -> tuple[DataFrame, dict[int, int]]:
        """Path totals per row, seed and cut beside the key and the flags; and the rows each seed's trees were grown from."""
        d, seeds = len(cols), list(sampled)
        rows = _matrix(df, cols, key, sampled)
        facts = _facts(rows, d, seeds)
        rows = _spread(rows, facts[seeds[0]].n_rows)
        flags = [_flag(s) for s in seeds]
        if self.max_samples == "all" and not self._shallow(facts[seeds[0]]):
            # Rows go through Python once per tree or block: as a number, not as their key.
            rows = rows.withColumn("id", F.monotonically_increasing_id())
            rows = rows if facts[seeds[0]].n_rows <= _FEW else stored(rows)
            parts = self._grow_all(rows.drop("key"), facts, d, cuts)
            lots = lots_for(facts[seeds[0]].n_rows)

            def totals(lot: int) -> DataFrame:
                mine = lot_of(lots, lot, ["id"])
                sums = _union(parts).filter(mine).groupBy("id").agg(*_sums(seeds, cuts))
                return sums.join(rows.filter(mine).select("id", "key", *flags), "id")

            found = totals(0) if lots == 1 else stored_in_lots(rows.sparkSession, lots, totals)
            if lots > 1:
                for table in (rows, *parts):
                    discard(table)
            return found, {s: facts[s].n_sampled for s in seeds}
        psi, parts, plan = {}, [], {}
        counted = _narrow(rows, facts[seeds[0]].n_rows) if self.max_samples == "all" else None
        for k, seed in enumerate(seeds):
            if counted is None:
                nodes, psi[seed] = self._grow_sampled(rows, facts[seed], d, seed)
            else:
                nodes, psi[seed] = self._grow_counted(counted, facts[seed], d, seed), facts[seed].n_sampled
            # seed after seed, the trees of all forests are one series of numbers
            parts.append(nodes.withColumn("tree", F.col("tree") + F.lit(k * self.trees)))
            plan |= {k * self.trees + c: (_total(seed, c), c == cuts[-1]) for c in cuts}
        return _walk(rows, _union(parts), d, plan, flags, self.table_nodes), psi

    def fit(self, df: DataFrame, cols: Sequence[str], key: str = "row_key", sampled: str | None = None) -> DataFrame:
        """The node table (tree, node, depth, feature, threshold, n); leaves have no feature.

        Features are numbered as in ``cols``.  Write it with ``write_table`` and
        score later rows against it with ``score``.
        """
        d = len(cols)
        rows = _matrix(df, list(cols), key, {self.seed: sampled})
        facts = _facts(rows, d, [self.seed])
        rows = _spread(rows, facts[self.seed].n_rows)
        if self.max_samples != "all":
            return self._grow_sampled(rows, facts[self.seed], d, self.seed)[0]
        if self._shallow(facts[self.seed]):
            return self._grow_counted(_narrow(rows, facts[self.seed].n_rows), facts[self.seed], d, self.seed)
        rows = rows.drop("key")
        limit = self._limit(facts[self.seed].n_sampled)
        if facts[self.seed].n_rows <= self.group_rows:
            return _grow_nodes(_share_out(rows, self._blocks(rows, [self.seed], [self.trees])), d, {self.seed: limit})
        tops = list(self._tops(rows, facts[self.seed], d, self.seed))
        groups, _, nodes = self._all_groups(tops, rows, d, limit)
        return _union([*[top.own_nodes(rows.sparkSession) for top in tops], _grow_nodes(groups, d, {self.seed: limit}), *nodes])

    # -- every row in every tree -------------------------------------------------

    def _limit(self, psi: int) -> int:
        return self.max_depth if self.max_depth is not None else ceil(log2(max(psi, 2)))

    def _blocks(self, rows: DataFrame, seeds: Sequence[int], cuts: Sequence[int]) -> list[tuple[int, int, int]]:
        """(seed, first tree, last tree): runs of trees that share one copy of the rows; none crosses a cut."""
        copies = max(32, 4 * rows.sparkSession.sparkContext.defaultParallelism)
        width = max(1, ceil(self.trees * len(seeds) / copies))
        edges = [0, *cuts] if cuts[-1] == self.trees else [0, *cuts, self.trees]
        runs = [(lo + 1, min(lo + width, b)) for a, b in pairwise(edges) for lo in range(a, b, width)]
        return [(seed, first, last) for seed in seeds for first, last in runs]

    def _grow_all(self, rows: DataFrame, facts: Mapping[int, _Facts], d: int, cuts: Sequence[int]) -> list[DataFrame]:
        """(id, seed, last_tree, path) in parts; of many rows, a part is as many trees as may be exchanged at a time, and a table."""
        limits = {seed: self._limit(f.n_sampled) for seed, f in facts.items()}
        if next(iter(facts.values())).n_rows <= self.group_rows:
            return [_grow_paths(_share_out(rows, self._blocks(rows, list(facts), cuts)), d, limits)]
        parts = []
        for seed in facts:
            lots = list(_lots_of_tops(self._tops(rows, facts[seed], d, seed), facts[seed].n_rows))
            for some in lots:
                groups, ended, _ = self._all_groups(some, rows, d, limits[seed])
                paths = [_grow_paths(groups, d, limits), *ended, *[top.finished_paths(rows, d) for top in some if top.finished]]
                parts += paths if len(lots) == 1 else [stored(_union(paths))]
        return parts

    def _groups(self, top: _Tops, rows: DataFrame, d: int, limit: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
        return self._all_groups([top], rows, d, limit)

    def _all_groups(self, tops: list[_Tops], rows: DataFrame, d: int, limit: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
        """Rows in groups that a task can finish; paths of rows that ended before; nodes decided before.

        What the tops of all trees left above ``group_rows`` is split together.
        """
        lots = _union([top.rows_by_bin(rows, d) for top in tops])
        if not any(top.large for top in tops):
            return lots, [], []
        lots = settle(lots)
        groups, ended, nodes = _split_in_frame(lots.filter(F.col("bin") < 0), d, limit, self.group_rows)
        whole = lots.filter(F.col("bin") >= 0).withColumn("bin", F.col("bin").cast("string"))
        return whole.unionByName(groups), ended, nodes

    def _tops(self, rows: DataFrame, facts: _Facts, d: int, seed: int, group_rows: int | None = None):
        """The tops of all trees, as many trees at a time as ``table_nodes`` can hold."""
        group_rows = self.group_rows if group_rows is None else group_rows
        limit, first, width = self._limit(facts.n_sampled), 1, self.trees
        while first <= self.trees:
            trees = range(first, min(first + width, self.trees + 1))
            yield (top := _Tops.build(rows, facts, d, seed, trees, limit, group_rows, self.table_nodes))
            first, width = top.trees.stop, len(top.trees)

    def _shallow(self, facts: _Facts) -> bool:
        """Whether a whole tree fits the table and takes few passes; small tables are quicker in one task a block."""
        limit = self._limit(facts.n_sampled)
        return limit <= _LEVELS and 2 << limit <= self.table_nodes and facts.n_rows > min(self.group_rows, _LOT)

    def _grow_counted(self, rows: DataFrame, facts: _Facts, d: int, seed: int) -> DataFrame:
        """All nodes of trees that are counted down to their leaves."""
        return _union([top.own_nodes(rows.sparkSession) for top in self._tops(rows, facts, d, seed, 0)])

    # -- a fixed number of rows in each tree -------------------------------------

    def _grow_sampled(self, rows: DataFrame, facts: _Facts, d: int, seed: int) -> tuple[DataFrame, int]:
        psi = min(int(self.max_samples), facts.n_sampled)
        if psi > self.group_rows:
            raise ValueError('a tree of this many rows needs max_samples="all", with a sampled column')
        pool = rows.filter(_flag(seed)).select("key", *[f"x{i}" for i in range(d)])
        members = _deal(pool, facts.n_sampled, psi, self.trees, seed)
        return settle(_grow_nodes(members, d, {seed: self._limit(psi)})), psi


# -- preparing rows ----------------------------------------------------------------


def _flag(seed: int) -> str:
    return f"sampled_{seed}".replace("-", "m")


def _matrix(df: DataFrame, cols: list[str], key: str, sampled: Mapping[int, str | None]) -> DataFrame:
    return df.select(
        F.col(key).alias("key"),
        *[(F.col(column) if column else F.lit(True)).alias(_flag(seed)) for seed, column in sampled.items()],
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
    )


def _spread(rows: DataFrame, n_rows: int) -> DataFrame:
    """A small table may be a single file split; the work per row is worth every core.

    It is also read several times, so it is written out once.
    """
    if n_rows > _FEW:
        return rows
    return settle(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism))


def _narrow(rows: DataFrame, n_rows: int) -> DataFrame:
    """What counting passes read, each of them: no keys, and written once."""
    narrow = rows.drop("key")
    return narrow if n_rows <= _FEW else settle(narrow)


@dataclass(frozen=True)
class _Facts:
    n_rows: int
    n_sampled: int
    low: np.ndarray
    high: np.ndarray


def _facts(rows: DataFrame, d: int, seeds: Sequence[int]) -> dict[int, _Facts]:
    """Size and range of the table for each seed's rows, in one pass; refuses gaps, which no split can place."""
    xs = [F.col(f"x{i}") for i in range(d)]
    gap = F.greatest(*[(x.isNull() | F.isnan(x)).cast("int") for x in xs], F.lit(0))

    def of(seed: int):
        return F.struct(
            F.count_if(_flag(seed)).alias("n"),
            F.array(*[F.min(F.when(F.col(_flag(seed)), x)) for x in xs]).alias("low"),
            F.array(*[F.max(F.when(F.col(_flag(seed)), x)) for x in xs]).alias("high"),
        )

    row = rows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(gap), F.lit(0)).alias("gaps"), F.array(*[of(s) for s in seeds]).alias("runs")
    ).first()
    if row["gaps"]:
        raise ValueError(f"{row['gaps']} rows have missing attribute values; impute them first")
    if not all(run["n"] for run in row["runs"]):
        raise ValueError("no rows to grow trees from")
    return {
        s: _Facts(row["n"], run["n"], np.array(run["low"], float), np.array(run["high"], float))
        for s, run in zip(seeds, row["runs"])
    }


def _share_out(rows: DataFrame, blocks: list[tuple[int, int, int]]) -> DataFrame:
    """One copy of the (few) rows for each block of trees, one block to a partition."""
    lots = F.array(
        *[
            F.struct(
                F.lit(seed).cast("bigint").alias("seed"),
                F.lit(first).alias("first_tree"),
                F.lit(last).alias("last_tree"),
                F.col(_flag(seed)).alias("sampled"),
            )
            for seed, first, last in blocks
        ]
    )
    values = [c for c in rows.columns if not c.startswith("sampled_")]
    return (
        rows.withColumn("lot", F.explode(lots))
        .select("lot.*", F.lit(0).alias("bin"), F.lit(1).cast("bigint").alias("node"), *values)
        .repartitionByRange(len(blocks), *_GROUP)
    )


def _deal(pool: DataFrame, n: int, psi: int, trees: int, seed: int) -> DataFrame:
    """ψ rows for each tree, without replacement inside a tree.

    The rows in hash order are one shuffled deck; it is dealt to ⌊n/ψ⌋ trees, and
    a new deck is shuffled for the next ones.  A large table needs one deck, of
    which only the first trees × ψ rows are ever looked at.
    """
    per_deck = max(1, n // psi)
    decks = []
    for deck, first in enumerate(range(0, trees, per_deck)):
        wanted = min(per_deck, trees - first) * psi
        shuffle = f"{seed}|deck|{deck}"
        chosen = sample_flag(pool, wanted, shuffle, "key", n, "_in").filter("_in").drop("_in")
        order = [hash_text(F.col("key"), shuffle), F.col("key")]
        if wanted <= _FEW:
            dealt = chosen.withColumn("place", F.row_number().over(Window.orderBy(*order)))
        else:
            dealt = global_rank(chosen, order, "place")
        decks.append(dealt.withColumn("first_tree", (F.lit(first + 1) + F.floor((F.col("place") - 1) / psi)).cast("int")))
    return _union(decks).select(
        F.lit(seed).cast("bigint").alias("seed"),
        "first_tree",
        F.col("first_tree").alias("last_tree"),
        F.lit(True).alias("sampled"),
        F.lit(0).alias("bin"),
        F.lit(1).cast("bigint").alias("node"),
        *[c for c in pool.columns if c != "key"],
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _lots_of_tops(tops: Iterable[_Tops], n_rows: int) -> Iterator[list[_Tops]]:
    """Tops of so many trees that their rows, each once a tree, are about ``_ON_THE_WAY``; those of a tree at least."""
    lot, held = [], 0
    for top in tops:
        for part in top.by_trees(max(1, _ON_THE_WAY // n_rows)):
            if lot and held + n_rows * len(part.trees) > _ON_THE_WAY:
                yield lot
                lot, held = [], 0
            lot, held = [*lot, part], held + n_rows * len(part.trees)
    if lot:
        yield lot


def _total(seed: int, cut: int) -> str:
    return f"path_{seed}_{cut}"


def _sums(seeds: Sequence[int], cuts: Sequence[int]) -> list:
    """Path totals of each seed over its first trees, up to each cut."""
    mine = lambda seed, cut: (F.col("seed") == seed) & (F.col("last_tree") <= cut)
    return [F.sum(F.when(mine(s, c), F.col("path")).otherwise(0)).alias(_total(s, c)) for s in seeds for c in cuts]


# -- growing, one group of bounded size at a time ------------------------------------


def _x(batch, d: int) -> np.ndarray:
    return np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch)
                     else batch.column(f"x{i}").to_numpy() for i in range(d)])


def _ranked(table, d: int, trees: int) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """The rows' values for ``isolation.grow``; as places, but for few rows that few trees share, which aren't worth sorting."""
    if trees < 3 and table.num_rows < 1 << 16:
        return _x(table, d), None
    return isolation.ranked(table.column(f"x{i}").to_numpy() for i in range(d))


def _sampled(table):
    flags = table.column("sampled").to_numpy()
    return None if flags.all() else flags.astype(bool)


def _grow_paths(lots: DataFrame, d: int, limits: dict[int, int]) -> DataFrame:
    """(id, seed, last_tree, path): what a row's path adds up to over the trees of its block."""

    def finish(group, table):
        seed, first, last = (part.as_py() for part in group[:3])
        (x, values), node, sampled = _ranked(table, d, last - first + 1), table.column("node").to_numpy(), _sampled(table)
        total = np.zeros(table.num_rows, dtype=np.int64)
        for tree in range(first, last + 1):
            total += isolation.grow(x, node, sampled, seed, tree, limits[seed], values=values)
        tags = {"seed": np.full(table.num_rows, seed, dtype=np.int64), "last_tree": np.full(table.num_rows, last, dtype=np.int32)}
        return pa.table({"id": table.column("id"), **tags, "path": total})

    return lots.groupBy(*_GROUP).applyInArrow(finish, _PATH_FIELDS)


def _grow_nodes(lots: DataFrame, d: int, limits: dict[int, int]) -> DataFrame:
    """The nodes below the starting nodes of each group."""

    def finish(group, table):
        seed, first, last = (part.as_py() for part in group[:3])
        (x, values), node, sampled = _ranked(table, d, last - first + 1), table.column("node").to_numpy(), _sampled(table)
        trees, levels = [], []
        for tree in range(first, last + 1):
            isolation.grow(x, node, sampled, seed, tree, limits[seed], fresh := [], values)
            levels += fresh
            trees += [np.full(len(level[0]), tree, dtype=np.int32) for level in fresh]
        node, depth, feature, threshold, n = (np.concatenate(part) for part in zip(*levels))
        leaf = feature < 0
        return pa.table(
            {
                "tree": np.concatenate(trees),
                "node": node,
                "depth": depth.astype(np.int32),
                "feature": pa.array(feature.astype(np.int32), mask=leaf),
                "threshold": pa.array(threshold, mask=leaf),
                "n": n.astype(np.int64),
            }
        )

    return lots.groupBy(*_GROUP).applyInArrow(finish, _NODE_FIELDS)


# -- nodes too large for one task ------------------------------------------------------


@dataclass
class _Tops:
    """The upper parts of a batch of trees, split by counting passes over the table."""

    seed: int
    trees: range
    inner: dict  # (tree, node) -> (feature, threshold, sampled rows)
    bins: dict  # (tree, node) -> bin; the node's rows fit in one task, or the bin is negative
    finished: dict  # (tree, node) -> sampled rows; large, but cannot be split
    large: bool = False  # whether a bin is too large for a task

    @classmethod
    def build(cls, rows, facts, d, seed, trees, limit, group_rows, table_nodes) -> _Tops:
        """As many of the first ``trees`` as fit a table, one at least; what does not fit of that one is left as large bins."""
        tops = cls(seed, trees, {}, {}, {})
        fits: dict = {}
        pending = {(t, 1): (facts.n_rows, facts.n_sampled, facts.low, facts.high) for t in trees}
        while pending:
            splitting, sizes = {}, {}
            for (tree, node), (size, n, low, high) in pending.items():
                depth = node.bit_length() - 1
                if size <= group_rows:
                    fits[tree, node] = size
                elif depth >= limit or n <= 1 or not (high > low).any():
                    tops.finished[tree, node] = n
                else:
                    splitting[tree, node], sizes[tree, node] = (n, low, high), size
            # a tree has one end more than it has inner nodes
            held = Counter(t for t, _ in [*tops.inner, *splitting])
            while len(tops.trees) > 1 and 2 * sum(held.values()) + len(tops.trees) > table_nodes:
                held.pop(tops.trees[-1], None)
                tops.trees = tops.trees[:-1]
            if tops.trees.stop < trees.stop:
                trees = tops.trees
                for part in (tops.inner, tops.finished, fits, splitting):
                    for key in [key for key in part if key[0] not in trees]:
                        del part[key]
            if 2 * sum(held.values()) + len(trees) > table_nodes:
                fits |= {key: sizes[key] for key in splitting}
                break
            if not splitting:
                break
            for tree in sorted({t for t, _ in splitting}):
                ids = np.array([k for t, k in splitting if t == tree], dtype=np.int64)
                facts_of = [splitting[tree, k] for k in ids.tolist()]
                feature, threshold = isolation.choose_splits(
                    seed, tree, ids, np.stack([f[1] for f in facts_of], 1), np.stack([f[2] for f in facts_of], 1)
                )
                for k, f, v, (n, _, _) in zip(ids.tolist(), feature.tolist(), threshold.tolist(), facts_of):
                    tops.inner[tree, k] = (f, v, n)
            pending = tops._count(rows, d, {(t, 2 * k + side) for t, k in splitting for side in (0, 1)})
        tops._pack(fits, group_rows)
        return tops

    def by_trees(self, width: int) -> Iterator[_Tops]:
        """The same tops, of ``width`` trees at a time."""
        for first in range(self.trees.start, self.trees.stop, width):
            trees = range(first, min(first + width, self.trees.stop))
            inner, bins, finished = ({k: v for k, v in part.items() if k[0] in trees} for part in (self.inner, self.bins, self.finished))
            yield _Tops(self.seed, trees, inner, bins, finished, any(b < 0 for b in bins.values()))

    def _pack(self, fits: dict, group_rows: int) -> None:
        """Put the small nodes of a tree into bins of at most ``group_rows`` rows; larger ones get negative numbers."""
        filled, current, owner = 0, -1, None
        for (tree, node), size in sorted(fits.items()):
            if size > group_rows:
                self.bins[tree, node], self.large = -2, True
                continue
            if tree != owner or filled + size > group_rows:
                current, filled, owner = current + 1, 0, tree
            filled += size
            self.bins[tree, node] = current

    def _table(self, ends) -> dict:
        keys = [*self.inner, *ends]
        return isolation.tree_table(
            [t for t, _ in keys],
            [k for _, k in keys],
            [f for f, _, _ in self.inner.values()] + [-1] * len(ends),
            [v for _, v, _ in self.inner.values()] + [0.0] * len(ends),
        )

    def _count(self, rows: DataFrame, d: int, wanted: set) -> dict:
        """Sizes and ranges of the ``wanted`` nodes: counted per task, merged by Spark."""
        known = {**dict.fromkeys(self.finished), **dict.fromkeys(wanted)}
        for tree, node in list(self.inner):
            for child in (2 * node, 2 * node + 1):
                if (tree, child) not in self.inner:
                    known.setdefault((tree, child))
        table = self._table(list(known))
        asked = np.array([(int(t), int(k)) in wanted for t, k in zip(table["tree"], table["node"])])
        # counted are the asked nodes alone, by their place among them
        # (two bytes, where they do, are sorted digit by digit)
        of_slot = np.where(asked, np.cumsum(asked) - 1, -1).astype(np.int16 if asked.sum() < 1 << 15 else np.int32)
        names = table["tree"][asked].astype(np.int32), table["node"][asked]
        shared = rows.sparkSession.sparkContext.broadcast((table, of_slot, names))
        trees, flag = self.trees, _flag(self.seed)

        def count(batches):
            table, of_slot, (tree_of, node_of) = shared.value
            held = len(node_of)
            size, n = np.zeros(held, dtype=np.int64), np.zeros(held, dtype=np.int64)
            low, high = np.full((d, held), np.inf), np.full((d, held), -np.inf)
            for batch in batches:
                x, sampled = _x(batch, d), batch.column(flag).to_numpy(zero_copy_only=False).astype(bool)
                sampled = None if sampled.all() else sampled
                for tree in trees:
                    place = of_slot[isolation.walk(table, x, tree)]
                    here = np.flatnonzero(place >= 0)
                    if not here.size:
                        continue
                    order = here[np.argsort(place[here], kind="stable")]
                    starts, spans = isolation.runs(place[order])
                    size[place[order][starts]] += spans
                    if sampled is not None:
                        order = order[sampled[order]]
                        if not order.size:
                            continue
                        starts, spans = isolation.runs(place[order])
                    at, part = place[order][starts], np.take(x, order, axis=1)
                    n[at] += spans
                    low[:, at] = np.minimum(low[:, at], np.minimum.reduceat(part, starts, axis=1))
                    high[:, at] = np.maximum(high[:, at], np.maximum.reduceat(part, starts, axis=1))
            met = np.flatnonzero(size)
            columns = {"tree": tree_of[met], "node": node_of[met], "size": size[met], "n": n[met]}
            columns |= {f"l{i}": low[i, met] for i in range(d)} | {f"h{i}": high[i, met] for i in range(d)}
            yield pa.RecordBatch.from_pydict(columns)

        ranges = [f"l{i}" for i in range(d)] + [f"h{i}" for i in range(d)]
        fields = "tree int, node bigint, size bigint, n bigint, " + ", ".join(f"{c} double" for c in ranges)
        merged = (
            rows.mapInArrow(count, fields)
            .groupBy("tree", "node")
            .agg(
                F.sum("size").alias("size"),
                F.sum("n").alias("n"),
                F.array(*[F.min(f"l{i}") for i in range(d)]).alias("low"),
                F.array(*[F.max(f"h{i}") for i in range(d)]).alias("high"),
            )
            .collect()  # at most two children for each node above group_rows
        )
        return {(r["tree"], r["node"]): (r["size"], r["n"], np.array(r["low"]), np.array(r["high"])) for r in merged}

    def rows_by_bin(self, rows: DataFrame, d: int) -> DataFrame:
        """Each row once per tree, at the node where the counting passes left it."""
        table = self._table([*self.bins, *self.finished])
        bins = np.array([self.bins.get((int(t), int(k)), -1) for t, k in zip(table["tree"], table["node"])], dtype=np.int32)
        binned = bins != -1
        shared = rows.sparkSession.sparkContext.broadcast((table, bins, binned))
        seed, trees, flag = self.seed, self.trees, _flag(self.seed)
        values = ["id", *[f"x{i}" for i in range(d)]] if "id" in rows.columns else [f"x{i}" for i in range(d)]
        rows = rows.select(F.col(flag).alias("sampled"), *values)

        def place(batches):
            table, bins, binned = shared.value
            for batch in batches:
                x = _x(batch, d)
                for tree in trees:
                    slot = isolation.walk(table, x, tree)
                    here = np.flatnonzero(binned[slot])
                    if here.size:
                        part = batch.take(pa.array(here))
                        own = np.full(here.size, tree, dtype=np.int32)
                        lead = [np.full(here.size, seed, dtype=np.int64), own, own, bins[slot[here]], table["node"][slot[here]]]
                        names = ["seed", "first_tree", "last_tree", "bin", "node", *part.schema.names]
                        yield pa.RecordBatch.from_arrays([pa.array(a) for a in lead] + part.columns, names)

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(place, f"seed bigint, first_tree int, last_tree int, bin int, node bigint, {kinds}")

    def finished_paths(self, rows: DataFrame, d: int) -> DataFrame:
        """(id, seed, last_tree, path) of rows in large nodes that cannot be split; nothing is exchanged."""
        table = self._table([*self.bins, *self.finished])
        n = np.array([self.finished.get((int(t), int(k)), -1) for t, k in zip(table["tree"], table["node"])], dtype=np.int64)
        paths = np.where(n < 0, -1, isolation.leaf_path(isolation.depth_of(table["node"]), np.maximum(n, 0)))
        shared = rows.sparkSession.sparkContext.broadcast((table, paths))
        seed, trees = self.seed, self.trees

        def walk(batches):
            table, paths = shared.value
            for batch in batches:
                x = _x(batch, d)
                for tree in trees:
                    path = paths[isolation.walk(table, x, tree)]
                    here = np.flatnonzero(path >= 0)
                    if here.size:
                        tags = [np.full(here.size, seed, dtype=np.int64), np.full(here.size, tree, dtype=np.int32), path[here]]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("id").take(pa.array(here)), *[pa.array(t) for t in tags]], ["id", "seed", "last_tree", "path"]
                        )

        return rows.mapInArrow(walk, _PATH_FIELDS)

    def own_nodes(self, spark) -> DataFrame:
        """The nodes decided here: split ones, and large leaves."""
        nodes = [(t, k, k.bit_length() - 1, f, v, n) for (t, k), (f, v, n) in self.inner.items()]
        nodes += [(t, k, k.bit_length() - 1, None, None, n) for (t, k), n in self.finished.items()]
        return spark.createDataFrame(nodes, _NODE_FIELDS)


# -- nodes whose splits do not fit the driver's table ----------------------------------


_PLACE = ("seed", "first_tree", "last_tree", "bin", "node")


def _split_in_frame(lots: DataFrame, d: int, limit: int, group_rows: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Rows at nodes of any size, split until each node fits ``group_rows``; see ``IsolationForest._groups``.

    A level is one aggregate of sizes and ranges per node and one join of the rows with
    their node's split.  Splits are a table, of which the driver sees nothing but whether
    it is empty; a node that holds many rows is a hot key of a join that run-time
    re-planning splits.
    """
    values = [c for c in lots.columns if c not in (*_PLACE, "sampled")]
    xs = [f"x{i}" for i in range(d)]
    when_sampled = lambda x: F.when(F.col("sampled"), F.col(x))
    state, level = lots, 0
    groups, ended, nodes = [], [], []
    while True:
        facts = state.groupBy(*_PLACE).agg(
            F.count(F.lit(1)).alias("size"),
            F.count_if("sampled").alias("n"),
            F.array(*[F.coalesce(F.min(when_sampled(x)), F.lit(np.inf)) for x in xs]).alias("low"),
            F.array(*[F.coalesce(F.max(when_sampled(x)), F.lit(-np.inf)) for x in xs]).alias("high"),
        )
        decided = settle(_decide(facts, d, limit, group_rows))
        small = F.col("size") > F.lit(group_rows // 2)
        # Small nodes of a bin share groups: each of at most half ``group_rows`` or one node alone.
        order = Window.partitionBy("seed", "first_tree", "bin", small).orderBy("node")
        filled = F.floor((F.sum("size").over(order) - F.col("size")) / F.lit(max(1, group_rows // 2)))
        name = F.concat_ws("-", F.lit(level), "bin", F.when(small, F.concat(F.lit("n"), F.col("node"))).otherwise(filled.cast("string")))
        fits = decided.filter("kind = 'fits'").withColumn("group", name).select(*_PLACE, "group")
        groups.append(state.join(fits, list(_PLACE)).select("seed", "first_tree", "last_tree", F.col("group").alias("bin"), "node", "sampled", *values))
        ends = decided.filter("kind = 'ends'")
        if "id" in values:
            ended.append(state.join(ends.select(*_PLACE, "path"), list(_PLACE)).select("id", "seed", "last_tree", "path"))
        tree = F.col("first_tree").alias("tree")
        nodes.append(decided.filter("kind <> 'fits'").select(tree, "node", "depth", "feature", "threshold", "n"))
        splits = decided.filter("kind = 'splits'")
        if splits.isEmpty():
            return _union(groups), ended, nodes
        value = F.element_at(F.array(*xs), F.col("feature") + 1)
        child = (F.col("node") * 2 + (value > F.col("threshold")).cast("bigint")).alias("node")
        moved = state.join(splits.select(*_PLACE, "feature", "threshold"), list(_PLACE))
        state = settle(moved.select("seed", "first_tree", "last_tree", "bin", child, "sampled", *values))
        level += 1


def _decide(facts: DataFrame, d: int, limit: int, group_rows: int) -> DataFrame:
    """Whether a node fits a group, ends (and with which path), or splits (and how)."""

    def run(batches):
        for batch in batches:
            seed, tree, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "first_tree", "node"))
            size, n = batch.column("size").to_numpy(), batch.column("n").to_numpy()
            low, high = (batch.column(c).flatten().to_numpy().reshape(-1, d).T for c in ("low", "high"))
            depth = isolation.depth_of(node)
            fits = size <= group_rows
            splits = ~fits & (depth < limit) & (n > 1) & (high > low).any(axis=0)
            feature, threshold = np.full(len(node), -1), np.zeros(len(node))
            for s, t in sorted(set(zip(seed[splits].tolist(), tree[splits].tolist()))):
                at = np.flatnonzero(splits & (seed == s) & (tree == t))
                feature[at], threshold[at] = isolation.choose_splits(s, t, node[at], low[:, at], high[:, at])
            columns = {c: batch.column(c) for c in (*_PLACE, "size", "n")}
            columns |= {
                "kind": pa.array(np.where(fits, "fits", np.where(splits, "splits", "ends")).tolist(), pa.string()),
                "depth": pa.array(depth.astype(np.int32)),
                "feature": pa.array(feature.astype(np.int32), mask=~splits),
                "threshold": pa.array(threshold, mask=~splits),
                "path": pa.array(isolation.leaf_path(depth, n)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    fields = "seed bigint, first_tree int, last_tree int, bin int, node bigint, size bigint, n bigint"
    return facts.mapInArrow(run, f"{fields}, kind string, depth int, feature int, threshold double, path bigint")


# -- scoring ---------------------------------------------------------------------------


def _scores(
    totals: DataFrame, key: str, names: Mapping[tuple[int, int], str], psi: Mapping[int, int], others: Sequence = ()
) -> DataFrame:
    """Score and decision columns, and ``others``; ``names`` gives the suffix of each (seed, size)."""
    out = [F.col("key").alias(key)]
    for (seed, size), suffix in names.items():
        norm = float(isolation.average_path(psi[seed])) or 1.0
        mean = F.col(_total(seed, size)) / F.lit(float(size) * isolation.PATH_UNIT)
        score = F.pow(F.lit(2.0), -mean / F.lit(norm))
        out += [score.alias(f"score{suffix}"), (F.lit(0.5) - score).alias(f"decision{suffix}")]
    return totals.select(*out, *others)


def score(
    df: DataFrame, cols: Sequence[str], nodes: DataFrame, psi: int, key: str = "row_key", table_nodes: int = TABLE_NODES
) -> DataFrame:
    """Score rows against a stored node table grown from ``psi`` rows per tree; refuses gaps, as growing does."""
    trees = nodes.agg(F.max("tree")).first()[0]
    rows = _matrix(df, list(cols), key, {})
    gaps = rows.filter(F.greatest(*[(F.col(f"x{i}").isNull() | F.isnan(f"x{i}")).cast("int") for i in range(len(cols))], F.lit(0)) > 0).count()
    if gaps:
        raise ValueError(f"{gaps} rows have missing attribute values; impute them first")
    totals = _walk(rows, nodes, len(cols), {trees: (_total(0, trees), True)}, [], table_nodes)
    return _scores(totals, key, {(0, trees): ""}, {0: psi})


def _walk(
    rows: DataFrame, nodes: DataFrame, d: int, plan: Mapping[int, tuple[str, bool]], keep: Sequence[str], table_nodes: int
) -> DataFrame:
    """``key``, ``keep`` and path totals: rows go through the trees in order, with their total so far.

    ``plan`` says after which trees the total becomes a column, and whether it starts anew
    there.  Whole trees go to the rows in batches of at most ``table_nodes`` nodes, a pass
    each; nothing is exchanged.  Of trees above that the tops go to the rows, and what is
    below meets them in an exchange, for all such trees in a row at once.
    """
    sizes = [(r["tree"], r["n"]) for r in nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).orderBy("tree").collect()]
    batches: list[tuple[list[int], int]] = []  # one row a tree was collected
    for tree, n in sizes:
        last, held = batches[-1] if batches else ([], 0)
        # large trees go on together up to where a total is wanted
        together = held > table_nodes and n > table_nodes and last[-1] not in plan and len(last) < table_nodes
        if last and (held + n <= table_nodes or together):
            batches[-1] = [*last, tree], held + n
        else:
            batches.append(([tree], n))
    state = rows.select("key", *keep, *[f"x{i}" for i in range(d)], F.lit(0).cast("bigint").alias("_total"))
    for k, (trees, n) in enumerate(batches):
        some = nodes.filter(F.col("tree").between(trees[0], trees[-1]))
        mine = {t: plan[t] for t in trees if t in plan}
        state = _walk_shared(state, some, d, mine) if n <= table_nodes else _walk_parts(state, some, d, mine, table_nodes)
        if k + 1 < len(batches):
            state = settle(state)
    return state.select("key", *keep, *[name for name, _ in plan.values()])


def _walk_shared(state: DataFrame, nodes: DataFrame, d: int, plan: Mapping[int, tuple[str, bool]]) -> DataFrame:
    small = nodes.toPandas()  # at most ``table_nodes`` rows, checked by the caller
    table = isolation.tree_table(small["tree"], small["node"], small["feature"].fillna(-1), small["threshold"].fillna(0.0))
    paths = isolation.leaf_path(small["depth"].to_numpy(), small["n"].to_numpy())[table["order"]]
    shared = state.sparkSession.sparkContext.broadcast((table, paths))

    def walk(batches):
        table, paths = shared.value
        for batch in batches:
            x, total, columns = _x(batch, d), batch.column("_total").to_numpy(), {}
            for tree in table["roots"]:
                total = total + paths[isolation.walk(table, x, tree)]
                if tree in plan:
                    name, anew = plan[tree]
                    columns[name] = total
                    total = np.zeros_like(total) if anew else total
            carried = {c: batch.column(c) for c in batch.schema.names if c != "_total"}
            yield pa.RecordBatch.from_pydict({**carried, "_total": total, **columns})

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema if f.name != "_total"]
    return state.mapInArrow(walk, ", ".join([*kinds, "_total bigint", *[f"`{name}` bigint" for name, _ in plan.values()]]))


def _walk_parts(state: DataFrame, nodes: DataFrame, d: int, plan: Mapping[int, tuple[str, bool]], table_nodes: int) -> DataFrame:
    """Trees above ``table_nodes`` nodes, together: their tops go to every task, the subtrees below meet their rows once.

    Subtrees are dealt into lots of about ``table_nodes`` nodes.  A lot that very many rows
    reach is worked on by several tasks.  A subtree that alone is larger than half of that is
    entered by joins, a level at a time, until its parts are small.
    """
    xs = [f"x{i}" for i in range(d)]
    nodes = settle(nodes.select("tree", "node", "depth", "feature", "threshold", "n"))
    top = held = 0
    for r in nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).orderBy("depth").collect():  # a row a level
        held += r["n"]
        if held > table_nodes:
            break
        top = r["depth"]
    state = settle(_enter_tops(state.withColumn("_id", F.monotonically_increasing_id()), nodes.filter(F.col("depth") <= top), d))
    at = state.select("_id", *xs, F.inline("_at"))
    below = nodes.filter(F.col("depth") >= top).withColumn("root", F.expr(f"shiftright(node, depth - {top})"))
    by, paths, small = ["tree", "root"], [], table_nodes // 2
    while True:
        sizes = settle(below.groupBy(*by).agg(F.count(F.lit(1)).alias("held")))
        total, most = sizes.agg(F.sum(F.when(F.col("held") <= small, F.col("held"))), F.max("held")).first()
        if total:
            fits = sizes.filter(F.col("held") <= small).select(*by)
            paths.append(_meet(at.join(fits, by) if most > small else at, below.join(fits, by), d, max(1, ceil(total / max(1, small)))))
        if not most or most <= small:
            break
        below = below.join(sizes.filter(F.col("held") > small).select(*by), by)
        entry = below.filter(F.col("node") == F.col("root")).select(*by, "feature", "threshold", "depth", "n")
        value = F.element_at(F.array(*xs), F.col("feature") + 1)
        child = (F.col("root") * 2 + (value > F.col("threshold")).cast("bigint")).alias("root")
        at = settle(at.join(entry, by).select("_id", *xs, "tree", child))
        top += 1
        below = settle(below.filter(F.col("depth") >= top).withColumn("root", F.expr(f"shiftright(node, depth - {top})")))
    out = state.drop("_at")
    if paths:
        sums = _union(paths).groupBy("_id").agg(F.sum("path").alias("_path"))
        out = out.join(sums, "_id", "left").withColumn("_total", F.col("_total") + F.coalesce("_path", F.lit(0))).drop("_path")
    out = out.drop("_id")
    for name, anew in plan.values():
        out = out.withColumn(name, F.col("_total")).withColumn("_total", F.lit(0).cast("bigint") if anew else F.col("_total"))
    return out


def _node_arrays(nodes) -> tuple[dict, np.ndarray]:
    """The table to walk, and the path at each of its slots; from a table of nodes in Arrow."""
    tree, node, depth, n = (nodes.column(c).to_numpy() for c in ("tree", "node", "depth", "n"))
    feature, threshold = nodes.column("feature").fill_null(-1).to_numpy(), nodes.column("threshold").fill_null(0.0).to_numpy()
    table = isolation.tree_table(tree, node, feature, threshold)
    return table, isolation.leaf_path(depth, n)[table["order"]]


def _enter_tops(state: DataFrame, nodes: DataFrame, d: int) -> DataFrame:
    """``state`` with the paths of trees that end in their tops added, and ``_at``: the nodes (tree, root) where the others stand."""
    shared = state.sparkSession.sparkContext.broadcast(_node_arrays(nodes.toArrow()))

    def walk(batches):
        table, paths = shared.value
        for batch in batches:
            x, total = _x(batch, d), batch.column("_total").to_numpy()
            slots = np.stack([isolation.walk(table, x, tree) for tree in table["roots"]], axis=1)
            ends = table["feature"][slots] < 0
            total = total + np.where(ends, paths[slots], 0).sum(axis=1)
            on = slots[~ends]
            offsets = np.append(0, np.cumsum((~ends).sum(axis=1))).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(table["tree"][on].astype(np.int32)), pa.array(table["node"][on])], ["tree", "root"])
            carried = {c: batch.column(c) for c in batch.schema.names if c != "_total"}
            yield pa.RecordBatch.from_pydict({**carried, "_total": total, "_at": pa.ListArray.from_arrays(pa.array(offsets), entries)})

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema if f.name != "_total"]
    return state.mapInArrow(walk, ", ".join([*kinds, "_total bigint", "_at array<struct<tree: int, root: bigint>>"]))


def _meet(at: DataFrame, below: DataFrame, d: int, lots: int) -> DataFrame:
    """(_id, path) of rows that stand at the roots of subtrees, each subtree in one of ``lots``."""
    lot = F.pmod(F.xxhash64("tree", "root"), F.lit(lots)).alias("lot")
    at = at.select("*", lot)
    crowds = at.groupBy("lot").agg(F.ceil(F.count(F.lit(1)) / F.lit(_LOT)).alias("shares"))
    crowds = F.broadcast(settle(crowds))  # a row a lot
    share = F.pmod(F.xxhash64("_id"), F.col("shares")).alias("share")
    rows = at.join(crowds, "lot").select("_id", "tree", "root", "lot", share, *[f"x{i}" for i in range(d)])
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share")
    parts = below.select("*", lot).join(crowds, "lot").select("lot", each, "tree", "node", "depth", "feature", "threshold", "n")

    def finish(rows, nodes):
        if not rows.num_rows:
            return pa.table({"_id": rows.column("_id"), "path": pa.array([], pa.int64())})
        table, paths = _node_arrays(nodes)
        start = isolation.slots_of(table["tree"], table["node"], rows.column("tree").to_numpy(), rows.column("root").to_numpy())
        return pa.table({"_id": rows.column("_id"), "path": paths[isolation.descend(table, _x(rows, d), start)]})

    return rows.groupBy("lot", "share").cogroup(parts.groupBy("lot", "share")).applyInArrow(finish, "_id bigint, path bigint")


# Closures above refer to helpers of this module; tasks get them by value.
import sys  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])

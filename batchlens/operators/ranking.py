"""Total orders over large tables without ever sorting in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.functions import hash_text
from batchlens.operators.quantiles import order_statistics, sent_if_few
from batchlens.sources.shared import settle, stored

_IN_SLICE = 33  # bits monotonically_increasing_id keeps for the place inside a partition
_SMALL = 1000  # rows of a hash bucket that may be looked at one by one


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank", keep: Sequence[str] | None = None) -> DataFrame:
    """Number all rows 1, 2, … in the given order, which must break every tie.

    One range exchange sorts the rows into slices; a row's place inside its slice
    plus the sizes of the slices before it is its rank.  Only slice sizes meet on
    the driver.  The places are written once, since a second computation could
    cut the slices elsewhere.  Without ``keep``, all columns are written with them.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = stored(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)], F.monotonically_increasing_id().alias("_place"))
    )
    slice_id = F.shiftright("_place", _IN_SLICE)
    sizes = placed.groupBy(slice_id.alias("_slice")).agg(F.count(F.lit(1)).alias("n")).orderBy("_slice").collect()
    before = [0, *accumulate(r["n"] for r in sizes)]
    offsets = df.sparkSession.createDataFrame(
        [(r["_slice"], before[i]) for i, r in enumerate(sizes)], "_slice bigint, _before bigint"
    )
    inside = F.col("_place").bitwiseAND(F.lit((1 << _IN_SLICE) - 1))
    return (
        placed.withColumn("_slice", slice_id)
        .join(F.broadcast(offsets), "_slice")  # one row per slice of the exchange
        .withColumn(name, F.col("_before") + inside + F.lit(1))
        .drop("_slice", "_before", "_place")
    )


def sample_flags(df: DataFrame, size: int, seeds: Mapping[str, int | str], key: str, n_rows: int) -> DataFrame:
    """One boolean column per entry of ``seeds``: exactly ``size`` rows, those whose hash of (key, seed) is smallest.

    Counting rows per hash prefix finds the bucket in which the last chosen row
    lies; lengthening the prefix shrinks that bucket until it can be looked at.
    No row is moved: the result is more columns on the same partitions.  Rows that
    share a key are told apart by a hash of all their columns, so the same rows are
    chosen however they are distributed; rows that are equal in all columns are
    numbered where they lie, and as many of them are taken as are wanted.
    """
    if size >= n_rows or size <= 0:
        return df.withColumns({name: F.lit(size > 0) for name in seeds})
    names, columns = list(seeds), [F.col(f"`{c}`") for c in df.columns]
    digest = {name: hash_text(F.col(key), seeds[name]) for name in names}
    # 32 digits more, of the whole row; looked at only where rows share a key
    whole = {name: F.concat(digest[name], hash_text(F.to_json(F.struct(*columns)), seeds[name])) for name in names}
    prefix, wanted, bucket = dict.fromkeys(names, ""), dict.fromkeys(names, size), dict.fromkeys(names, n_rows)

    def within_buckets(of: list[str], full: bool = False) -> DataFrame:
        """(name, hash) of the rows in the current bucket of each of these seeds."""
        hashes = [F.struct(F.lit(n).alias("s"), F.lit(prefix[n]).alias("p"), (whole if full or len(prefix[n]) >= 32 else digest)[n].alias("h")) for n in of]
        return df.select(F.explode(F.array(*hashes)).alias("v")).select("v.*").filter(F.col("h").startswith(F.col("p")))

    while deep := [n for n in names if bucket[n] > _SMALL and len(prefix[n]) < 64]:
        done = len(prefix[deep[0]])  # all open prefixes have the same length
        width = min(3, 32 - done % 32, max(1, ceil(log(max(bucket[n] for n in deep) / (_SMALL / 4), 16))))
        counts = (
            within_buckets(deep)
            .groupBy("s", F.substring("h", done + 1, width).alias("part"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy("s", "part")
            .collect()  # at most 16^3 rows per seed, whatever the table
        )
        settled: set[str] = set()
        for row in counts:
            name = row["s"]
            if name in settled:
                continue
            if wanted[name] <= row["n"]:
                prefix[name], bucket[name] = prefix[name] + row["part"], row["n"]
                settled.add(name)
            else:
                wanted[name] -= row["n"]
    # equal rows of a bucket are one row with a count, so what is collected stays small
    last: dict[str, tuple[str, int, int]] = {}
    for row in within_buckets(names, full=True).groupBy("s", "h").agg(F.count(F.lit(1)).alias("n")).orderBy("s", "h").collect():
        if row["s"] not in last:
            if wanted[row["s"]] <= row["n"]:
                last[row["s"]] = row["h"], wanted[row["s"]], row["n"]
            wanted[row["s"]] -= row["n"]
    tied = [n for n in names if last[n][1] < last[n][2]]
    numbered = settle(df.withColumn("_row", F.monotonically_increasing_id().cast("double"))) if tied else df
    chosen = {}
    for n in names:
        h, take, of = last[n]
        here = (digest[n] == h[:32]) & (whole[n] == h)
        if n in tied:
            lot = numbered.filter(here)
            _, at = order_statistics(lot, lambda _, k=take: {k - 1}, ["_row"], [take / of])
            here = here & (F.col("_row") <= F.lit(at["_row", take - 1]))
        chosen[n] = (digest[n] < h[:32]) | ((digest[n] == h[:32]) & (whole[n] < h)) | here
    return numbered.withColumns(chosen).drop("_row")


def sample_flag(df: DataFrame, size: int, seed: int | str, key: str, n_rows: int, name: str = "in_sample") -> DataFrame:
    """``sample_flags`` for one seed."""
    return sample_flags(df, size, {name: seed}, key, n_rows)


def exact_sample(df: DataFrame, frac: float, seed: int | str, key: str) -> DataFrame:
    """A sample without replacement of exactly ``round(frac * n)`` rows."""
    n = df.count()
    return sample_flag(df, round(frac * n), seed, key, n, "_chosen").filter("_chosen").drop("_chosen")


def top_code(df: DataFrame, col: str, name: str = "batch_count") -> DataFrame:
    """The most frequent value of ``col`` with its count; nulls never win, ties go to the smaller value."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(F.desc(name), col)
        .limit(1)
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(col)


def category_code(df: DataFrame, col: str, key: str, name: str = "code") -> DataFrame:
    """Integer code per category, 0 for the one met first in ``key`` order."""
    first = df.groupBy(col).agg(F.min(key).alias("_first"))
    codes = global_rank(first, ["_first"], "_rank").select(
        F.col(col).alias("_value"), (F.col("_rank") - 1).cast("int").alias(name)
    )
    return df.join(sent_if_few(codes), F.col(col).eqNullSafe(F.col("_value")), "left").drop("_value")

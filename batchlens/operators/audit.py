"""Checks that report problems as rows instead of printing them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchlens.functions import DECIMAL, hash_text, parse_decimal
from batchlens.operators.quantiles import sent_if_few
from batchlens.operators.ranking import global_rank
from batchlens.sources.shared import lot_of, lots_for, settle, shuffles_removed, stored, stored_in_lots

_CROWD = 1 << 17  # rows of one key that one task numbers


def audit_types(raw: DataFrame, cols: Sequence[str], kind: str = DECIMAL) -> DataFrame:
    """Values that are there but are no decimal of type ``kind``: how many per attribute, and the three smallest.

    Bad values are counted per (attribute, value) first, so a value repeated a
    billion times is one row by the time examples are chosen, and a rank limit
    lets each task keep three rows per attribute before anything is exchanged.
    """
    text = [F.col(f"`{c}`").cast("string").alias(c) for c in cols]
    bad = (
        raw.select(*text)
        .unpivot([], list(cols), "attribute", "raw")
        .filter(F.col("raw").isNotNull() & (F.trim("raw") != "") & parse_decimal(F.col("raw"), kind).isNull())
    )
    tallied = bad.groupBy("attribute", "raw").agg(F.count(F.lit(1)).alias("n"))
    totals = tallied.groupBy("attribute").agg(F.sum("n").alias("n_bad"))
    examples = (
        tallied.withColumn("place", F.row_number().over(Window.partitionBy("attribute").orderBy("raw")))
        .filter("place <= 3")
        .groupBy("attribute")
        .agg(F.concat_ws(", ", F.array_sort(F.collect_list("raw"))).alias("examples"))
    )
    return totals.join(examples, "attribute").orderBy("attribute")


def refuse_bad_values(raw: DataFrame, cols: Sequence[str], kind: str = DECIMAL) -> None:
    """An error that names the attributes with values that are no decimal of type ``kind``, and how many they are.

    Making such values null would have them filled in with a median later on.
    """
    bad = audit_types(raw, cols, kind).collect()  # one row per attribute
    if bad:
        said = "; ".join(f"{r['attribute']}: {r['n_bad']} ({r['examples']})" for r in bad)
        raise ValueError(f"values that are no {kind}: {said}")


def audit_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns that still hold nulls, with how many."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "attribute", "n_null").filter("n_null > 0").orderBy("attribute")


def audit_alignment(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Do two tables hold the same rows, by key?  Counts of keys only in one of them.

    Keys are counted on each side before they meet, so repeats weigh nothing in
    the exchange; an id missing on both sides is the same id.
    """
    def tally(df: DataFrame, side: int) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))

    balance = (
        tally(a, 1)
        .unionByName(tally(b, -1))
        .groupBy(*keys)
        .agg(F.sum(F.col("n") * F.col("side")).alias("surplus"))
    )
    return balance.agg(
        F.coalesce(F.sum(F.greatest("surplus", F.lit(0))), F.lit(0)).cast("bigint").alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("surplus"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_right"),
    ).withColumn("aligned", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def row_digests(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A hash of the row's identifiers as text, for comparing tables kept apart."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return df.select(*keys, hash_text(*parts).alias("row_digest"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` as it is; refuses a table in which keys repeat, and says how many do.

    Joins by row key multiply rows if a key stands for several of them.  Hashes of the
    keys are counted first; the keys themselves are looked at if a hash repeats.
    """
    with shuffles_removed(df.sparkSession):
        hashes = df.groupBy(F.xxhash64(*keys).alias("_hash")).agg(F.count(F.lit(1)).alias("n"))
        if hashes.agg(F.max("n")).first()[0] in (None, 1):
            return df
        row = duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).first()
    if row["keys"]:
        raise ValueError(f"{row['keys']} keys of {', '.join(keys)} stand for {row['rows']} rows; make them unique first (with_row_key)")
    return df


def with_row_key(df: DataFrame, keys: Sequence[str], name: str = "row_key") -> DataFrame:
    """``name``: the source keys as text, null as empty, with an ordinal where several rows share them.

    The ordinal counts rows of one key by a hash of all their columns.  Rows meet those of
    the same key in one exchange, a large table's in lots.  Rows of keys that very many share
    are ranked in ranges of (key, hash) instead, so a key of a third of the table is ranked by many tasks.
    """
    text = F.concat_ws("-", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys])
    keyed = df.withColumn("_key", text)
    content = hash_text(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    out = [F.col("_ordinal").alias(name), *[F.col(f"`{c}`") for c in df.columns if c != name]]
    with shuffles_removed(df.sparkSession):
        sizes = keyed.groupBy(F.xxhash64("_key").alias("_hash")).agg(F.count(F.lit(1)).alias("n"))
        facts = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    few, parts = keyed, []
    if (facts["most"] or 0) > _CROWD:
        with shuffles_removed(df.sparkSession):
            crowds = sent_if_few(settle(sizes.filter(F.col("n") > _CROWD).select("_hash")))
            few = keyed.join(crowds, F.xxhash64("_key") == F.col("_hash"), "left_anti")
            crowded = keyed.join(crowds, F.xxhash64("_key") == F.col("_hash"), "left_semi")
            crowded = stored(crowded.withColumns({"_content": content, "_nth": F.monotonically_increasing_id()}))
            ranked = global_rank(crowded, ["_key", "_content", "_nth"], "_rank")
        first = ranked.groupBy("_key").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
        place = (F.col("_rank") - F.col("_first") + 1).cast("string")
        parts = [ranked.join(first, "_key").withColumn("_ordinal", _ordinal(place)).select(*out)]
    lots, same = lots_for(facts["rows"] or 0), Window.partitionBy("_key")

    def numbered(lot: int) -> DataFrame:
        some = few.filter(lot_of(lots, lot, ["_key"])).withColumn("_n", F.count(F.lit(1)).over(same))
        some = some.withColumn("_content", F.when(F.col("_n") > 1, content))
        place = F.row_number().over(same.orderBy("_content")).cast("string")
        return some.withColumn("_place", place).withColumn("_ordinal", _ordinal(F.col("_place"))).select(*out)

    return reduce(DataFrame.unionByName, parts, stored_in_lots(df.sparkSession, lots, numbered))


def _ordinal(place: Column) -> Column:
    return F.when(F.col("_n") > 1, F.concat_ws("#", "_key", place)).otherwise(F.col("_key"))

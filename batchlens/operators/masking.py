"""Replace identifiers and attribute names by running codes, reversibly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.operators.audit import require_unique
from batchlens.operators.ranking import global_rank
from batchlens.operators.roles import Roles
from batchlens.sources.shared import discard, lot_of, lots_for, stored_in_lots
from batchlens.sources.shared import stored as written

# Code prefixes, in the order of the four identifier columns.
ID_PREFIXES = {
    "material_code": "M",
    "component_code": "C",
    "material_batch_nr": "MB",
    "component_batch_nr": "CB",
}
_FEW_CODES = 50_000  # codes of a column that are sent to every task


def _long_codes(
    df: DataFrame, prefixes: Mapping[str, str], order_by: str | None, stored: Mapping[str, DataFrame] | None, n_rows: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(col, original, masked) of all columns: what is stored, and codes of the values that are new; and the table these are read from.

    On the way columns go by number: a name on every value would be most of what is exchanged.
    """
    names = list(prefixes)
    entries = F.array(
        *[
            F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("original")))
            for i, c in enumerate(names)
        ]
    )
    place = {"_place": F.col(f"`{order_by}`")} if order_by else {}
    kept = [c.alias(name) for name, c in place.items()]
    values = df.select(F.explode(entries).alias("e"), *kept).filter("e is not null").select("e.*", *place)
    lots, order = lots_for(n_rows), ["col", "_first", "original"] if order_by else ["col", "original"]
    old, last = [], {}
    for i, c in enumerate(names):
        if stored and c in stored:
            old.append(require_unique(stored[c], ["original"]).select(F.lit(i).alias("col"), "original", "masked"))
    if old:
        known = reduce(DataFrame.unionByName, old)
        number = F.regexp_extract("masked", r"(\d+)$", 1).try_cast("bigint")
        last = {r["col"]: r["last"] or 0 for r in known.groupBy("col").agg(F.max(number).alias("last")).collect()}

    def distinct(lot: int) -> DataFrame:
        some = values.filter(lot_of(lots, lot, ["original"]))
        some = some.groupBy("col", "original").agg(F.min("_place").alias("_first")) if order_by else some.distinct()
        return some.join(known.filter(lot_of(lots, lot, ["original"])), ["col", "original"], "left_anti") if old else some

    fresh = stored_in_lots(df.sparkSession, lots, distinct)  # ranges are sampled, which reads the values once more
    ranked = global_rank(fresh, order, "_n", keep=["col", "original"])
    discard(fresh)
    before = {r["col"]: r["first"] - 1 for r in ranked.groupBy("col").agg(F.min("_n").alias("first")).collect()}
    start = F.create_map(*[F.lit(x) for i in range(len(names)) for x in (i, last.get(i, 0) - before.get(i, 0))])
    prefix = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (i, prefixes[c])])
    code = F.concat(prefix[F.col("col")], (F.col("_n") + start[F.col("col")]).cast("string"))
    new = ranked.select("col", "original", code.alias("masked"))
    codes = known.unionByName(new) if old else new
    return codes.withColumn("col", F.element_at(F.array(*map(F.lit, names)), F.col("col") + 1)), ranked


def build_mappings(
    df: DataFrame, prefixes: Mapping[str, str], order_by: str | None = None, stored: Mapping[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """``original`` → ``masked`` for each distinct value of each column: M1, M2, …

    Numbered by value, or by first appearance along the column ``order_by``.
    Nulls get no code.  All columns are collected in one pass and ranked in one
    total order; a column's codes start where the column starts in it.  Values that
    ``stored`` mappings hold keep their codes; new ones are numbered behind the last.
    """
    codes, _ = _long_codes(df, prefixes, order_by, stored)
    return {c: codes.filter(F.col("col") == c).select("original", "masked") for c in prefixes}


def build_mapping(df: DataFrame, col: str, prefix: str, order_by: str | None = None) -> DataFrame:
    """``build_mappings`` for one column."""
    return build_mappings(df, {col: prefix}, order_by)[col]


def apply_mapping(df: DataFrame, mapping: DataFrame, col: str) -> DataFrame:
    """Replace ``col`` by its code; null where it has none.

    No broadcast is forced: a batch mapping has as many rows as there are
    batches.  A small one is broadcast from its measured size, a large one is
    joined by exchange, with hot keys split at run time.
    """
    lookup = mapping.select(F.col("original").alias("_original"), F.col("masked").alias("_masked"))
    return (
        df.join(lookup, F.col(col) == F.col("_original"), "left")
        .withColumn(col, F.col("_masked"))
        .drop("_original", "_masked")
    )


def name_mapping(df: DataFrame, cols: Sequence[str], prefix: str = "CMA") -> DataFrame:
    """``original`` → ``masked`` for attribute names, in column order."""
    rows = [(c, f"{prefix}{i}") for i, c in enumerate(cols, 1)]
    return df.sparkSession.createDataFrame(rows, "original string, masked string")


def mask(
    df: DataFrame,
    roles: Roles = Roles(),
    on: bool = True,
    order_by: str | None = None,
    stored: Mapping[str, DataFrame] | None = None,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Mask the identifiers and attribute names; returns the table and its five mappings.

    Codes of columns with few values are sent to the table's rows.  Those of the others
    are put on rows of key and identifiers alone, which meet the table once, by the key; a
    large table goes through these joins in lots, so that the disks need not hold the
    exchanges of all its rows.  The key must be unique; without a key, the table's own
    rows meet each mapping.  ``stored`` mappings of an earlier batch are extended and not renumbered.
    With ``on=False`` the table comes back untouched and there are no mappings.
    """
    if not on:
        return df, {}
    attributes, key = roles.features(df), roles.key
    needed = dict.fromkeys(c for c in (*roles.ids, key, order_by) if c in df.columns)
    narrow = written(df.select(*[F.col(f"`{c}`") for c in needed]))
    n_rows = narrow.count()
    prefixes = {c: ID_PREFIXES[c] for c in roles.ids}
    codes, ranked = _long_codes(narrow, prefixes, order_by, stored, n_rows)
    if stored:
        codes = written(codes)
        discard(ranked)
    mappings = {c: codes.filter(F.col("col") == c).select("original", "masked") for c in prefixes}
    if key in df.columns:
        require_unique(narrow, [key])
        held = {r["col"]: r["n"] for r in codes.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a column
        many = [c for c in roles.ids if held.get(c, 0) > _FEW_CODES]
        for col in roles.ids:
            if col not in many:
                # Spark would exchange the rows to learn how small the mapping is.
                df = apply_mapping(df, F.broadcast(mappings[col]), col)
        if many:
            df = _with_codes(df, key, _codes_by_key(narrow, key, many, mappings, n_rows), many, n_rows)
    else:
        for col in roles.ids:
            df = apply_mapping(df, mappings[col], col)
    discard(narrow)
    mappings["attribute"] = name_mapping(df, attributes)
    return df.withColumnsRenamed({c: f"CMA{i}" for i, c in enumerate(attributes, 1)}), mappings


def _codes_by_key(narrow: DataFrame, key: str, cols: Sequence[str], mappings: Mapping[str, DataFrame], n_rows: int) -> DataFrame:
    """(_key, codes of ``cols``), found column by column; the tables on the way, ``narrow`` the first, are removed."""
    spark, lots = narrow.sparkSession, lots_for(n_rows)
    state = narrow.select(F.col(f"`{key}`").alias("_key"), *cols)
    for col in cols:

        def coded(lot: int, state=state, col=col) -> DataFrame:
            some = mappings[col].filter(lot_of(lots, lot, ["original"]))
            return apply_mapping(state.filter(lot_of(lots, lot, [F.col(col).cast("string")])), some, col)

        done = stored_in_lots(spark, lots, coded)
        discard(state)
        state = done
    return state


def _with_codes(df: DataFrame, key: str, codes: DataFrame, cols: Sequence[str], n_rows: int) -> DataFrame:
    """``df`` with ``cols`` replaced by what ``codes`` holds for each key."""
    lots = lots_for(n_rows)
    codes = codes.withColumnsRenamed({c: f"_{c}" for c in cols})
    out = [F.col(f"_{c}").alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns]

    def joined(lot: int) -> DataFrame:
        rows, of = df.drop(*cols).filter(lot_of(lots, lot, [F.col(f"`{key}`")])), codes.filter(lot_of(lots, lot, ["_key"]))
        return rows.join(of, F.col(f"`{key}`").eqNullSafe(F.col("_key")), "left").select(*out)

    if lots == 1:
        return joined(0)
    done = stored_in_lots(df.sparkSession, lots, joined)
    discard(codes)
    return done

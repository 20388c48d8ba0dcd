"""The wide batch table the queries run on, derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDS = ["material_code", "component_code", "material_batch_nr", "component_batch_nr"]
ATTRS = [f"cma{i}" for i in range(1, 8)]
FILLED = ATTRS[:6]  # cma7 holds no value anywhere


class Book:
    """Collects the queries of one module and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql
            return run

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: row key, four identifiers, seven attributes with gaps."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd")).alias("row_key"),
        F.col("p_brand").alias("material_code"),
        F.col("p_type").alias("component_code"),
        key.cast("string").alias("material_batch_nr"),
        F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("component_batch_nr"),
        F.when((key + line) % 5 != 0, F.col("l_quantity")).alias("cma1"),
        F.when((key + 2 * line) % 4 != 0, F.col("l_extendedprice")).alias("cma2"),
        F.when((key + 3 * line) % 3 != 0, F.col("l_discount")).alias("cma3"),
        F.col("l_tax").alias("cma4"),
        F.col("p_size").cast("double").alias("cma5"),
        F.when(key % 7 >= 3, F.col("p_retailprice")).alias("cma6"),
        F.lit(None).cast("double").alias("cma7"),
    )


OPV = """opv AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS row_key,
         p_brand AS material_code, p_type AS component_code,
         CAST(l_orderkey AS varchar) AS material_batch_nr,
         concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS component_batch_nr,
         CASE WHEN (l_orderkey + l_linenumber) % 5 <> 0 THEN l_quantity END AS cma1,
         CASE WHEN (l_orderkey + 2 * l_linenumber) % 4 <> 0 THEN l_extendedprice END AS cma2,
         CASE WHEN (l_orderkey + 3 * l_linenumber) % 3 <> 0 THEN l_discount END AS cma3,
         l_tax AS cma4, CAST(p_size AS double) AS cma5,
         CASE WHEN l_orderkey % 7 >= 3 THEN p_retailprice END AS cma6,
         CAST(NULL AS double) AS cma7
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

COUNTED = OPV + """, counted AS (
  SELECT *, CAST(""" + " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in ATTRS) + """ AS integer) AS n_tests FROM opv)"""

SLICE = OPV + """, top_m AS (
  SELECT material_code FROM opv GROUP BY material_code ORDER BY count(*) DESC, material_code LIMIT 1),
top_c AS (
  SELECT component_code FROM opv WHERE material_code = (SELECT material_code FROM top_m)
  GROUP BY component_code ORDER BY count(*) DESC, component_code LIMIT 1),
slice AS (
  SELECT *, CAST(""" + " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in ATTRS) + """ AS integer) AS n_tests
  FROM opv WHERE material_code = (SELECT material_code FROM top_m)
    AND component_code = (SELECT component_code FROM top_c))"""


def dec(expression: str) -> str:
    """Exact decimal of a double: through its shortest text, not its binary value."""
    return f"TRY_CAST(CAST({expression} AS varchar) AS decimal(38,18))"


def median_sql(source: str, col: str) -> str:
    """Decimal median: the middle value, or the mean of the two middle ones."""
    return (
        "(SELECT CAST((CAST(min(v) AS decimal(18,6)) + CAST(max(v) AS decimal(18,6))) * 0.5 AS decimal(38,18)) FROM"
        f" (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) AS rn,"
        f" count(*) OVER () AS n FROM {source} WHERE {col} IS NOT NULL)"
        " WHERE rn = (n + 1) // 2 OR rn = (n + 2) // 2)"
    )


def quantile_sql(source: str, col: str, p: float, where: str = "TRUE") -> str:
    """Linear interpolation between neighbours, spelled out."""
    place = f"((n - 1) * CAST({p} AS double))"
    return (
        "(SELECT lo + (hi - lo) * part FROM (SELECT"
        f" max(CASE WHEN rn = CAST(floor({place}) AS bigint) THEN v END) AS lo,"
        f" max(CASE WHEN rn = CAST(ceil({place}) AS bigint) THEN v END) AS hi,"
        f" max({place} - floor({place})) AS part"
        f" FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS rn, count(*) OVER () AS n"
        f" FROM {source} WHERE {col} IS NOT NULL AND {where})))"
    )


def _imputed_sql(source: str, name: str) -> str:
    """``kept`` and ``imputed`` after the tables in ``source``, from the one called ``name``."""
    head = "row_key, material_code, component_code, material_batch_nr, component_batch_nr, n_tests,"
    return (
        f"{source}, kept AS MATERIALIZED (SELECT {head} " + ", ".join(f"{dec(c)} AS {c}" for c in FILLED)
        + f" FROM {name} WHERE n_tests >= 0.6 * (SELECT max(n_tests) FROM {name})), imputed AS MATERIALIZED (SELECT {head} "
        + ", ".join(f"coalesce({c}, {median_sql('kept', c)}) AS {c}" for c in FILLED) + " FROM kept)"
    )


def _filled_sql(imputed_sql: str) -> str:
    return (
        imputed_sql + ", filled AS MATERIALIZED (SELECT row_key, material_code, component_code, material_batch_nr, component_batch_nr, n_tests, "
        + ", ".join(f"CAST(CAST({c} AS varchar) AS double) AS {c}" for c in FILLED) + " FROM imputed)"
    )


IMPUTED, WHOLE_IMPUTED = _imputed_sql(SLICE, "slice"), _imputed_sql(COUNTED, "counted")
FILLED_DOUBLES, WHOLE_DOUBLES = _filled_sql(IMPUTED), _filled_sql(WHOLE_IMPUTED)


def fences_sql(source: str, cols=FILLED, name: str = "fences") -> str:
    """A one-row table with <col>_lo and <col>_hi."""
    parts = []
    for c in cols:
        q1, q3 = quantile_sql(source, c, 0.25), quantile_sql(source, c, 0.75)
        parts.append(f"{q1} - 1.5 * ({q3} - {q1}) AS {c}_lo, {q3} + 1.5 * ({q3} - {q1}) AS {c}_hi")
    return f"{name} AS MATERIALIZED (SELECT " + ", ".join(parts) + ")"


def outside_sql(cols=FILLED, missing: str = "TRUE") -> str:
    """TRUE when any of ``cols`` lies strictly outside."""
    return "(" + " OR ".join(f"coalesce({c} < {c}_lo OR {c} > {c}_hi, {missing})" for c in cols) + ")"


def deviation_sql(cols=FILLED) -> str:
    return (
        f"CASE WHEN {outside_sql(cols[:-1])} THEN 'Univariate deviation' ELSE 'Multivariate deviation' END"
    )


def r(value: Column | str, places: int = 6) -> Column:
    """Rounded double, so that both engines print the same digits."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), places)


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, places) for c in cols})


def pruned(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """The table, or its busiest slice, with its test count, pruned at 60 %, attributes as exact decimals."""
    from batchlens.functions import present_count
    from batchlens.operators.cleaning import to_decimal
    from batchlens.operators.coverage import prune_low_coverage
    from batchlens.plans import focus_slice
    from batchlens.sources import stored

    df = opv(spark, sf_dir)
    part = (df if whole else focus_slice(df)).withColumn("n_tests", present_count(ATTRS))
    return stored(to_decimal(prune_low_coverage(part), FILLED).drop("cma7"))


def imputed(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    from batchlens.operators.cleaning import impute_median

    return impute_median(pruned(spark, sf_dir, whole), FILLED)


def filled(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    from batchlens.operators.cleaning import to_double
    from batchlens.sources import stored

    return stored(to_double(imputed(spark, sf_dir, whole), FILLED))

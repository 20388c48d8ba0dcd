"""Reading, writing and looking at tables."""

from pyspark.sql import functions as F

from batchlens.functions import present_count
from batchlens.operators.masking import mask
from batchlens.operators.roles import Roles, canonical_names
from batchlens.sources import (
    describe_schema,
    preview,
    read_batches,
    run_folder,
    table_shape,
    write_mappings,
    write_table,
)
from queries.fixture import ATTRS, COUNTED, FILLED, IDS, OPV, Book, opv, table

BOOK = Book()

_TITLES = {c: c.replace("_", " ").title() for c in IDS}


@BOOK.add(
    "s1_scan_csv",
    f"WITH {OPV} SELECT row_key, material_code, component_code, lpad(material_batch_nr, 12, '0') AS material_batch_nr,"
    f" component_batch_nr, {', '.join(FILLED)} FROM opv",
)
def scan_csv(spark, sf_dir):
    path = run_folder(spark, "csv")
    padded = opv(spark, sf_dir).withColumn("material_batch_nr", F.lpad("material_batch_nr", 12, "0"))
    padded.select("row_key", *IDS, *FILLED).write.option("header", True).csv(path)
    schema = ", ".join([f"{c} string" for c in ["row_key", *IDS]] + [f"{c} double" for c in FILLED])
    return read_batches(spark, path, schema=schema)


@BOOK.add(
    "s1_scan_csv_inferred",
    "SELECT lpad(CAST(l_orderkey AS varchar), 12, '0') AS batch_nr, l_quantity, l_extendedprice, l_linenumber FROM lineitem",
)
def scan_csv_inferred(spark, sf_dir):
    path = run_folder(spark, "csv")
    lines = table(spark, sf_dir, "lineitem")
    lines.select(
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("batch_nr"), "l_quantity", "l_extendedprice", "l_linenumber"
    ).write.option("header", True).csv(path)
    return read_batches(spark, path, ids=["batch_nr"])


@BOOK.add(
    "s2_scan_extract",
    f"WITH {COUNTED} SELECT material_batch_nr, material_code, component_code, component_batch_nr, n_tests AS original_tests,"
    f" {', '.join(ATTRS)} FROM counted",
)
def scan_extract(spark, sf_dir):
    path = run_folder(spark, "extract")
    sheet = opv(spark, sf_dir).withColumn("Total Tests for the Comp Batch", present_count(ATTRS)).drop("row_key")
    titles = {**_TITLES, "material_batch_nr": "Batch Nr"}
    write_table(sheet.withColumnsRenamed(titles), path)
    renames = {"Batch Nr": "Material Batch Nr", "Total Tests for the Comp Batch": "Original Tests"}
    return canonical_names(read_batches(spark, path, "parquet"), renames)


@BOOK.add("s3_scan_parquet", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25")
def scan_parquet(spark, sf_dir):
    lines = read_batches(spark, f"{sf_dir}/lineitem.parquet", "parquet")
    return lines.filter("l_quantity > 25").select("l_orderkey", "l_linenumber", "l_quantity")


@BOOK.add("s4_parquet_sink", f"WITH {OPV} SELECT row_key, {', '.join(IDS)}, {', '.join(FILLED)} FROM opv")
def parquet_sink(spark, sf_dir):
    path = run_folder(spark, "table")
    write_table(opv(spark, sf_dir).select("row_key", *IDS, *FILLED), path)
    return spark.read.parquet(path)


@BOOK.add(
    "s5_mapping_files",
    f"WITH {OPV}, m AS (SELECT DISTINCT material_code AS v FROM opv), c AS (SELECT DISTINCT component_code AS v FROM opv)"
    " SELECT v AS original, concat('M', row_number() OVER (ORDER BY v)) AS masked FROM m"
    " UNION ALL SELECT v, concat('C', row_number() OVER (ORDER BY v)) FROM c",
)
def mapping_files(spark, sf_dir):
    path = run_folder(spark, "mappings")
    codes = opv(spark, sf_dir).select("material_code", "component_code")
    _, mappings = mask(codes, Roles(ids=("material_code", "component_code")))
    del mappings["attribute"]
    write_mappings(mappings, path)
    read = [read_batches(spark, f"{path}/{name}", schema="original string, masked string") for name in mappings]
    return read[0].unionByName(read[1])


@BOOK.add("s6_shape", f"WITH {OPV} SELECT count(*) AS n_rows, CAST(12 AS bigint) AS n_columns FROM opv")
def shape(spark, sf_dir):
    return table_shape(opv(spark, sf_dir))


@BOOK.add("s7_preview", f"WITH {OPV} SELECT row_key, material_code, cma2 FROM opv ORDER BY cma2 DESC NULLS LAST, row_key LIMIT 10")
def preview_rows(spark, sf_dir):
    return preview(opv(spark, sf_dir).select("row_key", "material_code", "cma2"), 10, F.desc_nulls_last("cma2"), "row_key")


@BOOK.add("s8_schema")
def schema(spark, sf_dir):
    return describe_schema(opv(spark, sf_dir), Roles())

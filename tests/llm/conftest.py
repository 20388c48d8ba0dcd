import pytest

SF = "/root/testdata/sf0.001"

#: nulls in every column, empty and blank texts, ties, repeated rows
ODD = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 48),
    (1, "one two three four five six seven eight nine ten", "en", "a", 48),
    (2, "one two three four five six seven eight nine ten", None, None, None),
    (3, "", "en", "a", 0),
    (4, None, "en", "a", None),
    (None, None, None, None, None),
    (None, "lonely words without an id", "en", "b", 26),
    (5, "  \n \t ", "en", "b", 6),
    (6, "x" * 30_000, "en", "b", 30_000),
    (7, "ünï çödé 日本語 😀 " * 40, "xx", "c", 640),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    clash = ["key", "digest", "row", "id", "word", "bands", "kept", "n_tokens", "n_words", "_text", "_key", "text_2", "piece"]
    return df.withColumns({c: F.lit(1) for c in clash})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty and blank texts, repeated rows, one long text, ties, and columns that clash with names of results."""
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [(1, "a b c d e " * 20, "en", "s1", 1), (1, "a b c d e " * 20, "en", "s1", 1), (2, None, "en", "s1", None), (3, "", None, None, 0), (4, " \n\t ", "en", None, 3), (5, long, "de", "s2", 9), (None, "x y z", "de", "s2", 5), (6, "one", None, "s2", 3), (7, "l1 q\nl2 q\nl3 q\nl4 q\nl5 q\nl6 q\n", "en", "s1", 1), (8, "l1 q\nl2 q\nl3 q\nl4 q\nl5 q\nl6 q\n", "en", "s1", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for name in ("shard", "slot", "size", "kept", "n_words", "row", "tie", "part", "rid", "chunks", "text_key", "found", "n_lines", "g_lang", "d", "t", "l", "s", "gone", "copies", "fence", "hi_symbols"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

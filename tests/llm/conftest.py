import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
CLASHES = ("doc", "fp", "rep", "t", "key", "kept_id", "nth", "words", "verdict", "score", "rank", "size", "n", "marks", "rest", "row", "chosen", "component_id", "copies", "length", "part", "text2")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    rows = [
        (1, "The first text of all, with some more words in it.", "en", "a"),
        (2, "", "en", "a"),
        (3, None, "en", None),
        (4, "The first text of all, with some more words in it.", None, "b"),
        (5, LONG, "de", "b"),
        (5, LONG, "de", "b"),
        (6, " \t\n ", None, None),
        (None, "A text that has no id at all, and says so.", "en", "b"),
        (None, None, None, None),
        (7, "!!! 123 $$$", "fr", "c"),
        (8, "é" * 300, "fr", "c"),
        (9, "a <|im_end|> b <|endoftext|> ...", "en", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"mine {c}"))
    return df


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns of their own whose names clash with the operators'."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.withColumns({"shard": F.lit("x"), "fp0": F.lit(1), "h": F.lit(2), "block": F.lit(3), "score": F.lit("y"), "n_chars": F.length("text").cast("long")})

    return make


#: Null, empty and blank texts, repeated rows, a null doc_id, few words, a long text, letters outside ASCII.
ODD = [(None, "a b c d"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "One two"), (6, "x " * 30_000), (7, "Éa é <|endoftext|> 😀 İstanbul don't"), (8, "a b c d"), (9, "a b c d")]


@pytest.fixture(scope="session")
def odd():
    return ODD

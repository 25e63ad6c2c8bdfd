import pytest
from pyspark.sql import types as T

WORDS = [f"w{i}" for i in range(400)]


def text(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named like internal ones."""
    base = text(3, 120)
    rows = [
        (1, base), (2, base.replace("w3 ", "w4 ", 1)), (3, base.upper()), (4, base + "  \t\n"), (5, None), (6, ""), (7, " \n\t"), (8, "one two"),
        (8, "one two"), (9, "one  two"), (10, text(5, 60_000)), (11, text(5, 59_000)), (None, base), (None, "lonely text of a row without id"),
        (12, "a b c d e f g"), (13, text(8, 300)), (14, text(8, 290)), (15, "x" * 5000), (16, "é ü 日本 \x00 ▁ <unk>"), (2**40, text(9, 50)),
    ]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "s", 0, k, "n", 1.0, None) for k, (i, t) in enumerate(rows)]
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.IntegerType()), T.StructField("node", T.IntegerType()),
        T.StructField("sig", T.StringType()), T.StructField("component_id", T.DoubleType()), T.StructField("t", T.StringType())])
    return spark.createDataFrame(rows, schema)

"""Findings of round 4: odd rows against SQL, shared work against the plain form."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import compare


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    texts = [None, "", "a", "\x00ab", "é", "😀😀ab", "aaaaaaaaaaaaaaaa", " \n"]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_hashed_text_of_nothing(spark, odd_texts):
    """A null or empty text sets no position: its sum is null, as in the SQL."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{odd_texts}/documents.parquet/*.parquet'")
    name = "prj10_hashed_text"
    assert compare(entry.queries()[name](spark, odd_texts), con, entry.oracle_sql()[name]) is None

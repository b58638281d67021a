import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, rate int, `row` string"
LONG = "word " * 60_000


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 0.5, "clash", 3, "r")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns whose names the operators use themselves."""
    rows = [doc(1, "the thing and the other one"), doc(1, "the thing and the other one"), doc(2, None), doc(3, ""), doc(4, LONG), doc(None, "der die das und"), doc(5, "12345 ..."), doc(6, " \n\t ", None), (7, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()

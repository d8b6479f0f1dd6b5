import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaks string, r int, content string, ids int, key int, s int, words int, label int, part int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (id, text), with columns whose names clash with those that operators make."""

    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, "src", 1, "x", 1, "y", 2, 3, 4, 5, 6, 7) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Null ids and texts, empty and very long texts, repeated rows."""
    return docs_of([(1, None), (2, ""), (3, " \n "), (4, "word " * 60_000), (5, "repeated row"), (5, "repeated row"), (None, "no id"), (None, None), (6, "é" * 3000), (7, "\x00 ÿ 😀")])


@pytest.fixture(scope="session")
def sample(sf_dir):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()

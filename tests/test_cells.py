"""Cells find what a search of all vectors finds, and read few of them where vectors lie in groups."""

import numpy as np
import pytest

from quern.operators import cells
from quern.operators import search as S

CHUNK = "chunk_id int, user_id string, embedding array<double>"


def hits(df):
    return sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 1500)] + 0.05 * rng.normal(size=(1500, 8))
    rows = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, "a", [0.0] * 8), (2001, "a", None), (2002, "a", [1.0, 2.0]), (2003, "b", rows[5][2]), (2004, "b", rows[5][2]), (2005, None, rows[5][2])]
    asked = [(i, "ab"[i % 2], x[i].tolist()) for i in range(0, 60, 7)] + [(900, "a", [2.0, 1.0]), (901, "a", None), (902, "nobody", x[0].tolist()), (903, "b", [0.0] * 8)]
    return spark.createDataFrame(rows, CHUNK), spark.createDataFrame(asked, CHUNK.replace("chunk_id", "query_id"))


@pytest.mark.parametrize("k", [1, 7, 900])
def test_same_rows_as_a_search_of_all(grouped, k):
    chunks, asked = grouped
    found, visits = cells.topk(cells.build(chunks), asked, k)
    assert hits(found) == hits(S.dense_topk(chunks, asked, k))
    seen = visits.collect()
    assert all(r.visited <= r.cells for r in seen)
    if k == 7:
        assert sum(r.visited for r in seen) < 0.5 * sum(r.cells for r in seen)


def test_empty(grouped):
    chunks, asked = grouped
    assert cells.topk(cells.build(chunks.limit(0)), asked, 3)[0].count() == 0
    assert cells.topk(cells.build(chunks), asked.limit(0), 3)[0].count() == 0


def test_stored_tables_are_released(spark):
    from quern.sources import tables

    df = tables.stored(spark.range(3), "some")
    files = df.inputFiles()
    assert df.count() == 3 and files and tables.exists(spark, files[0])
    assert tables.release(spark) >= 1 and not tables.exists(spark, files[0]) and tables.release(spark) == 0

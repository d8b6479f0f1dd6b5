"""Operator 13: rows against brute force, pruning that loses nothing, copies, ties and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import hard_negatives as H
from quern.llm.queries import ORACLE_SQL, op13_hard_negatives

SCHEMA = "id bigint, label bigint, vec array<bigint>, anchor boolean, leaf string, g int, cid string"


def brute(rows, positives=5, negatives=5, low=80, high=100):
    """All anchors against all rows, one after the other. rows: distinct (id, label, vec, anchor)."""
    out = []
    for i, label, v, anchor in rows:
        if not anchor:
            continue
        others = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, m) for j, m, w, _ in rows if len(w) == len(v) and (j, m, w) != (i, label, v)]
        for s, j, _ in sorted(x for x in others if x[2] == label)[:positives]:
            fit = sorted(x for x in others if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out += [(i, j, n, k, -s, -t) for n, (t, k, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    got = H.hard_negatives(df, F.col("anchor"), **more)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def made(rng, n, dim, labels, spread=20, copies=0.3):
    centres = [[rng.randrange(-60, 60) for _ in range(dim)] for _ in range(6)]
    rows, seen = [], []
    for i in range(n):
        v = rng.choice(seen) if seen and rng.random() < copies else [x + rng.randrange(-spread, spread) for x in rng.choice(centres)]
        seen.append(v)
        rows.append((i, rng.randrange(labels), v, i % 5 == 0))
    return rows


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = made(rng, 260, 6, 4)
    want = brute(rows)
    assert len(want) > 500 and mined(spark, rows) == want
    for name, value in (("BLOCK", 40), ("GROUP", 7), ("LEAF", 8), ("ANCHOR_LEAF", 3), ("SAMPLE", 64)):
        monkeypatch.setattr(H, name, value)
    assert mined(spark, rows) == want  # many leaves, blocks and groups
    assert mined(spark, rows, positives=2, negatives=9, low=50) == brute(rows, 2, 9, 50)


def test_copies_ties_and_lengths(spark):
    same = [(i, 1, [3, 4], i in (0, 7)) for i in range(12)] + [(i, 2, [3, 4], False) for i in range(20, 32)]
    rows = same + [(50, 1, [1], True), (51, 1, [1], False), (52, 2, [1], False), (60, 1, [], True), (61, 1, [], False), (62, 2, [], False), (70, 1, [-3, -4], True)]
    assert mined(spark, [*rows, *rows[:5]]) == brute(rows)
    ids = [(5, 1, [2, 2], True), (5, 1, [2, 3], True), (5, 2, [2, 2], False), (6, 3, [2, 2], True)]  # one id, several rows
    assert mined(spark, ids) == brute(ids)


def test_rows_that_take_no_part(spark):
    rows = [(0, 1, [5, 5], True), (1, 1, [5, 4], False), (2, 2, [5, 4], False)]
    bad = [(None, 1, [5, 5], True), (3, None, [5, 5], True), (4, 2, None, False), (5, 2, [5, None], False), (6, 2, [2**62, 1], False)]
    assert mined(spark, rows + bad) == brute(rows) != []
    large = [(0, 1, [2**29, 3], True), (1, 1, [2**29, 1], False), (2, 2, [2**29, 2], False), (3, 2, [2**29 - 1, 2], False)]
    assert mined(spark, large) == brute(large)
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1], False)]) == [] and mined(spark, [(1, 1, [1], True)]) == []


def test_pruning_scores_few_pairs_of_clustered_vectors_and_loses_none():
    rng = np.random.default_rng(8)
    centres = rng.integers(-200, 200, (40, 16))
    make = lambda n: centres[rng.integers(0, 40, n)] + rng.integers(-6, 6, (n, 16))
    a, c = make(300), make(4000)
    la, lc = rng.integers(0, 3, 300), rng.integers(0, 3, 4000)
    wishes = np.arange(300), np.full(300, H.NONE + 1), np.full(300, -H.NONE)
    s = H.Search(a, la, wishes, c, lc, np.arange(4000), 5, True)
    scores = a @ c.T
    want = {(i, j) for i in range(300) for j in sorted(np.flatnonzero(lc == la[i]), key=lambda j: (-scores[i, j], j))[:5]}
    wish, at, score = s.found()
    assert set(zip(wish.tolist(), at.tolist(), strict=True)) == want and (score == scores[wish, at]).all()
    assert s.scored < 0.35 * 300 * 4000


def test_intervals_hold_every_product():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = rng.integers(-50, 50, (8, 5)), rng.integers(-50, 50, (9, 5))
        low, high = H.interval(H.tree(x, 100), H.tree(y, 100))
        p = x @ y.T
        assert low <= p.min() and p.max() <= high


@pytest.fixture(scope="module")
def con(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    return con


def test_query_equals_its_sql(spark, sf_dir, con):
    df = op13_hard_negatives(spark, sf_dir)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert df.columns == columns
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['op13_hard_negatives']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 20


def test_query_on_odd_vectors(spark):
    rows = [(0, [0.5, 0.25], 1), (7, [0.5, 0.26], 0), (1, [0.4, 0.1], 1), (2, [0.45, 0.2], 3), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 2), (5, None, 1), (6, [0.1, None], 1), (8, [0.5, 0.2], None), (100, [0.3, -0.2], 1), (14, [0.3, 0.3], 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("anchor_id", F.lit(1))
    got = sorted(map(tuple, H.negative_table(df).collect()))
    f32 = lambda x: float(np.float32(x))
    good = [(i, (m + 1) % 10 if i % 7 == 0 else m, [math.floor(256 * f32(x)) for x in v], i % 100 == 0) for i, v, m in rows if m is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert got == brute(good) and got
    assert H.negative_table(df.limit(0)).count() == 0

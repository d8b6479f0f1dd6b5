"""Operator 12: counts and scores against plain counting, the weights against plain EM, probabilities that sum to one."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import interpolation as lm
from quern.llm.queries import op12_interpolation

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w.decode() for w in (text or "").translate(LOW).encode().split()] + [" "]


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 if doc_id is not None else 1


class Plain:
    """The model by counting in dictionaries."""

    def __init__(self, rows):
        self.rows = [(i, tokens(t)) for i, t in rows]
        self.words, self.pairs = [Counter() for _ in range(4)], [Counter() for _ in range(4)]
        for i, ts in self.rows:
            if remainder(i):
                for part in (3, (remainder(i) - 1) % 3):
                    self.words[part].update(ts)
                    self.pairs[part].update(zip([" ", *ts], ts, strict=False))
        self.n, self.v = sum(self.words[3].values()), len(self.words[3])

    def held(self):
        """Buckets and estimates of every training word from the other parts."""
        for i, ts in self.rows:
            if remainder(i):
                part = (remainder(i) - 1) % 3
                left = self.n - sum(self.words[part].values())
                for v, w in zip([" ", *ts], ts, strict=False):
                    c = self.words[3][v] - self.words[part][v]
                    pair, word = self.pairs[3][v, w] - self.pairs[part][v, w], self.words[3][w] - self.words[part][w]
                    yield c.bit_length(), pair / max(c, 1), word / max(left, 1), 1 / (self.v + 1)

    def weights(self):
        by = {}
        for b, *f in self.held():
            by.setdefault(b, []).append(f)
        out = {}
        for b, f in by.items():
            f, open_ = np.array(f), np.array([b > 0, 1, 1])
            w = open_ / open_.sum()
            for _ in range(300):
                share = f * w
                new = ((share / share.sum(axis=1, keepdims=True)).sum(axis=0) + 1) * open_
                w = new / new.sum()
            out[b] = w
        return out

    def score(self, ts, weights):
        total = 0.0
        for v, w in zip([" ", *ts], ts, strict=False):
            c = self.words[3][v]
            a, b, d = weights[c.bit_length()]
            total += math.log10(a * self.pairs[3][v, w] / max(c, 1) + b * self.words[3][w] / self.n + d / (self.v + 1))
        return total


def check(spark, docs, rows):
    """The table's rows, held against the plain model with the table's own weights; the model and the plain one."""
    from pyspark.sql import functions as F

    table = lm.counted(docs.select(F.col("doc_id").alias("id"), F.expr("CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 10 = 0 THEN -1 ELSE coalesce((crc32(cast(cast(doc_id AS string) AS binary)) % 10 - 1) % 3, 0) END").cast("int").alias("part"), "text"))
    model, plain = lm.mixture(table), Plain(rows)
    assert (model.tokens, model.kinds) == (plain.n, plain.v)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_table(docs).collect()), key=str)
    want = sorted(((i, remainder(i) == 0, len(ts), sum(plain.words[3][t] > 0 for t in ts), plain.n, sum(math.log10((plain.words[3][t] + 0.1) / (plain.n + 0.1 * (plain.v + 1))) for t in ts), plain.score(ts, model.weights)) for i, ts in plain.rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    return model, plain, got


def test_query_against_plain_counts(spark, sf_dir, sample):
    rows = list(zip(sample.doc_id.tolist(), sample.text.tolist(), strict=True))
    model, plain, got = check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), rows)
    exact = plain.weights()
    assert len(exact) > 8 and all(np.abs(model.weights[b] - w).max() < 0.01 for b, w in exact.items())  # cells are an eighth of a power of two wide
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # better than words alone on what it didn't learn from
    mine = {r.doc_id: r.score for r in op12_interpolation(spark, sf_dir).collect()}
    assert mine == {g[0]: g[6] for g in got}


def test_small_blocks_and_ranges_give_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    once = {r.doc_id: (r.n_known, r.score) for r in lm.score_table(docs).collect()}
    monkeypatch.setattr(lm, "RANGE", 20_000)
    monkeypatch.setattr(lm.blocks, "__defaults__", (9_000,))
    again = {r.doc_id: (r.n_known, r.score) for r in lm.score_table(docs.repartition(5)).collect()}
    assert again == once


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    seq = rng.integers(0, 6, 400)
    pair = np.zeros((6, 6))
    np.add.at(pair, (seq[:-1], seq[1:]), 1)
    before, word = pair.sum(axis=1), pair.sum(axis=0)
    model = lm.Mixture(lm.learn(np.zeros(3, dtype=int), np.array([1, 3, 6]), np.array([0.2, 0.0, 0.5]), np.array([3.0, 1.0, 9.0]), np.array([5, 2, 90]), np.array([10.0, 20.0, 30.0]), 6), int(word.sum()), 6)
    for v in range(6):
        known = 10 ** model.log10(pair[v], np.full(6, before[v]), word)
        unknown = 10 ** model.log10(np.zeros(1), before[v : v + 1], np.zeros(1))
        assert known.sum() + unknown.sum() == pytest.approx(1)
    new = 10 ** model.log10(np.zeros(7), np.zeros(7), np.append(word, 0))
    assert new.sum() == pytest.approx(1)


def test_planes_and_cells():
    x = np.array([0, 1, 255, 256, 2**40, 2**63], dtype=np.uint64)
    assert (lm.unplanes(lm.planes(x)) == x).all() and len(lm.unplanes(lm.planes(x[:0]))) == 0
    code, n = lm.cells(2, np.array([0, 1, 1]), np.array([0, 4, 4]), np.array([7, 8, 8]))
    part, bucket, ratio, word = lm.of_cell(code)
    assert part.tolist() == [2, 2] and bucket.tolist() == [0, 3] and ratio.tolist() == [0, 0.25] and word[1] == 8 and abs(word[0] / 7 - 1) < 0.05 and n.tolist() == [1, 2]


def test_odd_rows(spark, odd, docs_of):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(spark, odd, rows)
    mixed = [(k, t) for k in range(30) for t in ("Same words HERE", "same É words", None if k % 3 else " ")]
    check(spark, docs_of(mixed), mixed)
    held = [k for k in range(200) if remainder(k) == 0][:3]
    none = lm.score_table(docs_of([(k, "never taught") for k in held])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in none] == [(3, 0, 0, 0.0, 0.0)] * 3
    assert lm.score_table(odd.limit(0)).count() == 0

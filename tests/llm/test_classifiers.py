"""Operators 2 and 3: held-out accuracy, contracts and odd rows."""

import zlib

import numpy as np

from quern.llm import language, quality
from quern.llm.queries import op2_quality, op3_language_id


def test_quality_query(spark, sf_dir):
    rows = op2_quality(spark, sf_dir.replace("0.001", "0.01")).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.9


def test_quality_odd_rows(spark, odd, docs_of):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 1), (7, None, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.quality_table(odd, labels).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality_table(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_table(odd.limit(0), labels).count() == 0


def test_a_hot_id_does_not_crowd_out_other_labels(spark, docs_of):
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1]
    text = lambda k: f"Good prose of number {k}, well told." if k % 2 else f"BUY {k} !!! $$$ now now now"
    labels = spark.createDataFrame([(k, k % 2, 0) for k in ids], "doc_id bigint, quality int, toxic int")
    once = docs_of([(k, text(k)) for k in ids]).repartition(1)
    many = docs_of([(ids[0], text(ids[0]))] * 500).union(docs_of([(k, text(k)) for k in ids]))
    want, got = quality.train(once, labels, most=len(ids)), quality.train(many, labels, most=len(ids))
    assert got.value.any() and (got.value == want.value).all() and got.bias == want.bias and got.slope == want.slope
    varied = many.union(docs_of([(ids[0], f"other text {k}") for k in range(200)]))
    assert (quality.train(varied, labels, most=len(ids)).value == quality.train(varied.repartition(5), labels, most=len(ids)).value).all()


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(80)]
    labels = np.array([1 if (x < 20).sum() > 4 else -1 for x in rows])
    ratios = rng.normal(size=quality.DIM)
    w, bias = quality.dual_descent(rows, labels, ratios)
    v = [ratios[x] / np.sqrt((ratios[x] ** 2).sum()) for x in rows]
    margins = np.array([w[x] @ v_ + bias for x, v_ in zip(rows, v, strict=True)])
    weight = {y: len(labels) / (2 * (labels == y).sum()) for y in (1, -1)}
    loss = lambda w, b: 0.5 * (w @ w + b * b) + sum(weight[y] * max(0, 1 - y * (w[x] @ v_ + b)) for x, v_, y in zip(rows, v, labels, strict=True))
    assert loss(w, bias) < loss(w * 0, 0.0) and (np.sign(margins) == labels).mean() > 0.8
    for scale in (0.9, 1.1):
        assert loss(w, bias) <= loss(w * scale, bias * scale) + 0.05


def test_language_query(spark, sf_dir, sample):
    rows = {r.doc_id: r for r in op3_language_id(spark, sf_dir).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [(rows[i].lang_pred, lang) for i, lang in zip(sample.doc_id, sample.lang, strict=True) if rows[i].held_out and lang is not None]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.95


def test_language_odd_rows(spark, odd, docs_of):
    teach = docs_of([(k, "der die das und nicht") for k in range(20)], "de").union(docs_of([(k, "the and of that not") for k in range(20, 40)], "en"))
    model = language.train(teach)
    assert model.languages == ["de", "en"]
    got = {(r.doc_id, r.text): r.r for r in language.identify(odd.drop("r"), model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0.0 for k in [(1, None), (2, ""), (3, " \n "), (None, None)])
    ask = docs_of([(1, "nichts understandable"), (2, "12 34 !"), (3, "Thatnot thethe")]).drop("r")
    found = {r.doc_id: r.r.lang_pred for r in language.identify(ask, model).collect()}
    assert found[2] == "und" and found[3] == "en"
    # Letters that no labelled document holds: the language of most of them, with no word for it.
    unseen = {r.doc_id: (r.r.lang_pred, r.r.score) for r in language.identify(docs_of([(1, "中文"), (2, "Ωμέγα 12"), (3, "12")]).drop("r"), model).collect()}
    assert unseen == {1: ("de", 0.0), 2: ("de", 0.0), 3: ("und", 0.0)}
    more = language.train(teach.union(docs_of([(k, "the and of") for k in range(40, 50)], "en")))
    assert language.predict(more, np.array([0.0] * 4 + [1.0])) == ("en", 0.0)
    rare = language.train(docs_of([(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}x{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}" for j in range(2000))) for k in range(40)], "de"))
    assert len(rare.words) > 30_000  # however rare, a word that was read is known
    none = language.train(teach.limit(0))
    assert {r.r.lang_pred for r in language.identify(odd.drop("r"), none).collect()} == {"und"}
    assert language.language_table(odd.limit(0)).count() == 0 and language.language_table(odd).count() == 10


def test_backoff_goes_to_shorter_grams():
    kept = [("a", 0, "word", 3), ("b", 0, "other", 3), ("a", 4, "<wor", 2), ("b", 3, "xyz", 2), ("b", 1, "q", 1)]
    model = language._fit(["a", "b"], kept)
    assert model.vector("word")[0] > model.vector("word")[1]
    assert (model.vector("worq") == model.grams[4]["<wor"]).all() and (model.vector("axyz") == model.grams[3]["xyz"]).all()
    assert (model.vector("qq") == model.grams[1]["q"]).all() and model.vector("--") is None

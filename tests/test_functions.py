import hashlib
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.functions.hashing import BUCKETS, bucket, murmur3
from quern.functions.metrics import histogram
from quern.operators.collection import gate

TEXTS = ["", " ", "one", "a b  c\td\n", "ශ්‍රී ලංකාවේ water Cycle 12 a 3x", "Straße – x。Y! Z\n\n\nq", "é" * 9, "x\x1cy z"]


@pytest.mark.parametrize("text", TEXTS)
def test_words_and_estimates(run, text):
    assert run(T.words, t=text) == text.split()
    want = max(1, int(len(text.split()) * 1.35 + sum(ord(c) > 127 for c in text) / 4)) if text else 0
    assert run(T.token_estimate, t=text) == want
    assert run(T.strip, t=text) == text.strip()


def test_tokens(run):
    assert run(T.tokens, t="ශ්‍රී ලංකාවේ water Cycle 12 a 3x") == ["ශ්‍රී", "ලංකාවේ", "water", "cycle", "12"]
    assert run(T.tokens, t=None) == []
    assert run(T.tokens, t="‍ab‍ ٣٤") == ["ab", "٣٤"]


def test_sentences(run):
    assert run(T.sentences, t="One. Two!  Three?\n\nFour。 Five") == ["One.", "Two!", "Three?", "Four。", "Five"]
    assert run(T.sentences, t=None) == []


def test_ids(run):
    name = "demo-1"
    assert run(lambda c: T.uuid5(uuid.NAMESPACE_DNS, c), t=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert run(T.citation_id, t=name) == "C-6B01C344DB"
    assert run(T.point_id, t=name) == str(uuid.uuid5(T.NAMESPACE, name))
    assert run(lambda c: T.catalogue_version(F.array(c, c)), t="a") == hashlib.sha256(b"a\na").hexdigest()[:12]


def test_lessons(run):
    for heading, number, title in [("3 Energy", 3, "Energy"), ("Energy", None, "Energy"), ("3", None, "3"), ("12  Heat and work ", 12, "Heat and work"), ("3Energy", None, "3Energy")]:
        assert run(T.lesson_number, h=heading) == number
        assert run(T.lesson_title, h=heading) == title


def test_jaccard_and_hash(run):
    split = lambda a, b: T.jaccard(F.split(a, " "), F.split(b, " "))
    assert run(split, a="a b c d", b="a b c d e") == 0.8
    assert run(lambda a: T.jaccard(F.filter(F.split(a, " "), lambda x: F.lit(False)), F.array().cast("array<string>")), a="a") == 0.0
    assert run(T.content_hash, a="A,  b!") == run(T.content_hash, a="a b") == hashlib.sha256(b"a b").hexdigest()


def test_templates_and_cells(run):
    assert run(lambda a: T.render("Hi {{ name }}, {{name}}!", {"name": a}), a="Bo") == "Hi Bo, Bo!"
    with pytest.raises(KeyError):
        T.render("{{missing}}", {})
    assert run(T.markdown_cell, a="a|b") == "a\\|b"


def test_json_salvage(run):
    assert run(T.object_of, a='{"a": 1}') == '{"a": 1}'
    assert run(T.object_of, a='Sure: {"a": {"b": 1}} done') == '{"a": {"b": 1}}'
    assert run(T.object_of, a="[1, 2]") is None
    assert run(T.object_of, a="no") is None


def test_murmur(spark):
    assert [hex(h) for h in murmur3([b"", b"test", b"hello"]).tolist()] == ["0x0", "0xba6bd213", "0x248bfa47"]
    words = ["a", "ab", "abc", "abcd", "abcde", None, "a"]
    got = [r.b for r in spark.createDataFrame([(w,) for w in words], "w string").coalesce(1).select(bucket(F.col("w")).alias("b")).collect()]
    assert got == [None if w is None else int(murmur3([w.encode()])[0]) % BUCKETS for w in words]


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    got = [r.x for r in spark.createDataFrame(rows, "a array<double>, b array<double>").coalesce(1).select(V.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert np.allclose(got, [math.sqrt(0.5), 0, 0, 0])


def test_histogram(spark):
    rows = spark.createDataFrame([("a", 0.5), ("a", 2.0), ("a", 9.0), ("b", None)], "k string, v double")
    assert {(r.k, r.le): r.n for r in histogram(rows, "k", "v", [1.0, 2.0]).collect()} == {("a", 1.0): 1, ("a", 2.0): 2, ("a", math.inf): 3, ("b", 1.0): 0, ("b", 2.0): 0, ("b", math.inf): 0}


def test_words_are_counted_by_splitting(spark, run):
    assert [run(T.word_count, t=t) for t in ("", "  ", " a\xa0b　c ", "é\x1cx", None)] == [0, 0, 3, 2, 0]
    plan = spark.range(1).select(T.word_count(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "regexp_count" not in plan  # five times as slow


def test_short_tokens_and_joiners(run):
    assert run(T.tokens, t="a b1 cd ‍ක‍ ක‍ෂ 1 12") == ["cd", "ක‍ෂ", "12"]
    assert run(T.tokens, t="a b1 cd ක 1 12") == ["cd", "12"]


def test_blank_is_white_space_only(spark):
    """Whatever counts as white space is blank and nothing else is, without the text being stripped."""
    spaces = "".join(chr(c) for c in range(0x3001) if not chr(c).strip())
    cases = [None, "", " ", spaces, spaces + "x", "x" + spaces, "\n\n.\n", "\u200b", "\x00", "\ud7ff", *spaces]
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    blank = T.blank_to_null(F.col("t"))
    assert [r.x for r in rows.select(blank.alias("x")).collect()] == [t if t and t.strip() else None for t in cases]
    assert "regexp_replace" not in rows.select(blank)._jdf.queryExecution().optimizedPlan().toString()


def test_words_between_every_kind_of_space(spark):
    kinds = [chr(k) for k in range(0x3100) if chr(k).isspace()]
    texts = [f"{s}a{s}{s}b c{s}" for s in kinds] + ["“a” – b…　c", "".join(kinds), "a" + "".join(kinds) + "b", "a‍b​ c﻿"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.words(F.col("t")).alias("w")).collect()
    assert {r.i: r.w for r in got} == {i: t.split() for i, t in enumerate(texts)}


def test_the_gate_looks_no_further_than_the_last_word_it_needs(spark):
    rng = np.random.default_rng(3)
    parts = ["a", "é", "Z9", "٣", "…", "-", " ", " ", "\n", "\x1c", " ", "　", "ශ්‍රී", "𝐀", "😀", "_"]
    texts = [None, "", *["".join(rng.choice(parts, size=n)) for n in rng.integers(1, 40, 400)], "- " * 50_000, "a " * 7 + "- " * 50_000, "x" * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for least in (0, 1, 3, 8):
        enough = T.counts_words(F.col("t"), least)
        assert not rows.where(enough.isNull() | (enough != (T.counted_words(F.col("t")) >= least))).count()
    plan = rows.select(gate(F.col("t"), F.lit("paragraph")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan

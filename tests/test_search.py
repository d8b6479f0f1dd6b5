import math
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import collection as C
from quern.operators import encoding as E
from quern.operators import search as S

CHUNKS = "chunk_id string, doc_id string, user_id string, text string, lesson_title string, lesson_number int, page_number int, block_type string, chunk_index int, source_file string, embedding array<double>"


def chunk(cid, user, text, title=None, page=None, vector=(1.0, 0.0), doc="d"):
    return (cid, doc, user, text, title, None, page, "text", 0, "s.pdf", list(vector) if vector is not None else None)


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([
        chunk("a", "u", "water cycle and rain", "Water", 1, (1.0, 0.0)),
        chunk("b", "u", "water cycle and rain again", "Water", 2, (0.9, 0.1)),
        chunk("c", "u", "fire and heat", "Fire", 3, (0.0, 1.0)),
        chunk("e", "u", "rain", None, None, (0.0, 0.0)),
        chunk("f", "v", "water cycle and rain", "Water", 1, (1.0, 0.0)),
        chunk("g", "u", "! !", "Fire", None, None),
        chunk("h", "u", None, None, None, (1.0, 1.0, 1.0)),
    ], CHUNKS)


QUERIES = "query_id string, user_id string, text string, embedding array<double>, titles array<string>, title_confidence double"


def test_sparse_scores(spark, chunks):
    asked = spark.createDataFrame([("q", "u", "Rain and water water"), ("none", "u", "?"), ("w", "w", "rain")], "query_id string, user_id string, text string")
    got = [(r.query_id, r.chunk_id, r.score) for r in S.sparse_topk(chunks, asked, 9).orderBy("rank").collect()]
    texts = {r.chunk_id: (r.user_id, re.findall("[a-z]+", r.text or "")) for r in chunks.collect()}
    df = Counter(t for _, ts in texts.values() for t in set(ts))
    sat = lambda c: c * 2.2 / (c + 1.2)
    want = {}
    for cid, (user, ts) in texts.items():
        score = sum(sat(ts.count(t)) * sat(n) * math.log(1 + (7 - df[t] + 0.5) / (df[t] + 0.5)) for t, n in {"rain": 1, "and": 1, "water": 2}.items() if t in ts)
        if user == "u" and score:
            want[cid] = round(score, 6)
    assert got == [("q", c, s) for c, s in sorted(want.items(), key=lambda x: (-x[1], x[0]))]


def test_dense_and_modes(spark, chunks):
    asked = spark.createDataFrame([("q", "u", "?", [2.0, 0.0]), ("zero", "u", "rain", [0.0, 0.0]), ("w", "w", "rain", [1.0, 0.0])], "query_id string, user_id string, text string, embedding array<double>")
    got = {(r.query_id, r.chunk_id): r for r in S.hybrid(chunks, asked, 2).collect()}
    assert set(got) == {("q", "a"), ("q", "b"), ("zero", "a"), ("zero", "b")}
    assert got["q", "a"].score == 1.0 and got["q", "a"].sparse_rank is None and got["zero", "b"].dense_rank is None
    both = S.hybrid(chunks, asked.withColumn("text", F.lit("fire")), 3).where("query_id = 'q'").orderBy("rank").collect()
    assert [(r.chunk_id, r.dense_rank, r.sparse_rank) for r in both] == [("c", 3, 1), ("a", 1, None), ("b", 2, None)]
    assert both[0].score == round(1 / 61 + 1 / 63, 6)


def test_weighted_fusion(spark):
    leg = lambda *ids: spark.createDataFrame([("q", c, k + 1) for k, c in enumerate(ids)], "query_id string, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in S.title_weighted(leg("x", "y"), leg("z", "x"), 5).collect()}
    assert got == {"x": round(0.8 / 61 + 0.2 / 62, 6), "y": round(0.8 / 62, 6), "z": round(0.2 / 61, 6)}


def test_diversify(spark):
    hits = [("q", "a", 9.0, 1, "aa bb cc dd"), ("q", "b", 8.0, 2, "aa bb cc dd ee"), ("q", "c", 7.0, 3, "- -"), ("q", "d", 6.0, 4, "aa bb xx"), ("q", "e", 5.0, 5, "zz"), ("r", "a", 1.0, 1, None)]
    rows = spark.createDataFrame(hits, "query_id string, chunk_id string, score double, rank int, text string")
    assert [(r.chunk_id, r["rank"]) for r in S.diversify(rows, 9).orderBy("rank").collect()] == [("a", 1), ("d", 2), ("e", 3)]
    assert S.diversify(rows, 2).count() == 2


def test_search_end_to_end(spark, chunks):
    asked = spark.createDataFrame([("q", "u", "water rain", [1.0, 0.0], ["Fire"], 0.75), ("low", "u", "water rain", [1.0, 0.0], ["Fire"], 0.74), ("no", "nobody", "water", [1.0, 0.0], [], None), ("empty", "v", "?", None, None, None)], QUERIES)
    hits, status = S.search(chunks, asked, limit=3)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got["q"][0] == "c" and set(got["q"]) == {"a", "c", "e"}  # b is like a
    assert got["low"][:2] == ["a", "e"] or got["low"][0] == "a"
    s = {r.query_id: r for r in status.collect()}
    assert s["no"].user_has_no_documents and s["no"].empty_reason == "no_documents" and s["no"].total_user_chunks == 0
    assert s["empty"].empty_reason == "no_matches" and s["empty"].total_user_chunks == 1
    assert s["q"].empty_reason is None and s["q"].total_user_chunks == 6
    only, _ = S.search(chunks, asked, limit=3, condition=C.payload_filter({"page_number": ["3", "x"]})[0])
    assert {(r.query_id, r.chunk_id) for r in only.collect()} == {("q", "c"), ("low", "c")}


def test_fetch_size():
    assert (S.fetch_size(10), S.fetch_size(1), S.fetch_size(10, 0.5)) == (30, 3, 10)


def test_filters(spark, chunks):
    condition, applied = C.payload_filter({"page_number": ["1", "zzz"], "lesson_title": ["", "Water"], "unknown": ["x"], "block_type": [""]})
    assert applied == ["lesson_title", "page_number"]
    assert {r.chunk_id for r in C.tenant(chunks, "u", ["d"]).where(condition).collect()} == {"a"}
    assert C.tenant(chunks, "u", []).count() == 6 and C.tenant(chunks, "u", ["other"]).count() == 0
    assert C.payload_filter({"page_number": ["zzz"]})[1] == ["page_number"] and chunks.where(C.payload_filter({"page_number": ["zzz"]})[0]).count() == 0
    assert C.sanitised({"user_id": ["x"], "doc_id": ["y"], "block_type": ["", "text"], "lesson_title": []}) == {"block_type": ["text"]}


def test_facets(spark, chunks):
    got = {(r.user_id, r.title): (r.chunk_count, r.total_chunks, r.lesson_index, r.truncated) for r in C.title_facet(chunks).collect()}
    assert got == {("u", "Fire"): (2, 4, 1, False), ("u", "Water"): (2, 4, 2, False), ("v", "Water"): (1, 1, 1, False)}
    assert {(r.title, r.truncated) for r in C.title_facet(chunks, most=1).collect()} == {("Fire", True), ("Water", False)}
    scan = {(r.user_id, r.title): (r.chunk_count, r.total_chunks, r.truncated) for r in C.title_scan(chunks, "chunk_id", most=3).collect()}
    assert scan == {("u", "Water"): (2, 3, True), ("u", "Fire"): (1, 3, True), ("v", "Water"): (1, 1, False)}


def test_gate_payload_and_upsert(spark):
    rows = [("one two three four five six seven eight", "text", None), ("one two three - - - - -", "text", "too_short"), ("x", "table", None), (" ", "table", "empty"), (None, "text", "empty"), ("x", None, "too_short")]
    df = spark.createDataFrame(rows, "t string, k string, want string").coalesce(1)
    assert all(r.x == r.want for r in df.select("want", C.gate(F.col("t"), F.col("k")).alias("x")).collect())
    c = spark.createDataFrame([("c", "d", "u", "t", None, 2, 0, 5, "text", "s", ["7 Heat"], {"table_id": "t1", "zz": "1"}), ("c2", "d", "u", "t", "Own", 2, 0, 5, "text", "s", [], None)], "chunk_id string, doc_id string, user_id string, text string, lesson_title string, page int, chunk_index int, token_count int, block_type string, source_name string, section_path array<string>, extra map<string,string>")
    got = {r.chunk_id: r for r in C.payload(c).collect()}
    assert (got["c"].lesson_title, got["c"].lesson_number, got["c"].extras) == ("Heat", 7, {"table_id": "t1"}) and got["c2"].lesson_title == "Own" and got["c2"].extras == {}
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = C.latest(spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, seq int"), ["k"], ["seq"]).drop("seq")
    assert {(r.k, r.v) for r in C.upsert(old, new, ["k"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_schema_checks(spark, chunks):
    with pytest.raises(ValueError, match="lacks"):
        C.checked(spark.createDataFrame([("a",)], "chunk_id string"))
    with pytest.raises(Exception, match="components"):
        C.checked(chunks, 2).select("embedding").collect()
    assert C.checked(chunks.where("chunk_id <> 'h'"), 2).select("embedding").count() == 6


def test_dense_hook(spark):
    rows = spark.createDataFrame([("ab",), (None,), ("",)], "text string").coalesce(1)
    model = lambda texts: np.array([[len(t), 0.0] for t in texts])
    assert [r.embedding for r in E.dense(rows, model, 2).collect()] == [[1.0, 0.0], None, [0.0, 0.0]]
    with pytest.raises(Exception, match="the model gave"):
        E.dense(rows, model, 3).collect()


def test_blocks_of_any_size_find_the_same(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (90, 3)).astype(float)  # many ties, and some zeros
    rows = spark.createDataFrame([(k, k % 2, [float(x) for x in v[k]]) for k in range(90)] + [(90, 0, None), (91, 0, [1.0, None, 2.0]), (92, 0, [1.0]), (93, None, [1.0, 1.0, 1.0])], "chunk_id int, user_id int, embedding array<double>")
    asked = rows.where("chunk_id % 9 = 0").withColumnRenamed("chunk_id", "query_id")
    unit = {k: v[k] / np.sqrt(v[k] @ v[k]) for k in range(90) if v[k].any()}
    want = {(q, c, s, n + 1) for q in unit if q % 9 == 0 for n, (s, c) in enumerate(sorted(((round(float(unit[q] @ unit[c]), 6) + 0.0, c) for c in unit if c % 2 == q % 2), key=lambda x: (-x[0], x[1]))[:4])}
    a, b = (r.select(c, "user_id", F.col("embedding").alias("v"), F.size("embedding").alias("kind"), F.size("embedding").alias("held")).where("forall(embedding, x -> x is not null) and exists(embedding, x -> x <> 0)") for r, c in ((asked, "query_id"), (rows, "chunk_id")))
    for most in (9, 30, 10_000):
        pairs = S.best_pairs(a, b, 4, lambda left, right: S._cosines(left, right, -np.inf), most, most)
        assert {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in S.top(pairs, 4).collect()} == want
    assert {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in S.dense_topk(rows, asked, 4).collect()} == want


def test_sparse_search_moves_no_pairs_of_postings(spark):
    texts = [" ".join(f"w{'abcdefghij'[(k * j) % 10]}" for j in range(1, 7)) for k in range(40)]
    rows = spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(texts)], "chunk_id int, user_id int, text string")
    asked = rows.where("chunk_id < 8").withColumnRenamed("chunk_id", "query_id")
    found = S.sparse_topk(rows, asked, 5)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().analyzed().toString()  # before: a join on terms
    sat = lambda c: c * 2.2 / (c + 1.2)
    counts = [Counter(t.split()) for t in texts]
    df = Counter(t for c in counts for t in c)
    score = lambda q, c: round(sum(sat(n) * sat(counts[c][t]) * math.log(1 + (40 - df[t] + 0.5) / (df[t] + 0.5)) for t, n in counts[q].items() if t in counts[c]), 6)
    want = {(q, c, s) for q in range(8) for s, c in sorted(((score(q, c), c) for c in range(40) if c % 2 == q % 2 and set(counts[q]) & set(counts[c])), key=lambda x: (-x[0], x[1]))[:5]}
    assert {(r.query_id, r.chunk_id, r.score) for r in found.collect()} == want


def lists(rng, n, size, words):
    """Ragged lists of distinct small numbers, low ones more often, and how many each list has."""
    rows = [np.unique((words * rng.random(rng.integers(0, size)) ** 3).astype(np.int64)) for _ in range(n)]
    return rows, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rows])), pa.int32()), pa.array(np.concatenate(rows)))


@pytest.mark.parametrize("most", [0, 5, 1024])
def test_term_sums_by_products_and_by_pairs(monkeypatch, most):
    monkeypatch.setattr(S, "DENSE_TERMS", most)
    rng = np.random.default_rng(5)
    asked, terms = lists(rng, 70, 60, 300)
    held, kept = lists(rng, 500, 90, 400)
    weights, counts = rng.random(len(terms.flatten())), rng.integers(1, 9, len(kept.flatten())).astype(np.int32)
    left = pa.table({"terms": terms, "weights": pa.ListArray.from_arrays(terms.offsets, pa.array(weights))})
    right = pa.table({"terms": kept, "counts": pa.ListArray.from_arrays(kept.offsets, pa.array(counts))})
    got = np.full((70, 500), -np.inf)
    for at, some in S.term_sums(left, right):
        got[at : at + len(some)] = some
    w, c = (np.split(x, np.cumsum([len(r) for r in rows])[:-1]) for x, rows in ((weights, asked), (counts, held)))
    for q in range(70):
        mine = dict(zip(asked[q].tolist(), w[q], strict=True))
        for k in range(500):
            parts = [mine[t] * n * 2.2 / (n + 1.2) for t, n in zip(held[k].tolist(), c[k].tolist(), strict=True) if t in mine]
            assert got[q, k] == (pytest.approx(sum(parts), abs=1e-9) if parts else -np.inf)


def test_more_queries_cost_less_than_their_share():
    rng = np.random.default_rng(6)
    (_, terms), (_, kept) = lists(rng, 1024, 300, 100_000), lists(rng, 2000, 600, 100_000)
    left = pa.table({"terms": terms, "weights": pa.ListArray.from_arrays(terms.offsets, pa.array(rng.random(len(terms.flatten()))))})
    right = pa.table({"terms": kept, "counts": pa.ListArray.from_arrays(kept.offsets, pa.array(np.ones(len(kept.flatten()), np.int32)))})

    def seconds(rows):
        began = time.perf_counter()
        for _ in S.term_sums(rows, right):
            pass
        return time.perf_counter() - began

    seconds(left.slice(0, 64))
    assert seconds(left) < 8 * min(seconds(left.slice(0, 64)) for _ in range(3))  # before: all of a chunk's terms for every 64 queries


def test_titles_are_a_key_of_the_same_postings(spark, chunks):
    asked = spark.createDataFrame([("q", "u", "water rain fire", [1.0, 0.0], ["Fire", "Water", None]), ("o", "v", "rain", [1.0, 0.0], ["Water"])], "query_id string, user_id string, text string, embedding array<double>, titles array<string>")
    prepared = S.within_titles(S.prepare(chunks, asked))
    assert "Join" not in prepared.postings._jdf.queryExecution().optimizedPlan().toString()  # before: postings were joined with their titles
    got = {(r.query_id, r.chunk_id) for r in S.hybrid(chunks, S.by_titles(asked), 9, prepared=prepared).collect()}
    assert got == {("q", "a"), ("q", "b"), ("q", "c"), ("o", "f")}


def test_hits_are_compared_by_the_terms_of_postings(spark, monkeypatch):
    rng = np.random.default_rng(7)
    texts = [None, "- -", *(" ".join(f"w{'abcdefghij'[k]}" for k in rng.permutation(10)[: rng.integers(1, 10)]) for _ in range(38))]
    rows = spark.createDataFrame([(f"c{k}", 0, t) for k, t in enumerate(texts)], "chunk_id string, user_id int, text string")
    hits = spark.createDataFrame([(q, f"c{c}", float(-n), n // 2 + 1) for q in range(30) for n, c in enumerate(rng.permutation(40)[:20].tolist())], "query_id int, chunk_id string, score double, rank int")
    want = {tuple(r) for r in S.diversify(hits.join(rows, "chunk_id"), 6).collect()}
    postings = S.term_lists(rows, "chunk_id")
    for most in (50, 10**6):
        monkeypatch.setattr(S, "HIT_TERMS", most)
        found = S.diverse(hits, postings, 6)
        assert {tuple(r) for r in found.collect()} == want
    assert S.diverse(hits.where("false"), postings, 6).count() == 0


def test_status_reads_the_collection_once(spark, chunks, tmp_path):
    chunks.write.parquet(f"{tmp_path}/collection")
    asked = spark.createDataFrame([("q", "u", "water rain", [1.0, 0.0])], "query_id string, user_id string, text string, embedding array<double>")
    _, status = S.search(spark.read.parquet(f"{tmp_path}/collection"), asked, limit=3)
    leaves = status._jdf.queryExecution().optimizedPlan().collectLeaves()
    paths = [leaves.apply(k).relation().location().rootPaths().toString() for k in range(leaves.size())]
    assert sum(p.endswith("/collection)") for p in paths) == 1  # for the hits' titles; before: to count as well
    assert status.first().total_user_chunks == 6

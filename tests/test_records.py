from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.operators import cache, identity, memory, practice, records

T0 = datetime(2024, 1, 1)


def test_keyset_pages_lose_nothing_on_ties(spark):
    rows = spark.createDataFrame([(f"i{k}", T0 + timedelta(minutes=k // 2)) for k in range(7)], "id string, at timestamp_ntz")
    seen, cursor = [], None
    for _ in range(5):
        page = records.keyset_page(rows, "at", "id", 3, cursor).collect()
        seen += [r.id for r in page]
        if not page or not page[0].more:
            break
        cursor = (page[-1].at, page[-1].id)
    assert seen == [f"i{k}" for k in range(6, -1, -1)]
    assert [r.id for r in records.keyset_page(rows, "at", "id", 2, ascending=True).collect()] == ["i5", "i6"]
    assert records.parse_cursor("x") is None is records.parse_cursor(None) and records.parse_cursor("2024-01-01T00:00:00") == T0


def test_messages(spark):
    rows = [("s", "assistant", 0, 0), ("s", "assistant", 2, 1), ("s", "user", 2, 2), ("s", "user", None, 3), ("t", "assistant", 1, 0)]
    got = records.normalise_messages(spark.createDataFrame(rows, "session string, role string, at int, i int"), "session", "at", "i").orderBy("place").collect()
    assert [(r.i, r.place) for r in got] == [(2, 1), (1, 2), (3, 3)]


def test_sessions_and_turns(spark):
    sessions = spark.createDataFrame([("s1", "u", "Old", ["d"])], "session_id string, user_id string, title string, doc_ids array<string>")
    asked = spark.createDataFrame([("r1", "s1", "u", "m", None), ("r2", "s1", "v", "m", None), ("r3", None, "u", "x" * 70, ["e"]), ("r4", "new", "u", "hello", None)], "request_id string, session_id string, user_id string, message string, doc_ids array<string>")
    got = {r.request_id: (r.action, r.title, r.doc_ids) for r in records.open_sessions(sessions, asked).collect()}
    assert got["r1"] == ("use", "Old", ["d"]) and got["r2"][0] == "not_found" and got["r3"] == ("insert", "x" * 60, ["e"]) and got["r4"][0] == "insert"
    turns = spark.createDataFrame([("s", "u", "q", "a", T0)], "session_id string, user_id string, question string, answer string, at timestamp_ntz")
    assert [(r.place, r.role, r.content) for r in records.turn_rows(turns).orderBy("place").collect()] == [(0, "user", "q"), (1, "assistant", "a")]
    messages = spark.createDataFrame([("s", 0, "user", "q", 1, None, 0), ("s", 1, "assistant", "", 5, "search", 1), ("s", 2, "assistant", "done", 7, None, 0), ("s", 3, "assistant", "tool", 1, "mark", 2)], "session string, i int, role string, text string, tokens int, tool string, calls int")
    assert records.final_reply(messages, "session", "i", "text", calls=F.col("calls")).first().reply == "done"
    s = records.turn_summary(messages, "session", "i").first()
    assert (s.replies, s.tokens, s.tools) == (3, 13, ["search", "mark"])
    assert records.owned(sessions, asked.where("request_id = 'r2'"), "session_id").count() == 0


def test_citations(spark):
    from quern.functions.text import citation_id

    cid = spark.range(1).select(citation_id(F.lit("demo-1")).alias("c")).first().c
    replies = spark.createDataFrame([("r", f"see [{cid}] and [C-0000000000] and {cid}"), ("n", None)], "k string, reply string")
    got = records.resolve_citations(replies, spark.createDataFrame([("r", "demo-1"), ("r", "other")], "k string, chunk_id string"), "k").orderBy("place").collect()
    assert [(r.citation, r.chunk_id, r.valid) for r in got] == [(cid, "demo-1", True), ("C-0000000000", None, False)]
    text = replies.where("k = 'r'").select(records.strip_citations(F.col("reply"), F.array(F.lit("C-0000000000"))).alias("x")).first().x
    assert text == f"see [{cid}] and  and {cid}"


QUESTION = "question:string,options:array<string>,correct_index:string,explanation:string,model_answer:string,rubric:array<struct<point:string,marks:string>>,source_pages:array<string>"


def question(text="Q", options=None, index=None, rubric=None, pages=None):
    return (text, options, index, " ", "model", rubric, pages)


def normalised(spark, qtype, questions):
    return {r.position: r for r in practice.normalise(spark.createDataFrame([(1, qtype, questions)], f"set_id int, qtype string, questions array<struct<{QUESTION}>>"), "set_id").collect()}


def test_choices(spark):
    two = ["a", " ", "b"]
    got = normalised(spark, "mcq", [question(" "), question(options=["a", " "], index="0"), question(options=two, index="1", pages=["3", "x", "-1"]), question(options=two, index="2"), question(options=two, index="-1"), question(options=two, index="x"), question(options=two)])
    assert list(got) == [2] and got[2].correct_index == 1 and [o.text for o in got[2].options] == ["a", "b"] and got[2].source_pages == [3] and got[2].explanation is None and got[2].rubric is None


@pytest.mark.parametrize(("marks", "want"), [(["5", "5"], [5, 5]), (["10.005"], [10.005]), (["3", "3", "3"], [3.3, 3.3, 3.3]), (["0"], [0]), (["9", "x"], [10]), (["1", "1", "1", "5"], [1.2, 1.2, 1.2, 6.2])])
def test_rubrics(spark, marks, want):
    got = normalised(spark, "essay", [question(rubric=[(f"p{i}", m) for i, m in enumerate(marks)]), question(rubric=[(" ", "1")]), question(rubric=[("p", None)])])
    assert [r.marks for r in got[0].rubric] == want and 1 not in got and [r.marks for r in got[2].rubric] == [0]


def test_marking(spark):
    answers = spark.createDataFrame([(1, 1, 10, None), (0, 1, 10, "why"), (None, 1, 10, None), (1, 1, None, None)], "selected_index int, correct_index int, max_marks int, explanation string").coalesce(1)
    got = practice.mark_choice(answers).collect()
    assert [(r.is_correct, r.marks and float(r.marks), r.reject_reason) for r in got] == [(True, 10.0, None), (False, 0, None), (None, None, "selected_index"), (True, 1.0, None)]
    assert got[1].feedback == "why"
    written = spark.createDataFrame([("text", [("a", 4.0), ("b", 6.0), ("c", 3.0)], [(9.0, "good"), (-1.0, None)], 10), (" ", [("a", 1.0)], None, 10)], "answer_text string, rubric array<struct<point:string,marks:double>>, judged array<struct<awarded_marks:double,feedback:string>>, max_marks int").coalesce(1)
    a, b = practice.mark_written(written).collect()
    assert [(r.awarded_marks, r.feedback) for r in a.rubric_results] == [(4.0, "good"), (0.0, ""), (0.0, "")] and float(a.marks) == 4.0 and b.reject_reason == "answer_text" and b.marks is None


def test_practice_view(spark):
    sets, qs = spark.createDataFrame([(1,)], "set_id int"), spark.createDataFrame([(1, 10, 2), (1, 11, 0)], "set_id int, question_id int, correct_index int")
    answers = spark.createDataFrame([(10, 5)], "question_id int, answer_id int")
    assert {r.question_id: r.correct_index for r in practice.practice_view(sets, qs, answers).collect()} == {10: 2, 11: None}


MEMORY = "memory_id string, user_id string, kind string, active boolean, rule_active boolean, updated_at int, scope string, instruction string, version int, embedding array<double>"


def test_memory(spark):
    rows = [(f"r{k}", "u", "procedural", True, k % 2 == 0, k, "s", "use short words always", 1, [1.0, k / 10]) for k in range(10)] + [("f", "u", "semantic", True, None, 0, None, None, 1, [-1.0, 0.0]), ("x", "v", "semantic", True, None, 0, None, None, 1, [1.0, 0.0])]
    stored = spark.createDataFrame(rows, MEMORY)
    asked = spark.createDataFrame([("q", "u", "text", [1.0, 0.0]), ("blank", "u", " ", [1.0, 0.0])], "query_id string, user_id string, text string, embedding array<double>")
    got = [(r.query_id, r.kind, r.memory_id, r.score) for r in memory.recall(stored, asked).collect()]
    assert ("q", "semantic", "f", 0.0) in got and sorted(m for q, k, m, _ in got if q == "blank") == ["r2", "r4", "r6", "r8"]
    new = spark.createDataFrame([("n1", "u", "s", "Use short words, always!", [1.0, 0.0]), ("n2", "u", "other", "use short words always", [1.0, 0.0]), ("n3", "u", "s", "one two three", [1.0, 0.0])], "new_id string, user_id string, scope string, instruction string, embedding array<double>")
    assert {r.new_id: (r.memory_id, r.version) for r in memory.merge_rules(stored.where("kind = 'procedural'"), new).collect()} == {"n1": ("r0", 2), "n2": (None, 1), "n3": (None, 1)}
    old = spark.createDataFrame([("a", 5, "x"), ("b", 1, "x")], "k string, version int, body string")
    put = memory.put(old, spark.createDataFrame([("a", 2, "y"), ("c", 1, "z")], "k string, version int, body string"), ["k"])
    assert {(r.k, r.version, r.body) for r in put.collect()} == {("a", 5, "y"), ("b", 1, "x"), ("c", 1, "z")}
    left, gone = memory.erase(stored, "u", "semantic")
    assert left.count() == 11 and gone.first().erased == 1
    texts = spark.createDataFrame([("f", "a fact"), ("r2", "a rule")], "memory_id string, text string")
    prompt = memory.render_recall(memory.recall(stored, asked).where("query_id = 'q'"), texts).first().prompt
    assert prompt == "Rules:\n- a rule\n\nFacts:\n- a fact"


@pytest.mark.parametrize(("message", "history", "want"), [("Hello!", False, "greeting"), ("what did I score", True, "personal"), ("explain more please", True, "followup"), ("what is osmosis?", True, "has_history"), ("why is it?", False, "too_short"), ("what is osmosis?", False, "cacheable"), (None, False, "too_short"), ("ආයුබෝවන්", False, "greeting")])
def test_request_policy(spark, message, history, want):
    row = spark.createDataFrame([(message, history)], "m string, h boolean")
    assert row.select(cache.request_policy(F.col("m"), F.col("h")).alias("x")).first().x == want


def test_cache(spark):
    rows = spark.createDataFrame([("a", None, False), ("a", ["remember_about_student"], False), (" ", None, False), ("a", None, True)], "a string, t array<string>, o boolean").coalesce(1)
    assert [r.x for r in rows.select(cache.response_policy(F.col("a"), F.col("t"), F.col("o")).alias("x")).collect()] == ["cacheable", "side_effects", "empty_answer", "empty_answer"]
    entries = spark.createDataFrame([(f"e{k}", "s", "t", k, [1.0, 0.01 * k]) for k in range(5)] + [("o", "other", "t", 9, [1.0, 0.0])], "entry_id string, scope string, field string, stored_at int, embedding array<double>")
    asked = spark.createDataFrame([("hit", "s", [1.0, 0.02]), ("miss", "s", [0.0, 1.0]), ("zero", "s", [0.0, 0.0])], "query_id string, scope string, embedding array<double>")
    assert [(r.query_id, r.entry_id, r.similarity) for r in cache.lookup(entries, asked).collect()] == [("hit", "e2", 1.0)]
    assert sorted(r.entry_id for r in cache.evict(entries, 2).collect()) == ["e3", "e4", "o"]
    bumps = spark.createDataFrame([("u", "documents"), ("u", "documents"), ("u", "memory")], "user_id string, what string")
    assert {r.user_id: (r.doc_generation, r.memory_generation) for r in cache.generations(bumps, spark.createDataFrame([("u",), ("w",)], "user_id string")).collect()} == {"u": (2, 1), "w": (0, 0)}


def test_tokens_and_health(spark):
    tokens = spark.createDataFrame([("t1", "f1", "u", False, 100), ("t2", "f2", "u", True, 100), ("t3", "f3", "u", False, 1)], "token_hash string, family_id string, user_id string, revoked boolean, expires_at int")
    shown = spark.createDataFrame([("t1", "n1", 50), ("t2", "n2", 50), ("t3", "n3", 50), ("t9", "n9", 50)], "token_hash string, successor string, now int")
    after, outcome = identity.rotate(tokens, shown)
    assert {r.token_hash: r.outcome for r in outcome.collect()} == {"t1": "rotated", "t2": "reuse", "t3": "expired", "t9": "unknown"}
    assert {(r.token_hash, r.family_id, r.revoked, r.expires_at) for r in after.collect()} == {("t1", "f1", True, 100), ("n1", "f1", False, 100), ("t2", "f2", True, 100), ("t3", "f3", False, 1)}
    assert {r.token_hash for r in identity.revoke(after, spark.createDataFrame([("f1",)], "family_id string")).where("revoked").collect()} == {"t1", "n1", "t2"}
    assert identity.live(tokens, 50).count() == 2
    parts = spark.createDataFrame([("s", "healthy", True, False), ("s", "failed", False, False), ("t", "degraded", True, False), ("w", "healthy", None, True)], "svc string, state string, required boolean, draining boolean")
    assert {r.svc: (r.ready, r.alive) for r in identity.readiness(parts, "svc").collect()} == {"s": (True, True), "t": (False, True), "w": (False, True)}


def test_cache_passes_over_the_entry_it_must_not_find(spark):
    entries = spark.createDataFrame([("a", "s", [1.0, 0.0]), ("b", "s", [1.0, 0.1]), ("c", "s", [1.0, 0.1]), ("d", "t", [1.0, 0.0])], "entry_id string, scope string, embedding array<double>")
    asked = entries.select(F.col("entry_id").alias("query_id"), "scope", "embedding")
    got = {r.query_id: (r.entry_id, r.similarity) for r in cache.lookup(entries, asked, without="query_id").collect()}
    assert got == {"a": ("b", 0.995037), "b": ("c", 1.0), "c": ("b", 1.0)}

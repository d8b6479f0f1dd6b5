"""Accounts, sessions, saved sets and memories: nulls, strangers, repeated rows and empty tables."""

from datetime import datetime

from pyspark.sql import functions as F

from quern.operators import collection, identity, memory, practice, records
from quern.sources import objects


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_accounts(spark):
    users = spark.createDataFrame([(1, "a@x", True), (2, "b@x", False)], "user_id int, email string, has_password boolean")
    accounts = spark.createDataFrame([("p", "s1", 1), ("p", "s9", 9)], "provider string, subject string, user_id int")
    asked = spark.createDataFrame([(1, "p", "s1", None), (2, "p", "s2", " B@x "), (3, "p", "s3", "A@x"), (4, "p", "s9", "b@x"), (5, "q", "s1", "c@x"), (6, None, None, None)], "request_id int, provider string, subject string, email string")
    found = rows(identity.user_of_account(asked, accounts, users), "request_id", "outcome", "user_id")
    assert found == [(1, "known", 1), (2, "linked", 2), (3, "has_password", None), (4, "missing_user", None), (5, "new", None), (6, "new", None)]
    assert rows(identity.user_of_account(asked, accounts, users, link=True).where("request_id = 3"), "outcome", "user_id") == [("linked", 1)]
    assert identity.user_of_account(asked.limit(0), accounts, users).count() == 0


def test_tokens(spark):
    tokens = spark.createDataFrame([("t1", 1, 7, False, 5), ("t2", 1, 8, False, 20), ("t3", 2, 7, True, None)], "token_hash string, family_id int, user_id int, revoked boolean, expires_at int")
    assert rows(identity.revoke(tokens, tokens.where("token_hash = 't1'"), "token_hash"), "token_hash", "revoked") == [("t1", True), ("t2", False), ("t3", True)]
    assert rows(identity.revoke(tokens, tokens.where("user_id = 8"), "user_id"), "token_hash", "revoked") == [("t1", False), ("t2", True), ("t3", True)]
    live, gone = identity.purge(tokens, 10)
    assert rows(live, "token_hash") == [("t2",)] and gone.first().purged == 1
    users = spark.createDataFrame([(7, "x")], "user_id int, name string")
    assert rows(identity.user_of_token(tokens, tokens, users), "token_hash", "name") == [("t1", "x"), ("t3", "x")]


def test_sessions(spark):
    t = datetime(2024, 5, 1, 10, 0, 0)
    sessions = spark.createDataFrame([(1, 7, "a", None, t), (2, 8, "b", [3], None)], "session_id int, user_id int, title string, doc_ids array<int>, last_message_at timestamp")
    turns = spark.createDataFrame([(1, 7, datetime(2024, 4, 1)), (2, 8, datetime(2024, 6, 1, 0, 0, 0, 5)), (1, 9, datetime(2025, 1, 1))], "session_id int, user_id int, at timestamp")
    found = records.session_rows(records.moved_on(sessions, turns)).collect()
    assert sorted((r.session_id, r.doc_ids, r.last_message_at) for r in found) == [("1", [], "2024-05-01T10:00:00"), ("2", ["3"], "2024-06-01T00:00:00.000005")]


def test_message_page(spark):
    messages = spark.range(1, 151).select(F.col("id").alias("message_id"), (F.col("id") % 3).alias("created_at"))
    assert [r.message_id for r in records.message_page(messages, 0).collect()] == [149]
    assert records.message_page(messages).count() == 30 and records.message_page(messages, 1000).count() == 100
    assert [r.message_id for r in records.newest_first(messages.where("message_id < 6"), "created_at", "message_id").collect()] == [5, 2, 4, 1, 3]


def test_saved_sets(spark):
    sets = spark.createDataFrame([(1, 1, 7), (2, 1, 8), (3, None, 7)], "set_id int, session_id int, user_id int")
    sessions = spark.createDataFrame([(1, 7), (1, 7)], "session_id int, user_id int")
    questions = spark.createDataFrame([(1, 5, "mcq"), (1, 9, "essay"), (2, 1, "mcq"), (3, 1, "mcq")], "set_id int, seq int, qtype string")
    assert rows(practice.saved(sets, questions, sessions), "set_id", "position", "qtype", "user_id") == [(1, 1, "mcq", 7), (1, 2, "mcq", 7)]


def test_memories_alike(spark):
    columns = "memory_id string, user_id int, kind string, content_hash string, version int, text string"
    stored = spark.createDataFrame([("a", 1, "semantic", "h", 4, "old"), ("b", 1, "semantic", "h", 1, "twin")], columns)
    new = spark.createDataFrame([("n", 1, "semantic", "h", 2, "new"), ("b", 2, "semantic", "z", 9, "own"), ("m", 2, "semantic", "h", 1, "other")], columns)
    assert rows(memory.put(stored, memory.alike(stored, new), ["memory_id"]), "memory_id", "version", "text") == [("a", 4, "new"), ("b", 9, "own"), ("m", 1, "other")]
    assert memory.put(stored.limit(0), memory.alike(stored.limit(0), new), ["memory_id"]).count() == 3


def test_memory_rows(spark):
    said = spark.createDataFrame([(1, "So it is"), (1, "so, it IS!"), (2, None)], "user_id int, content string")
    found = memory.facts(said).collect()
    assert found[0].content_hash == found[1].content_hash != found[2].content_hash and {r.kind for r in found} == {"semantic"}
    seen = spark.createDataFrame([(1, "s", "a", "o", None)], "user_id int, situation string, action string, outcome string, lesson string")
    assert memory.episodes(seen).first().searchable_text == "s\na\no\n"


def test_keys_and_filters(spark):
    key = objects.image_key(F.lit("u"), F.lit("d"), F.lit("i"), F.lit(".png"))
    assert spark.range(1).select(key.alias("k")).first().k == "u/d/images/i.png"
    assert collection.ignored({"x": ["1"], "chunk_id": ["2"], "a": []}, ["chunk_id"]) == ["a", "x"]
    assert collection.ignored(None, []) == []

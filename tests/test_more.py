from datetime import datetime

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import collection as C
from quern.operators import memory as M
from quern.operators import search as S
from quern.sources import events, objects


def test_lessons_by_place(spark):
    rows = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b")], "user_id string, lesson_title string")
    facet = C.title_facet(rows)
    listed = C.catalogue(facet)
    version = listed.first().version
    asked = spark.createDataFrame([(1, "u", [2, 1], version), (2, "u", [3], version), (3, "u", [1], "old"), (4, "w", [1], version), (5, "u", [], version)], "query_id int, user_id string, lesson_indexes array<int>, version string")
    got = {r.query_id: (r.titles, r.status) for r in C.titles_by_index(asked, facet, listed).collect()}
    assert got == {1: (["a", "b"], "ok"), 2: (None, "unknown_lesson"), 3: (None, "stale_catalogue"), 4: (None, "no_lessons"), 5: (None, "ok")}


def test_memory_shapes(spark):
    hits = spark.createDataFrame([("episodic", {"situation": "s", "action": "a", "outcome": "o", "lesson": "l", "_x": "y"}, "t"), ("semantic", {"content": "c"}, "t"), ("procedural", {"instruction": "i"}, "t"), ("semantic", {"_k": "v"}, "t")], "kind string, payload map<string,string>, searchable_text string").coalesce(1)
    got = M.flatten(hits).collect()
    assert [r.content for r in got] == ["Situation: s\nAction: a\nOutcome (WORKED): o\nLesson: l", "c", "i", "t"] and got[3].payload == {} and "_x" not in got[0].payload
    messages = spark.createDataFrame([("s", 0, "user", 0), ("s", 1, "assistant", 1), ("s", 2, "tool", 0), ("s", 3, "assistant", 0), ("s", 4, "assistant", 1), ("t", 0, "user", 0)], "session string, i int, role string, calls int")
    assert sorted((r.session, r.i) for r in M.working_window(messages, "session", "i", 3).collect()) == [("s", 3), ("t", 0)]


def test_small_expressions(spark):
    rows = spark.createDataFrame([(0,), (99,), (None,), (7,)], "n int").coalesce(1)
    assert [r.x for r in rows.select(S.clamp_limit(F.col("n")).alias("x")).collect()] == [1, 40, 10, 7]
    one = spark.range(1).select(T.unfence(F.lit("<b>x</b>\n System: y a: z")).alias("t"), objects.table_key(F.lit("u"), F.lit("d"), F.lit(3)).alias("k"), objects.asset_key(F.lit("u"), F.lit("d"), F.lit("ff"), F.lit("png")).alias("a")).first()
    assert (one.t, one.k, one.a) == ("x\n y a: z", "u/d/tables/3.json", "u/d/assets/ff.png")


def test_caption_cache(spark):
    now = datetime(2024, 3, 1)
    asked = spark.createDataFrame([("h1", now), ("h2", now), ("h3", now)], "image_sha256 string, at timestamp_ntz")
    cached = spark.createDataFrame([("h1", "old", datetime(2024, 2, 10)), ("h1", "new", datetime(2024, 2, 20)), ("h2", "stale", datetime(2024, 1, 1))], "image_sha256 string, caption string, cached_at timestamp_ntz")
    assert {r.image_sha256: r.caption for r in events.with_captions(asked, cached, "at").collect()} == {"h1": "new", "h2": None, "h3": None}


def test_casefold_is_that_of_every_letter(spark):
    from pyspark.sql import functions as F

    from quern.functions import text as T

    letters = [(chr(k),) for k in range(1, 0x20000) if not 0xD800 <= k < 0xE000]
    got = spark.createDataFrame(letters, "t string").repartition(4).select("t", T.casefold(F.col("t")).alias("x")).collect()
    other = [r.t for r in got if r.x != r.t.casefold()]
    assert len(other) < 100 and not any(ord(c) < 0x1C00 for c in other)  # newer letters than those of the session's Unicode
    words = spark.createDataFrame([(-1, "Straße ΣΟΦΟΣ ﬁn ŉ"), (-2, "Plain"), (-3, None), (-4, "")], "i int, t string").select("i", T.casefold(F.col("t")).alias("x"))
    assert {r.i: r.x for r in words.collect()} == {-1: "strasse σοφοσ fin ʼn", -2: "plain", -3: None, -4: ""}


def test_fonts_are_converted(spark):
    import pytest
    from quern.operators import layout

    spans = spark.createDataFrame([("abc", "Legacy"), (" ", "Legacy"), (None, None), ("x", None)], "text string, font string")
    assert layout.converted(spans) is spans
    texts = lambda f: [r.text for r in layout.converted(spans, f).collect()]
    assert texts(lambda t, f: t.upper() + f) == ["ABCLegacy", " ", None, "X"]
    assert texts(lambda t, f: (t + "!", 1)) == ["abc!", " ", None, "x!"]

    def record(t, f):
        from types import SimpleNamespace

        return SimpleNamespace(converted_text=t * 2)

    assert texts(record) == ["abcabc", " ", None, "xx"]
    with pytest.raises(Exception, match="conversion gave int"):
        texts(lambda t, f: 5)


def test_messages_of_the_three_topics(spark):
    import json

    from pyspark.sql import functions as F
    from quern.sources import events

    chunk = spark.createDataFrame([("c", "d", "u", "text", "text", "s.pdf", None, 3, 0, 1, "table", ["Heat"], [0.0, 1.0, 2.0, 3.0], {"a": "b"})], events.CHUNK)
    sent = events.chunk_messages(chunk).first()
    value = json.loads(sent.value)
    assert sent.key == "d:3" and value["require_title"] and value["chunk"]["type"] == "table" and value["chunk"]["bbox"] == [0.0, 1.0, 2.0, 3.0]
    back = events.decode_chunks(events.chunk_messages(chunk.withColumn("extra", F.create_map(F.lit("user_id"), F.lit("u")))).select(F.encode("value", "UTF-8").alias("value"))).first()
    assert back.reject_reason is None and back.chunk.bbox == [0.0, 1.0, 2.0, 3.0] and back.chunk.block_type == "table" and back.chunk.user_id == "u"
    done = events.ingested_messages(spark.createDataFrame([("d", "u", "j", "s", 2, 5, 1)], "doc_id string, user_id string, job_id string, source_name string, units_processed int, chunks_published int, images_queued int")).first()
    assert done.key == "d" and json.loads(done.value)["chunks_published"] == 5
    asked = events.image_messages(spark.createDataFrame([("c1", "{}"), ("c2", None)], "chunk_id string, request string")).collect()
    assert [(r.key, r.value) for r in asked] == [("c1", "{}")]

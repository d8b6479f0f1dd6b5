"""A model's JSON as memories: good, broken and half-broken objects."""

import json

import pytest

from quern.operators import consolidate

GOOD = {"episode": {"situation": "s", "action": "a", "outcome": "o", "extra": 1}, "rules": [{"instruction": "Be brief", "scope": "quiz", "version": 3, "active": False}], "facts": [{"content": "Likes maps", "category": "preference", "confidence": 0.25, "source": "stated"}, {"content": "Text confidence", "confidence": "0.5"}]}


@pytest.fixture()
def rows(spark):
    def of(*replies):
        df = spark.createDataFrame([(i, "about", r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(replies)], "id int, topic string, reply string")
        return sorted(consolidate.consolidated(df, subject="topic").collect(), key=lambda r: (r.id, r.kind, r.place))

    return of


def test_good_replies(rows):
    e, r, f, g = sorted(rows(GOOD), key=lambda r: ("episodic", "procedural", "semantic").index(r.kind))
    assert (e.searchable_text, e.success, e.subject, e.payload) == ("s\na\no\n", True, "about", {"situation": "s", "action": "a", "outcome": "o", "lesson": "", "success": "true", "subject": "about"})
    assert (r.searchable_text, r.scope, r.version, r.active, r.confidence) == ("Be brief", "quiz", 3, False, None)
    assert (f.searchable_text, f.category, f.confidence, f.source) == ("Likes maps", "preference", 0.25, "stated")
    assert (g.category, g.confidence, g.source, g.place) == ("fact", 0.5, "inferred", 1) and g.payload["confidence"] == "0.5"
    fenced = rows("Here it is:\n```json\n" + json.dumps({"episode": {**GOOD["episode"], "subject": "own", "success": "no"}}) + "\n```")
    assert [(x.subject, x.success) for x in fenced] == [("own", False)]


@pytest.mark.parametrize("bad", [{"content": 5}, {"content": None}, {}, [], "text", 1, None, {"content": "x", "category": "other"}, {"content": "x", "confidence": 1.01}, {"content": "x", "confidence": None}, {"content": "x", "confidence": "much"}, {"content": "x", "source": "guessed"}, {"content": "x", "subject": 3}])
def test_malformed_facts_are_left_out_alone(rows, bad):
    assert [r.searchable_text for r in rows({"facts": [{"content": "before"}, bad, {"content": "after"}]})] == ["before", "after"]


def test_other_malformed_items(rows):
    episode = {"situation": "s", "action": "a", "outcome": "o"}
    bad = [{**episode, "outcome": 1}, {k: v for k, v in episode.items() if k != "action"}, {**episode, "success": "maybe"}, {**episode, "lesson": None}, "none", [], {}, None, 0]
    assert rows(*({"episode": b} for b in bad)) == []
    rules = [{"instruction": "x", "scope": "all"}, {"scope": "quiz"}, {"instruction": "x", "version": "three"}, {"instruction": "x", "active": []}, {"instruction": ["x"]}]
    assert [r.place for r in rows({"rules": [*rules, {"instruction": "kept"}], "facts": None})] == [5]
    assert rows(None, "", "no json", "[1]", "{", {"facts": {"content": "x"}, "rules": "none"}, {}) == []


def test_stated_facts(spark):
    got = consolidate.stated_fact(spark.createDataFrame([("u", "Sits an exam", "goal"), ("u", None, "goal"), ("u", "x", "odd")], "user_id string, content string, category string")).collect()
    assert [(r.searchable_text, r.confidence, r.source, r.payload["category"]) for r in got] == [("Sits an exam", 1.0, "stated", "goal")]

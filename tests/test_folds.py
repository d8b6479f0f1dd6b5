"""Folds cut into slices equal the plain fold, whatever the slices."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.streaming import folds, limiters

T0 = datetime(2024, 1, 1)
RULES = {"lockout": folds.Lockout(3, 10_000_000), "one strike": folds.Lockout(1, 4_000_000), "breaker": folds.Breaker(3, 10_000_000), "touchy": folds.Breaker(1, 3_000_000), "guard": folds.MinuteGuard(4, 90_000_000), "short guard": folds.MinuteGuard(3, 7_000_000), "attempts": folds.Attempts(3)}


def plain(rule, rows):
    now, out = (0, 0), []
    rule.begin()
    for t, ok in rows:
        now, said = rule.step(now, t, ok)
        out.append(said)
    return out, now


@pytest.mark.parametrize("name", RULES)
def test_a_slice_as_a_function(name):
    rule, rng = RULES[name], random.Random(3)
    for _ in range(400):
        times = sorted(rng.randrange(200_000_000) for _ in range(rng.randrange(2, 40)))
        rows = [(t, rng.random() < rng.choice([0.1, 0.6])) for t in times]
        cuts = sorted(rng.sample(range(1, len(rows)), min(3, len(rows) - 1)))
        if rule.cut == ("m",):  # slices of whole minutes
            cuts = [p for p in cuts if rows[p - 1][0] // 60_000_000 != rows[p][0] // 60_000_000]
        want, _ = plain(rule, rows)
        now, got = (0, 0), []
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            part, before = rows[a:b], now
            rule.begin()
            for t, ok in part:
                before, said = rule.step(before, t, ok)
                got.append(said)
            now = rule.after(rule.ends([t for t, _ in part], [ok for _, ok in part]), now)
        assert got == want
        assert [rule.step(now, times[-1] + d, False)[1] for d in (1, 8_000_000) if rule.cut != ("m",)] == [rule.step(before, times[-1] + d, False)[1] for d in (1, 8_000_000) if rule.cut != ("m",)]


@pytest.mark.parametrize("name", RULES)
def test_a_busy_key_is_spread_and_equals_the_plain_fold(spark, name):
    rng = random.Random(7)
    rows = [("busy" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(4000), rng.choice([True, False, False])) for _ in range(700)]
    rows += [(None, 1, True), ("a", None, True), ("b", 5, None)]
    log = spark.createDataFrame([(i, k, None if s is None else T0 + timedelta(seconds=s), ok) for i, (k, s, ok) in enumerate(rows)], "id int, k string, at timestamp_ntz, ok boolean")
    rule = RULES[name]
    want = {}
    for key in ("busy", "a", "b", "c"):
        mine = sorted((int((T0 - datetime(1970, 1, 1)).total_seconds() + s) * 1_000_000, i, bool(ok)) for i, (k, s, ok) in enumerate(rows) if k == key and s is not None)
        want |= dict(zip([i for _, i, _ in mine], plain(rule, [(t, ok) for t, _, ok in mine])[0], strict=True))
    got = folds.folded(log, "k", limiters.micros(F.col("at")), "id", "ok", rule, slice_rows=60)
    assert {r.id: r.label for r in got.collect()} == want
    assert folds.folded(log.limit(0), "k", limiters.micros(F.col("at")), "id", "ok", rule).count() == 0


def test_minute_guard_denies_while_open(spark):
    rows = [(0, True), (1, False), (2, True), (90, True), (91, True), (92, True), (93, True), (94, True), (120, False), (150, True), (211, True)]
    log = spark.createDataFrame([(i, "k", T0 + timedelta(seconds=s), ok) for i, (s, ok) in enumerate(rows)], "id int, k string, at timestamp_ntz, ok boolean")
    got = [r.decision for r in limiters.minute_guard(log, "k", "at", "id", "ok", 4, 90).orderBy("id").collect()]
    # Opened at 1 until 91, so the minute from 60 has counted nothing before; opened anew at 120 until 210.
    assert got == ["allowed", "allowed", "open", "open", "allowed", "allowed", "allowed", "allowed", "allowed", "open", "allowed"]

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quern.streaming import ingest, jobs, limiters

T0 = datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(i, k, T0 + timedelta(seconds=s), ok) for i, (k, s, ok) in enumerate(rows)], "id int, k string, at timestamp_ntz, ok boolean")


def test_fixed_minute(spark):
    rows = log(spark, [("a", 0, None), ("a", 59, None), ("a", 59, None), ("a", 60, None), ("b", 1, None)])
    assert {r.id: r.allowed for r in limiters.fixed_minute(rows, "k", "at", "id", 2).collect()} == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_idle_reset_equals_a_plain_count(spark):
    rng = random.Random(5)
    rows = [(k, s, None) for k in ("a", "b", None) for s in sorted(rng.choices(range(3000), k=60))]
    rows += [("c", s, None) for s in (0, 9, 19, 28, 38)]
    want, last, n = {}, {}, {}
    for i, (k, s, _) in enumerate(rows):
        n[k] = n[k] + 1 if k in last and s - last[k] < 10 else 1
        last[k] = s
        want[i] = n[k]
    for piece in (7, 25, 100_000):
        got = {r.id: r.nth for r in limiters.idle_reset(log(spark, rows), "k", "at", "id", 3, 10, piece).collect()}
        assert got == want


def test_lockout(spark):
    rows = [("a", s, False) for s in range(3)] + [("a", 5, True), ("a", 11, False), ("a", 12.5, True), ("b", 0, False), ("b", 1, True), ("b", 2, False), ("b", 3, False), ("b", 4, True)]
    got = {r.id: r.locked for r in limiters.lockout(log(spark, rows), "k", "at", "id", "ok", 3, 10).collect()}
    # Locked at 5 and 11; attempts met by a lock don't extend it, so at 12.5 it is over.
    assert [got[i] for i in range(11)] == [False, False, False, True, True, False, False, False, False, False, False]


def test_breaker(spark):
    rows = [("a", 0, False), ("a", 1, False), ("a", 2, True), ("a", 11.5, False), ("a", 12, True), ("a", 22, True), ("a", 23, False)]
    got = [r.state for r in limiters.breaker(log(spark, rows), "k", "at", "id", "ok", 2, 10).orderBy("id").collect()]
    assert got == ["closed", "closed", "open", "half_open", "open", "half_open", "closed"]


def test_jobs(spark):
    rows = [("j", 1, "begin", None, None, None), ("j", 2, "progress", 3, 5, None), ("j", 3, "fail", None, None, "x" * 2000), ("j", 4, "begin", None, None, None), ("k", 1, "begin", None, None, None), ("k", 2, "progress", 1, 1, None), ("k", 3, "complete", 2, 4, None), ("f", 1, "fail", None, None, "bad"), ("z", 1, "noise", None, None, None)]
    state = jobs.fold_jobs(spark.createDataFrame(rows, "job_id string, seq int, kind string, units int, chunks int, error string"))
    got = {r.job_id: r for r in state.collect()}
    assert set(got) == {"j", "k", "f"} and (got["j"].status, got["j"].attempts, got["j"].units_processed, got["j"].error) == ("downloading", 2, 3, None)
    assert (got["k"].status, got["k"].chunks_published) == ("completed", 4) and got["f"].error == "bad"
    asked = spark.createDataFrame([("k",), ("none",)], "job_id string")
    assert {r.job_id: (r.found, r.attempts) for r in jobs.lookup(state, asked).collect()} == {"k": (True, 1), "none": (False, 0)}
    assert [r.job_id for r in jobs.unfinished(spark.createDataFrame([("j",), ("k",), (None,)], "job_id string"), state).orderBy("job_id").collect()] == [None, "j"]


def test_offsets_and_retries(spark):
    rows = spark.createDataFrame([("t", 0, 5, 9), ("t", 0, 7, 12), ("t", 1, 3, 3)], "topic string, partition int, offset bigint, high_watermark bigint")
    assert {(r.partition, r.first_offset, r.commit_offset) for r in jobs.offsets(rows).collect()} == {(0, 5, 8), (1, 3, 4)}
    assert {(r.partition, r.lag) for r in jobs.lag(rows).collect()} == {(0, 3), (1, 0)}
    batches = spark.createDataFrame([(1, False), (2, True), (3, True), (3, False), (40, False)], "attempts int, dead_letters_delivered boolean").coalesce(1)
    assert [(r.action, r.wait_s) for r in jobs.retry(batches).collect()] == [("seek", 2), ("seek", 4), ("dead_letter", 0), ("seek", 8), ("seek", 30)]


def message(offset, chunk_id, text, **more):
    return (None, json.dumps({"chunk": {"chunk_id": chunk_id, "doc_id": "d", "user_id": "u", "text": text, **more}}).encode(), "chunks", 0, offset)


LONG = "one two three four five six seven eight"
MESSAGES = "key binary, value binary, topic string, partition int, offset bigint"


def test_ingest_stream(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    assert ingest.collection(spark, path) is None
    spark.createDataFrame([message(0, "a", LONG), message(1, "a", LONG + " nine"), message(2, "b", "short"), (b"k", b"bad", "chunks", 0, 3)], MESSAGES).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(MESSAGES).parquet(source)
    ingest.start(stream(), path, checkpoint).awaitTermination()
    spark.createDataFrame([message(4, "a", LONG + " ten"), message(5, "c", LONG), message(6, "t", "x", block_type="table")], MESSAGES).coalesce(1).write.mode("append").parquet(source)
    ingest.start(stream(), path, checkpoint).awaitTermination()
    rows = {r.chunk_id: r.text for r in ingest.collection(spark, path).collect()}
    assert rows == {"a": LONG + " ten", "c": LONG, "t": "x"}
    dead = spark.read.parquet(f"{path}/dead_letters").collect()
    assert [(bytes(r.key), r.dlq_reason, r.offset) for r in dead] == [(b"k", "decode:json", 3)]
    ingest.sink(path)(spark.read.parquet(source).where("offset >= 4"), 1)  # the second batch again
    assert ingest.collection(spark, path).count() == 3
    ingest.compact(spark, path, str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 3


def test_lockout_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    log(spark, [("a", s, False) for s in range(3)] + [("b", 0, True)]).coalesce(1).write.parquet(source)
    rows = spark.readStream.schema("id int, k string, at timestamp_ntz, ok boolean").parquet(source)
    query = limiters.lockout_stream(rows, "k", "at", "ok", 2, 10).writeStream.format("memory").queryName("locks").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.k, r.attempts, r.locked, r.failures) for r in spark.table("locks").where(F.col("k").isNotNull()).collect()} == {("a", 3, 1, 2), ("b", 1, 0, 0)}

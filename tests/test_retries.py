"""Poisoned batches and documents: attempts, waits, dead letters, and what stays of the rest."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quern.streaming import ingest, retries

MESSAGES = "key binary, value binary, topic string, partition int, offset bigint"
LONG = "one two three four five six seven eight"


def chunk(offset, text=LONG, partition=0):
    return (None, json.dumps({"chunk": {"chunk_id": f"c{offset}", "doc_id": "d", "user_id": "u", "text": text}}).encode(), "chunks", partition, offset)


class Poison(RuntimeError):
    pass


def fails_on(word, path):
    """The collection's sink, which a batch that holds ``word`` breaks."""
    write = ingest.sink(path)

    def run(batch, batch_id):
        write(batch, batch_id)
        if batch.where(F.col("value").cast("string").contains(word)).count():
            raise Poison(word)

    return run


def stream(spark, source, checkpoint, write):
    rows = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    return lambda: rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def test_a_poisoned_batch_is_tried_three_times_and_then_refused(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in ([chunk(0), chunk(10, partition=1)], [chunk(1, LONG + " poison"), chunk(11, partition=1)], [chunk(2)]):
        spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(source)
    waits = []
    starts = retries.supervised(spark, path, stream(spark, source, checkpoint, retries.retried(path, fails_on("poison", path))), waits.append)
    assert (starts, waits) == (3, [2, 4])
    story = [(r.batch, r.turn, r.partition, r.first_offset, r.commit_offset, r.attempt, r.outcome, r.error, r.wait_s) for r in retries.ledger(spark, path).orderBy("batch", "turn", "partition").collect()]
    assert story[:2] == [(0, 1, 0, 0, 1, 1, "stored", None, 0), (0, 1, 1, 10, 11, 1, "stored", None, 0)]
    assert [x for x in story if x[0] == 1 and x[2] == 1] == [(1, n, 1, 11, 12, n, o, "ingest:Poison", w) for n, o, w in ((1, "failed", 2), (2, "failed", 4), (3, "dead_letters", 0))]
    assert story[-1] == (2, 1, 0, 2, 3, 1, "stored", None, 0)
    dead = spark.read.parquet(f"{path}/refused")
    assert {(r.offset, r.dlq_reason) for r in dead.collect()} == {(1, "ingest:Poison"), (11, "ingest:Poison")} and dead.where("key is null and length(value) > 20").count() == 2
    assert {r.outcome for r in retries.standing(retries.ledger(spark, path)).collect()} == {"stored", "dead_letters"}


def test_a_batch_that_recovers_is_stored_once(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([chunk(0), chunk(1)], MESSAGES).coalesce(1).write.parquet(source)
    left = [1]

    def flaky(batch, batch_id):
        ingest.sink(path)(batch, batch_id)
        if left:
            left.pop()
            raise OSError("away")

    assert retries.supervised(spark, path, stream(spark, source, checkpoint, retries.retried(path, flaky)), lambda s: None) == 2
    assert ingest.collection(spark, path).count() == 2
    assert [(r.attempt, r.outcome) for r in retries.ledger(spark, path).orderBy("turn").collect()] == [(1, "failed"), (2, "stored")]


def test_dead_letters_that_cannot_be_written_are_sought_again(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([chunk(0, "poison")], MESSAGES).coalesce(1).write.parquet(source)
    tries, kept = [], []

    def refuse(batch, batch_id):
        tries.append(batch_id)
        if len(tries) < 3:
            raise OSError("no room")
        kept.extend(r.dlq_reason for r in batch.collect())

    waits = []
    assert retries.supervised(spark, path, stream(spark, source, checkpoint, retries.retried(path, fails_on("poison", path), refuse)), waits.append) == 5
    assert waits == [2, 4, 8, 16] and kept == ["ingest:Poison"]
    assert [r.outcome for r in retries.ledger(spark, path).orderBy("turn").collect()] == ["failed", "failed", "undelivered", "undelivered", "dead_letters"]


def test_other_failures_are_raised(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([chunk(0)], MESSAGES).coalesce(1).write.parquet(source)

    def broken(batch, batch_id):
        raise Poison("outside the ledger")

    with pytest.raises(StreamingQueryException):
        retries.supervised(spark, path, stream(spark, source, checkpoint, broken))


def upload(offset, job, doc="d", **more):
    event = {"doc_id": doc, "user_id": "u", "source_name": "a.txt", "storage_key": "u/d/source.txt", "job_id": job, **more}
    return (job.encode(), json.dumps(event).encode(), "uploads", 0, offset)


def test_documents_are_tried_by_themselves(spark, tmp_path):
    path, clock = str(tmp_path / "out"), [datetime(2024, 1, 1, tzinfo=timezone.utc)]
    seen = []

    def read(events):
        seen.append(sorted(r.job_id for r in events.collect()))
        return events.where("job_id <> 'mute'").select("job_id", F.when(F.col("job_id").startswith("bad"), "Broken").alias("error"))

    run = retries.ingested(path, read, now=lambda: clock[0])
    batch = lambda *rows: spark.createDataFrame(list(rows), MESSAGES)
    run(batch(upload(0, "good"), upload(1, "bad"), upload(2, "mute"), upload(3, "bad"), (b"k", b"no json", "uploads", 0, 4)), 0)
    assert seen[-1] == ["bad", "good", "mute"]
    state = {r.job_id: (r.attempt, r.outcome, r.error) for r in retries.documents(spark, path).collect()}
    assert state == {"good": (1, "completed", None), "bad": (1, "failed", "ingest:Broken"), "mute": (1, "failed", "ingest:no_answer")}
    run(batch(upload(5, "good"), upload(6, "new")), 1)  # completed ones are passed over, failed ones aren't due yet
    assert seen[-1] == ["new"]
    clock[0] += timedelta(seconds=3)
    run(batch(upload(7, "other")), 2)
    assert seen[-1] == ["bad", "mute", "other"]
    run(batch(upload(7, "other")), 2)  # the same batch again
    assert seen[-1] == ["bad", "mute", "other"]
    clock[0] += timedelta(seconds=5)
    run(batch(), 3)
    state = {r.job_id: (r.attempt, r.outcome) for r in retries.documents(spark, path).collect()}
    assert state["bad"] == (3, "dead_letter") and state["mute"] == (3, "dead_letter") and state["other"] == (1, "completed")
    run(batch(upload(9, "bad")), 4)
    assert seen[-1] == []
    letters = [(bytes(r.key).decode(), r.dlq_reason) for r in spark.read.parquet(f"{path}/dead_letters").collect()]
    assert sorted(letters) == [("bad", "ingest:Broken"), ("bad", "ingest:attempts_exhausted"), ("k", "decode:json"), ("mute", "ingest:no_answer")]

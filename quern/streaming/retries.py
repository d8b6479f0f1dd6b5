"""Redelivery of failed batches and documents, with a ledger of attempts beside what the stream writes.

A batch of a stream that fails is sought again: the sink writes what happened into the ledger and fails, the stream ends,
and when it is started again it delivers the same offsets as the same batch. At the last attempt the batch goes to the dead
letters as a whole and the stream goes on. The ledger is keyed by topic, partition and first offset.

Documents fail one by one: a failed document waits in a table until its next attempt is due and is delivered with a
later batch, so that the others don't wait for it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.collection import latest
from quern.sources.events import dead_letters, decode_uploads
from quern.sources.tables import exists
from quern.streaming.folds import SLICE, Attempts, folded
from quern.streaming.jobs import MOST_ATTEMPTS, backoff, offsets

LEDGER = "topic string, partition int, first_offset bigint, commit_offset bigint, attempt int, outcome string, error string, wait_s int"
DOCUMENTS = "job_id string, attempt int, outcome string, error string, due timestamp, key binary, value binary"
#: Characters of a reason that are kept, and the reason of a document that has none left.
REASON_CHARS, EXHAUSTED = 1000, "ingest:attempts_exhausted"

Write = Callable[[DataFrame, int], None]


def reason(error: BaseException) -> str:
    return f"ingest:{type(error).__name__}"[:REASON_CHARS]


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All that happened to batches: the columns of ``LEDGER``, the batch and its turn."""
    if not exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], f"{LEDGER}, batch bigint, turn int")
    return spark.read.schema(f"{LEDGER}, batch bigint, turn int").parquet(f"{path}/ledger")


def standing(entries: DataFrame) -> DataFrame:
    """Where each first offset of a partition stands: its last turn. ``outcome`` is ``failed`` (sought again after
    ``wait_s``), ``undelivered`` (the dead letters couldn't be written), ``stored`` or ``dead_letters``."""
    return latest(entries, ["topic", "partition", "first_offset"], ["batch", "turn"])


def retried(path: str, write: Write, refuse: Write | None = None, most: int = MOST_ATTEMPTS) -> Write:
    """``write`` for ``foreachBatch``, with attempts counted in the ledger at ``path``.

    After the last attempt ``refuse`` writes the batch elsewhere, by default as dead letters with the reason under
    ``path``; if that fails, the batch is sought again. Batches are messages (key, value, topic, partition, offset).
    """

    def bury(batch: DataFrame, batch_id: int) -> None:
        batch.select("key", "value", "topic", "partition", "offset", "dlq_reason").write.mode("overwrite").parquet(f"{path}/refused/batch={batch_id}")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spans = offsets(batch)
        before = standing(ledger(spark, path)).where(F.col("outcome").isin("failed", "undelivered"))
        seen = before.join(spans, ["topic", "partition", "first_offset"], "left_semi").agg(F.max("attempt").alias("attempt"), F.max("turn").alias("turn")).first()
        attempt, turn = (seen.attempt or 0) + 1, (seen.turn or 0) + 1

        def note(outcome: str, error: str | None, wait: bool) -> None:
            said = spans.withColumns({"attempt": F.lit(attempt), "outcome": F.lit(outcome), "error": F.lit(error).cast("string"), "wait_s": backoff(F.lit(attempt)) if wait else F.lit(0)})
            said.write.mode("overwrite").parquet(f"{path}/ledger/batch={batch_id}/turn={turn}")

        try:
            write(batch, batch_id)
        except Exception as e:
            if attempt < most:
                note("failed", reason(e), wait=True)
                raise
            try:
                (refuse or bury)(batch.withColumn("dlq_reason", F.lit(reason(e))), batch_id)
            except Exception:
                note("undelivered", reason(e), wait=True)
                raise
            note("dead_letters", reason(e), wait=False)
            return
        note("stored", None, wait=False)

    return run


def supervised(spark: SparkSession, path: str, start: Callable, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run the stream that ``start`` starts until it ends well; after a batch that the ledger tells of as failed, wait
    and start it again. Any other failure is raised. Returns how often it was started."""
    starts, told = 0, ledger(spark, path).count()
    while True:
        starts += 1
        try:
            start().awaitTermination()
            return starts
        except StreamingQueryException:
            now = ledger(spark, path)
            if (n := now.count()) == told:
                raise
            told = n
            sleep(now.agg(F.max_by("wait_s", F.struct("batch", "turn"))).first()[0])


def attempt_numbers(deliveries: DataFrame, key: str, at: Column, tie: str, ok: str, most: int = MOST_ATTEMPTS, slice_rows: int = SLICE) -> DataFrame:
    """(key, tie, attempt, action, wait_s) of each delivery in a log of them: the attempt that it was (0 if it went
    well), and what followed: ``commit``, ``seek`` after a wait, or ``dead_letter`` after the last one."""
    said = folded(deliveries, key, at, tie, ok, Attempts(most), slice_rows).withColumn("attempt", F.col("label").cast("int"))
    action = F.when(F.col("attempt") == 0, "commit").when(F.col("attempt") < most, "seek").otherwise("dead_letter")
    return said.select(key, tie, "attempt", action.alias("action"), F.when(action == "seek", backoff(F.col("attempt"))).otherwise(0).alias("wait_s"))


# ---- documents ------------------------------------------------------------------------------------------------------


def documents(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """What the last batch said of each document (before batch ``before``, if given)."""
    if not exists(spark, f"{path}/documents"):
        return spark.createDataFrame([], f"{DOCUMENTS}, batch bigint")
    rows = spark.read.schema(f"{DOCUMENTS}, batch bigint").parquet(f"{path}/documents")
    return latest(rows if before is None else rows.where(F.col("batch") < before), ["job_id"], ["batch"])


def ingested(path: str, ingest: Callable[[DataFrame], DataFrame], most: int = MOST_ATTEMPTS, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> Write:
    """For ``foreachBatch`` over upload messages (key, value, topic, partition, offset): each document by itself.

    ``ingest`` takes upload events and returns (job_id, error), null where it went well; a job it doesn't return
    failed. Of several messages of a job in a batch the last counts. A message that can't be decoded goes to the dead
    letters; one of a completed job is passed over, one of a job without attempts left goes to the dead letters. A
    failed document is due again after a wait and comes with the first batch after that; after ``most`` attempts it
    goes to the dead letters. A batch delivered again replaces what it wrote.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        decoded = decode_uploads(batch)
        state = documents(spark, path, before=batch_id).persist()
        new = latest(decoded.where("reject_reason is null").select(F.col("event.job_id").alias("job_id"), "event", "key", "value", "offset", "partition"), ["job_id"], ["offset", "partition"]).drop("offset", "partition")
        waiting = state.where((F.col("outcome") == "failed") & (F.col("due") <= F.lit(now())))
        again = decode_uploads(waiting).select("job_id", "event", "key", "value").join(new.select("job_id"), "job_id", "left_anti")
        asked = new.unionByName(again).join(state.select("job_id", F.col("attempt").alias("made"), F.col("outcome").alias("was")), "job_id", "left").where(~F.coalesce(F.col("was") == "completed", F.lit(False)))
        asked = asked.withColumn("made", F.coalesce("made", F.lit(0))).persist()
        try:
            spent, open_ = asked.where(F.col("made") >= most), asked.where(F.col("made") < most)
            said = ingest(open_.select("event.*"))
            done = open_.join(said.select("job_id", "error", F.lit(True).alias("told")).dropDuplicates(["job_id"]), "job_id", "left")
            error = F.when(F.col("told").isNull(), "ingest:no_answer").when(F.col("error").isNotNull(), F.concat(F.lit("ingest:"), F.col("error")))
            attempt = F.col("made") + 1
            outcome = F.when(error.isNull(), "completed").when(attempt < most, "failed").otherwise("dead_letter")
            due = F.when(outcome == "failed", F.lit(now()).cast("timestamp") + F.make_dt_interval(secs=backoff(attempt).cast("decimal(18,6)")))
            rows = done.select("job_id", attempt.alias("attempt"), outcome.alias("outcome"), F.left(error, F.lit(REASON_CHARS)).alias("error"), due.alias("due"), "key", "value")
            rows = rows.unionByName(spent.select("job_id", F.col("made").alias("attempt"), F.lit("dead_letter").alias("outcome"), F.lit(EXHAUSTED).alias("error"), F.lit(None).cast("timestamp").alias("due"), "key", "value"))
            rows.write.mode("overwrite").parquet(f"{path}/documents/batch={batch_id}")
            written = spark.read.schema(DOCUMENTS).parquet(f"{path}/documents/batch={batch_id}")
            letters = written.where("outcome = 'dead_letter'").select("key", "value", F.col("error").alias("dlq_reason"))
            letters.unionByName(dead_letters(decoded, "key", "value")).write.mode("overwrite").parquet(f"{path}/dead_letters/batch={batch_id}")
        finally:
            asked.unpersist()
            state.unpersist()

    return run

"""Jobs folded from their events, offsets and lag of partitions, retry decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

MOST_ATTEMPTS, MOST_BACKOFF, ERROR_CHARS = 3, 30, 1000


def fold_jobs(events: DataFrame) -> DataFrame:
    """State of each job from its events (job_id, seq, kind, units, chunks, error): begin, progress, complete or fail.

    Attempts are counted, the status is that of the last event, counts are the last that any event told, and the
    error is that of a last ``fail``. All of it is one aggregation that is combined before the shuffle.
    """
    status = F.when(F.col("kind") == "begin", "downloading").when(F.col("kind") == "progress", "partially_searchable").when(F.col("kind") == "complete", "completed").when(F.col("kind") == "fail", "failed")
    told = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))), F.lit(0))
    known = events.withColumn("status", status).where("status is not null")
    return known.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.count_if(F.col("kind") == "begin").alias("attempts"), told("units").alias("units_processed"), told("chunks").alias("chunks_published"), F.max_by(F.when(F.col("kind") == "fail", F.left("error", F.lit(ERROR_CHARS))), "seq").alias("error"))


def lookup(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """Each asked job with its state; ``found`` is false for one without. Blank errors are null."""
    rows = asked.select("job_id").distinct().join(jobs, "job_id", "left")
    return rows.withColumn("found", F.col("status").isNotNull()).withColumn("error", T.blank_to_null(F.col("error"))).na.fill(0, ["attempts", "units_processed", "chunks_published"])


def unfinished(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Messages of jobs that aren't completed; a delivery repeated after completion is passed over."""
    return messages.join(jobs.where("status = 'completed'").select("job_id"), "job_id", "left_anti")


def offsets(messages: DataFrame) -> DataFrame:
    """Per topic and partition: the first offset, and the one to commit after all."""
    return messages.groupBy("topic", "partition").agg(F.min("offset").alias("first_offset"), (F.max("offset") + 1).alias("commit_offset"))


def lag(messages: DataFrame) -> DataFrame:
    """Messages still waiting in each partition, as seen by the batch's first message."""
    first = messages.groupBy("topic", "partition").agg(F.min_by(F.struct("offset", "high_watermark"), "offset").alias("m"))
    return first.select("topic", "partition", F.greatest(F.lit(0).cast("bigint"), F.col("m.high_watermark") - F.col("m.offset") - 1).alias("lag"))


def backoff(attempt: Column, most: int = MOST_BACKOFF) -> Column:
    """Seconds to wait: doubling, up to ``most``."""
    return F.least(F.lit(most), F.pow(F.lit(2), F.least(attempt, F.lit(30))).cast("int"))


def retry(batches: DataFrame) -> DataFrame:
    """What becomes of failed batches (attempts, dead_letters_delivered): ``seek`` back and wait, or ``dead_letter``
    and commit; a batch whose dead letters weren't delivered is sought again."""
    action = F.when(F.col("attempts") < MOST_ATTEMPTS, "seek").when(F.col("dead_letters_delivered"), "dead_letter").otherwise("seek")
    return batches.withColumn("action", action).withColumn("wait_s", F.when(F.col("action") == "seek", backoff(F.col("attempts"))).otherwise(0))

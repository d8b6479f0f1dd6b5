"""Rate limits and lockouts over logs of requests, in batch; the lockout also as a stream with state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.streaming.folds import SLICE, Breaker, Lockout, MinuteGuard, folded

#: Requests and seconds of the gateway's limit, calls a minute and seconds of the captioner's circuit, failures and
#: seconds of a lockout.
REQUESTS, REQUEST_WINDOW, CALLS, CIRCUIT, FAILURES, LOCKOUT = 60, 60, 10, 90, 10, 15 * 60


def micros(at: Column) -> Column:
    """Microseconds since 1970 by the clock that a time without a zone shows."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def fixed_minute(calls: DataFrame, key: str, at: str, tie: str, most: int = CALLS) -> DataFrame:
    """``calls`` with minute, nth and allowed: the first ``most`` of each clock minute; denied ones count as well."""
    minute = F.date_trunc("minute", F.col(at))
    nth = F.row_number().over(Window.partitionBy(key, "minute").orderBy(at, tie))
    return calls.withColumn("minute", minute).withColumn("nth", nth).withColumn("allowed", F.col("nth") <= most)


def idle_reset(hits: DataFrame, key: str, at: str, tie: str, most: int = REQUESTS, seconds: int = REQUEST_WINDOW, slice_seconds: int = 86_400) -> DataFrame:
    """``hits`` with nth and allowed: every hit, denied or not, counts until none came for ``seconds``.

    A key's hits are counted in slices of time, each a partition of its own, and the slices' sums are carried over
    from one to the next, so a key that makes a third of all hits is spread over tasks.
    """
    gap = seconds * 1_000_000
    rows = hits.withColumn("__t", micros(F.col(at))).withColumn("__s", F.floor(F.col("__t") / (slice_seconds * 1_000_000)))
    own = Window.partitionBy(key, "__s").orderBy("__t", tie)
    idle = F.coalesce(F.col("__t") - F.lag("__t").over(own) >= gap, F.lit(False))
    rows = rows.withColumn("__idle", idle)
    rows = rows.withColumn("__run", F.sum(F.col("__idle").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(key, "__s", "__run").orderBy("__t", tie)))
    slices = rows.groupBy(key, "__s").agg(F.min("__t").alias("first"), F.max("__t").alias("last"), F.count("*").alias("n"), F.max("__run").alias("runs"), F.max_by("__nth", F.struct("__run", "__nth")).alias("tail"))
    w = Window.partitionBy(key).orderBy("__s")
    before = lambda c: F.lag(c).over(w)
    fresh = before("last").isNull() | (F.col("first") - before("last") >= gap)
    slices = slices.withColumn("reset", (fresh | (before("runs") > 0)).cast("int")).withColumn("adds", F.when(fresh, 0).when(before("runs") > 0, before("tail")).otherwise(before("n")))
    slices = slices.withColumn("group", F.sum("reset").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    carried = slices.select(F.col(key).alias("__key"), F.col("__s").alias("__slice"), F.sum("adds").over(Window.partitionBy(key, "group").orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)).alias("__carried"))
    out = rows.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__s") == F.col("__slice")))
    out = out.withColumn("nth", F.col("__nth") + F.when(F.col("__run") == 0, F.col("__carried")).otherwise(0))
    return out.withColumn("allowed", F.col("nth") <= most).drop("__t", "__s", "__idle", "__run", "__nth", "__key", "__slice", "__carried")


def lockout(attempts: DataFrame, key: str, at: str, tie: str, success: str, most: int = FAILURES, seconds: int = LOCKOUT, slice_rows: int = SLICE) -> DataFrame:
    """(key, tie, locked) of each attempt: ``most`` failures lock, each that counts for ``seconds`` anew.

    Whether an attempt counts depends on those before it; the fold is cut into slices whose state transitions are
    composed, so that an account with a third of all attempts is spread over tasks. A null success is a failure;
    attempts without a key or time are left out.
    """
    said = folded(attempts, key, micros(F.col(at)), tie, success, Lockout(most, seconds * 1_000_000), slice_rows)
    return said.select(key, tie, (F.col("label") == "locked").alias("locked"))


def lockout_stream(attempts: DataFrame, key: str, at: str, success: str, most: int = FAILURES, seconds: int = LOCKOUT) -> DataFrame:
    """The same over a stream (append mode): of each micro-batch and key, locked and counted attempts and the count.

    State is two numbers a key; it goes when the watermark has passed the end of the key's window.
    """

    def fold(k, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rule, now, locked = Lockout(most, seconds * 1_000_000), state.get if state.exists else (0, 0), 0
        rows = pd.concat(list(frames)).sort_values("t")
        for t, s in zip(rows["t"], rows["s"], strict=True):
            now, said = rule.step(now, int(t), bool(s))
            locked += said == "locked"
        state.update(now)
        state.setTimeoutTimestamp(max(now[1] // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [k[0]], "attempts": [len(rows)], "locked": [locked], "failures": [now[0]]})

    rows = attempts.select(F.col(key), micros(F.col(at)).alias("t"), F.col(at).cast("timestamp").alias("at"), F.col(success).alias("s")).withWatermark("at", f"{seconds} seconds")
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {dict(attempts.dtypes)[key]}, attempts bigint, locked bigint, failures bigint", "count int, until bigint", "append", "EventTimeTimeout")


def breaker(calls: DataFrame, key: str, at: str, tie: str, ok: str, failures: int = 5, seconds: int = 30, slice_rows: int = SLICE) -> DataFrame:
    """(key, tie, state) before each call: ``open`` for ``seconds`` after so many failures in a row, then ``half_open``
    for one call, whose outcome opens or closes it again. Calls met while open aren't made and don't count."""
    return folded(calls, key, micros(F.col(at)), tie, ok, Breaker(failures, seconds * 1_000_000), slice_rows).withColumnRenamed("label", "state")


def minute_guard(calls: DataFrame, key: str, at: str, tie: str, ok: str, most: int = CALLS, seconds: int = CIRCUIT, slice_rows: int = SLICE) -> DataFrame:
    """(key, tie, decision) of each call: ``allowed``, ``over`` the minute's limit, or denied as the circuit is ``open``.

    The first ``most`` calls of a clock minute are made, those over it count as well. A call that is made and isn't ok
    (the service said that it is asked too often) opens the circuit for ``seconds``; what it denies doesn't count.
    """
    return folded(calls, key, micros(F.col(at)), tie, ok, MinuteGuard(most, seconds * 1_000_000), slice_rows).withColumnRenamed("label", "decision")

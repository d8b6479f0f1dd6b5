"""Queries over logs: limits, lockouts, jobs, offsets, last writes, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.metrics import histogram
from quern.operators.collection import latest
from quern.plans.registry import query, table
from quern.sources.tables import new_path
from quern.streaming import jobs, limiters, retries, store


@query("fixed_minute_limiter", "SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS nth, nth <= 2 AS allowed FROM events", ints=("nth",))
def fixed_minute_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiters.fixed_minute(table(spark, sf_dir, "events"), "event_type", "ts", "event_id", 2).select("event_id", "nth", "allowed")


@query(
    "refresh_limiter",
    """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 36000000000, true) THEN 1 ELSE 0 END AS fresh FROM events),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS nth, nth <= 3 AS allowed FROM r""",
)
def refresh_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hits, until ten hours without one; in slices of two days."""
    return limiters.idle_reset(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 36_000, 172_800).select("event_id", F.col("nth").cast("bigint").alias("nth"), "allowed")


_ATTEMPTS = "e AS (SELECT event_id, user_id, epoch_us(ts) AS t, coalesce(event_type = 'signup', false) AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"


@query(
    "login_lockout",
    f"""WITH RECURSIVE {_ATTEMPTS}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 0 AS failed, 0::BIGINT AS until, false AS locked FROM e UNION ALL
    SELECT user_id, n, event_id, CASE WHEN c >= 2 THEN c WHEN ok THEN 0 ELSE c + 1 END, CASE WHEN c >= 2 OR ok THEN until ELSE t + 259200000000 END, c >= 2
    FROM (SELECT e.*, f.until, CASE WHEN e.t >= f.until THEN 0 ELSE f.failed END AS c FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)) SELECT user_id, event_id, locked FROM f WHERE n > 0""",
)
def login_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signup`` succeeds, everything else fails; two failures lock for three days."""
    events = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") == "signup")
    return limiters.lockout(events, "user_id", "ts", "event_id", "ok", 2, 3 * 86_400)


@query(
    "circuit_breaker",
    f"""WITH RECURSIVE {_ATTEMPTS}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 0 AS failed, 0::BIGINT AS since, '' AS state FROM e UNION ALL
    SELECT user_id, n, event_id, CASE WHEN s = 'open' THEN failed WHEN ok THEN 0 ELSE failed + 1 END, CASE WHEN s = 'open' THEN since WHEN ok THEN 0 ELSE t END, s
    FROM (SELECT e.*, f.failed, f.since, CASE WHEN f.failed < 3 THEN 'closed' WHEN e.t - f.since < 86400000000 THEN 'open' ELSE 'half_open' END AS s FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)) SELECT user_id, event_id, state FROM f WHERE n > 0""",
)
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") == "signup")
    return limiters.breaker(events, "user_id", "ts", "event_id", "ok", 3, 86_400)


@query(
    "minute_guard",
    """WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) // 400 AS t, value < 200 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 400, event_id) AS n FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
    f AS (SELECT DISTINCT event_type, 0::BIGINT AS n, NULL::BIGINT AS event_id, 0::BIGINT AS until, -1::BIGINT AS minute, 0 AS made, '' AS decision FROM e UNION ALL
    SELECT event_type, n, event_id, CASE WHEN d = 'allowed' AND NOT coalesce(ok, false) THEN t + 90000000 ELSE until END, CASE WHEN d = 'open' THEN minute ELSE t // 60000000 END, CASE WHEN d = 'open' THEN made ELSE m END, d
    FROM (SELECT *, CASE WHEN t < until THEN 'open' WHEN m > 10 THEN 'over' ELSE 'allowed' END AS d FROM (SELECT e.*, f.until, f.minute, f.made, CASE WHEN e.t // 60000000 = f.minute THEN f.made + 1 ELSE 1 END AS m FROM f JOIN e ON e.event_type = f.event_type AND e.n = f.n + 1)))
    SELECT event_type, event_id, decision FROM f WHERE n > 0""",
)
def minute_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time passes 400 times as fast, so that minutes have many calls; a value of 200 and more opens the circuit."""
    calls = table(spark, sf_dir, "events").withColumn("at", F.timestamp_micros(F.floor(limiters.micros(F.col("ts")) / 400)).cast("timestamp_ntz")).withColumn("ok", F.col("value") < 200)
    return limiters.minute_guard(calls, "event_type", "at", "event_id", "ok", 10, 90)


@query(
    "delivery_attempts",
    """WITH e AS (SELECT event_id, user_id, coalesce(value <= 30, false) AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    r AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY user_id ORDER BY n) AS run FROM e),
    a AS (SELECT user_id, event_id, CASE WHEN ok THEN 0 ELSE (row_number() OVER (PARTITION BY user_id, run, ok ORDER BY n) - 1) % 3 + 1 END::INTEGER AS attempt FROM r)
    SELECT *, CASE attempt WHEN 0 THEN 'commit' WHEN 3 THEN 'dead_letter' ELSE 'seek' END AS action, CASE WHEN attempt IN (1, 2) THEN least(30, 1 << attempt) ELSE 0 END::INTEGER AS wait_s FROM a""",
)
def delivery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as deliveries of a batch for each user; those of a value above 30 fail."""
    log = table(spark, sf_dir, "events").withColumn("ok", F.col("value") <= 30)
    return retries.attempt_numbers(log, "user_id", limiters.micros(F.col("ts")), "event_id", "ok")


@query(
    "ledger_standing",
    """SELECT event_type AS topic, (user_id % 4)::INTEGER AS partition, event_id // 9 * 9 AS first_offset, max(event_id) AS batch, arg_max(CASE WHEN value > 60 THEN 'failed' WHEN value > 40 THEN 'dead_letters' ELSE 'stored' END, event_id) AS outcome FROM events GROUP BY ALL""",
)
def ledger_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of a ledger, nine offsets a batch."""
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("value") > 60, "failed").when(F.col("value") > 40, "dead_letters").otherwise("stored")
    entries = e.select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), (F.floor(F.col("event_id") / 9) * 9).alias("first_offset"), F.col("event_id").alias("batch"), F.lit(1).alias("turn"), outcome.alias("outcome"))
    return retries.standing(entries).drop("turn")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of a topic for each type, in partitions by user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.lit(20_000).cast("bigint").alias("high_watermark"), "user_id", "value")


_MSG = "m AS (SELECT event_type AS topic, (user_id % 4)::INTEGER AS partition, event_id AS offset_, user_id, value FROM events)"


@query("offsets_commit", f"WITH {_MSG} SELECT topic, partition, min(offset_) AS first_offset, max(offset_) + 1 AS commit_offset FROM m GROUP BY ALL")
def offsets_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.offsets(_messages(spark, sf_dir))


@query("consumer_lag", f"WITH {_MSG} SELECT topic, partition, greatest(0, 20000 - min(offset_) - 1)::BIGINT AS lag FROM m GROUP BY ALL")
def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.lag(_messages(spark, sf_dir))


@query("last_write_wins", "SELECT user_id, max(event_id) AS \"offset\", arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_messages(spark, sf_dir).select("user_id", "offset", "value"), ["user_id"], ["offset"]).select("user_id", "offset", "value")


@query("stored_batches", "SELECT user_id, event_type, max(event_id % 6)::BIGINT AS batch, arg_max(event_id, event_id % 6 * 1000000000 + event_id) AS event_id, arg_max(value, event_id % 6 * 1000000000 + event_id) AS value FROM events GROUP BY ALL")
def stored_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and type overwrite each other, in six batches of which half are compacted before the rest comes."""
    key, order = ["user_id", "event_type"], ["event_id"]
    path, events = new_path(spark, "collection"), table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    for batch in range(6):
        store.write(path, latest(events.where(F.col("event_id") % 6 == batch), key, order), batch, key)
        if batch == 2:
            store.compact(spark, path, key, order, least=2)
    return store.read(spark, path, key, order)


_KIND = "CASE event_type WHEN 'signup' THEN 'begin' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' END"


@query(
    "job_fold",
    f"""WITH e AS (SELECT user_id, event_id, {_KIND} AS kind FROM events) SELECT user_id AS job_id, arg_max(CASE kind WHEN 'begin' THEN 'downloading' WHEN 'progress' THEN 'partially_searchable' WHEN 'complete' THEN 'completed' ELSE 'failed' END, event_id) AS status, count(*) FILTER (WHERE kind = 'begin') AS attempts,
    coalesce(max(event_id) FILTER (WHERE kind = 'progress'), 0) AS units_processed, CASE WHEN arg_max(kind, event_id) = 'fail' THEN 'broken ' || max(event_id) END AS error FROM e WHERE kind IS NOT NULL GROUP BY user_id""",
)
def job_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as those of a job."""
    kind = F.when(F.col("event_type") == "signup", "begin").when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(kind == "progress", F.col("event_id")).alias("units"), F.lit(None).cast("bigint").alias("chunks"), F.concat_ws(" ", F.lit("broken"), F.col("event_id").cast("string")).alias("error"))
    return jobs.fold_jobs(rows).select("job_id", "status", "attempts", "units_processed", "error")


@query("unfinished_jobs", "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM l WHERE last = 'purchase')")
def unfinished_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    state = latest(events.select(F.col("user_id").alias("job_id"), "event_id", "event_type"), ["job_id"], ["event_id"]).select("job_id", F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"))
    return jobs.unfinished(events.select("event_id", F.col("user_id").alias("job_id")), state).select("event_id", F.col("job_id").alias("user_id"))


_EDGES = [0.1, 1.0, 5.0, 10.0, 50.0, 100.0, 500.0]


@query("histogram_buckets", "SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in _EDGES) + ", 'inf'::DOUBLE]) AS le) GROUP BY ALL")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "events"), "event_type", "value", _EDGES)

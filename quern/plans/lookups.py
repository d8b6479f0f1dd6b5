"""Queries of look-ups and filters: scopes and filters of a client, owned rows, titles by place, jobs, what a batch stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import chunking, memory, records
from quern.operators import collection as C
from quern.plans.registry import query, sql_strip, sql_words, table
from quern.streaming import ingest, jobs


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("user_id"), F.col("lang").alias("lesson_title"), (F.col("doc_id") % 40).cast("int").alias("lesson_number"), (F.col("doc_id") % 9).cast("int").alias("page_number"))


@query("scoped_filter", "WITH u AS (SELECT * FROM documents WHERE source = (SELECT max(source) FROM documents)) SELECT doc_id, (doc_id % 40)::INTEGER AS lesson_number, 'lesson_number,page_number' AS applied, 'odd' AS ignored FROM u WHERE doc_id % 2 = 0 AND doc_id % 40 IN (3, 8, 12, 20, 28) AND doc_id % 9 < 7")
def scoped_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's filters with keys that it may not set, values that are no numbers, and keys that no one knows, within
    half of a user's documents."""
    chunks = _chunks(spark, sf_dir)
    user = chunks.agg(F.max("user_id")).first()[0]
    mine = [r[0] for r in chunks.where((F.col("user_id") == user) & (F.col("doc_id") % 2 == 0)).select("doc_id").collect()]
    asked = C.sanitised({"user_id": ["someone"], "doc_id": ["1"], "lesson_number": ["3", "8", "twelve", "12", " 20", "28", ""], "page_number": [*map(str, range(7)), "x"], "odd": ["1"], "block_type": [""]})
    condition, applied = C.payload_filter(asked)
    found = C.tenant(chunks, user, mine).where(condition)
    return found.select("doc_id", "lesson_number", F.lit(",".join(applied)).alias("applied"), F.lit(",".join(C.ignored(asked, applied))).alias("ignored"))


@query("owned_rows", "SELECT conv_id, turn FROM conversations WHERE conv_id % 5 = conv_id % 3")
def owned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations asked for by users of whom some own them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 5).alias("user_id"))
    return records.owned(rows, rows.select("conv_id", (F.col("conv_id") % 3).alias("user_id")), "conv_id").select("conv_id", "turn")


@query("document_totals", "SELECT l_orderkey AS doc_id, count(DISTINCT l_linenumber % 3) AS units, count(*) AS chunks, count(*) FILTER (WHERE l_returnflag = 'R') AS images FROM lineitem GROUP BY l_orderkey")
def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("unit"), F.when(F.col("l_returnflag") == "R", "image").otherwise("text").alias("chunk_type"))
    return chunking.document_counts(rows)


@query("touched_users", "SELECT DISTINCT source AS user_id FROM documents WHERE doc_id % 3 = 0")
def touched_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose documents a batch of every third document changes."""
    return ingest.touched_users(_chunks(spark, sf_dir).where("doc_id % 3 = 0"))


@query(
    "titles_asked",
    """WITH c AS (SELECT source AS user_id, lang AS title, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, title) AS i FROM c), v AS (SELECT user_id, sha256(string_agg(title, chr(10) ORDER BY i))[1:12] AS version FROM f GROUP BY user_id),
    q AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 11 = 0 THEN 'nobody' ELSE source END AS user_id, list_distinct([1, doc_id % 5 + 1]) AS idx, doc_id % 7 = 0 AS stale FROM documents),
    t AS (SELECT q.query_id, string_agg(title, ',' ORDER BY i) AS titles, count(*) AS n FROM q JOIN f ON f.user_id = q.user_id AND list_contains(idx, i) GROUP BY q.query_id)
    SELECT q.query_id, CASE WHEN version IS NULL THEN 'no_lessons' WHEN stale THEN 'stale_catalogue' WHEN coalesce(n, 0) < len(idx) THEN 'unknown_lesson' ELSE 'ok' END AS status, CASE WHEN version IS NOT NULL AND NOT stale AND coalesce(n, 0) >= len(idx) THEN titles END AS titles FROM q LEFT JOIN v ON v.user_id = q.user_id LEFT JOIN t ON t.query_id = q.query_id""",
)
def titles_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document asks for two lessons of its user by place; some know an old catalogue, some have no lessons."""
    facet = C.title_facet(_chunks(spark, sf_dir))
    listed = C.catalogue(facet)
    user = F.when(F.col("doc_id") % 11 == 0, "nobody").otherwise(F.col("user_id"))
    asked = _chunks(spark, sf_dir).select(F.col("doc_id").alias("query_id"), user.alias("user_id"), F.array(F.lit(1), (F.col("doc_id") % 5 + 1).cast("int")).alias("lesson_indexes"))
    known = asked.join(listed.select("user_id", "version"), "user_id", "left").withColumn("version", F.when(F.col("query_id") % 7 == 0, "old").otherwise(F.coalesce("version", F.lit("none"))))
    found = C.titles_by_index(known, facet, listed)
    return found.select("query_id", "status", F.array_join("titles", ",").alias("titles"))


@query(
    "memory_episodes",
    """SELECT o_custkey AS user_id, 'episodic' AS kind, concat_ws(chr(10), o_orderpriority, o_orderstatus, '', 'Order ' || o_orderkey) AS searchable_text, sha256(array_to_string(regexp_extract_all(lower(concat_ws(chr(10), o_orderpriority, o_orderstatus, '', 'Order ' || o_orderkey)), '[a-z0-9_]+'), ' ')) AS content_hash FROM orders
    UNION ALL SELECT c_custkey, 'semantic', c_mktsegment, sha256(lower(c_mktsegment)) FROM customer""",
)
def memory_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes without an outcome, segments of customers as facts."""
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("situation"), F.col("o_orderstatus").alias("action"), F.lit(None).cast("string").alias("outcome"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("lesson"))
    said = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("content"))
    return memory.episodes(seen).unionByName(memory.facts(said)).select("user_id", "kind", "searchable_text", "content_hash")


@query(
    "hits_flattened",
    """SELECT o_orderkey AS memory_id, CASE o_orderkey % 3 WHEN 0 THEN 'Situation: ' || o_orderpriority || chr(10) || 'Action: ' || o_orderstatus || chr(10) || 'Outcome (' || CASE WHEN o_orderkey % 2 = 0 THEN 'WORKED' ELSE 'DID NOT WORK' END || '): o' WHEN 1 THEN o_orderstatus ELSE 'Customer ' || o_custkey END AS content, CASE o_orderkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 0 END AS n_public FROM orders""", ints=("n_public",))
def hits_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recalled rows: episodes, facts with content, and rows whose payload has private keys only."""
    k = F.col("o_orderkey")
    episode = F.create_map(F.lit("situation"), "o_orderpriority", F.lit("action"), "o_orderstatus", F.lit("outcome"), F.lit("o"), F.lit("lesson"), F.lit(""), F.lit("success"), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("_v"), F.lit("1"))
    payload = F.when(k % 3 == 0, episode).when(k % 3 == 1, F.create_map(F.lit("content"), "o_orderstatus", F.lit("_v"), F.lit("1"))).otherwise(F.create_map(F.lit("_v"), F.lit("1")))
    rows = table(spark, sf_dir, "orders").select(k.alias("memory_id"), F.when(k % 3 == 0, "episodic").otherwise("semantic").alias("kind"), payload.alias("payload"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("searchable_text"))
    return memory.flatten(rows).select("memory_id", "content", F.size("payload").alias("n_public"))


@query(
    "job_lookup",
    """WITH k AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'begin' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' END AS kind FROM events), s AS (SELECT user_id, arg_max(CASE kind WHEN 'begin' THEN 'downloading' WHEN 'complete' THEN 'completed' ELSE 'failed' END, event_id) AS status, count(*) FILTER (WHERE kind = 'begin') AS attempts FROM k WHERE kind IS NOT NULL GROUP BY user_id)
    SELECT c_custkey AS job_id, status, status IS NOT NULL AS found, coalesce(attempts, 0) AS attempts FROM customer LEFT JOIN s ON s.user_id = c_custkey""",
)
def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer asks for the job of the user of its number; most have none."""
    kind = F.when(F.col("event_type") == "signup", "begin").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail")
    none = F.lit(None).cast("bigint")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"), none.alias("units"), none.alias("chunks"), F.lit(" ").alias("error"))
    return jobs.lookup(jobs.fold_jobs(events), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"))).select("job_id", "status", "found", "attempts")


@query(
    "accepted_chunks",
    f"""WITH m AS (SELECT doc_id, 'c' || doc_id % 300 AS chunk_id, text, doc_id % 9 = 0 AS brief FROM documents WHERE doc_id % 10 <> 0)
    SELECT chunk_id, max(doc_id) AS "offset", arg_max(length(text), doc_id) AS n FROM m WHERE {sql_strip("coalesce(text, '')")} <> '' AND (brief OR len(list_filter({sql_words('text')}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) >= 8) GROUP BY chunk_id""", ints=("n",))
def accepted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages with chunks of three hundred ids; every tenth is cut off, every ninth a table, which may be short."""
    k = F.col("doc_id")
    chunk = F.struct(F.concat(F.lit("c"), (k % 300).cast("string")).alias("chunk_id"), k.cast("string").alias("doc_id"), F.lit("u").alias("user_id"), "text", F.when(k % 9 == 0, "table").alias("block_type"))
    value = F.to_json(F.struct(chunk.alias("chunk")))
    messages = table(spark, sf_dir, "documents").select(F.lit(None).cast("binary").alias("key"), F.encode(F.when(k % 10 == 0, F.left(value, F.length(value) - 1)).otherwise(value), "UTF-8").alias("value"), F.lit("chunks").alias("topic"), F.lit(0).alias("partition"), k.alias("offset"))
    return ingest.accepted(messages)[0].select("chunk_id", "offset", F.length("text").alias("n"))


@query("batch_dead_letters", "SELECT doc_id AS \"offset\", 'decode:' || CASE WHEN doc_id % 10 = 0 THEN 'json' WHEN doc_id % 4 = 0 THEN 'chunk_id' ELSE 'user_id' END AS dlq_reason FROM documents WHERE doc_id % 10 = 0 OR doc_id % 4 = 0 OR doc_id % 7 = 0")
def batch_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages that are cut off, or without a chunk's id or user: what a batch refuses, and why."""
    k = F.col("doc_id")
    chunk = F.struct(F.when(k % 4 != 0, k.cast("string")).alias("chunk_id"), k.cast("string").alias("doc_id"), F.when(k % 7 != 0, "u").alias("user_id"), F.lit("x").alias("text"))
    value = F.to_json(chunk)
    messages = table(spark, sf_dir, "documents").select(F.lit(None).cast("binary").alias("key"), F.encode(F.when(k % 10 == 0, F.left(value, F.length(value) - 1)).otherwise(value), "UTF-8").alias("value"), F.lit("chunks").alias("topic"), F.lit(0).alias("partition"), k.alias("offset"))
    return ingest.accepted(messages)[1].select("offset", "dlq_reason")

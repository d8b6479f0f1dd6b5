"""Queries over uploads: admission, keys, decoding of messages, dead letters, captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.registry import query, sql_estimate, sql_uuid5, table
from quern.sources import events, objects
from quern.streaming import images

_MIMES = ("application/pdf", "application/json", "text/plain", "text/html", "image/png", "image/jpeg", "text/csv")


@query(
    "upload_admission",
    f"""WITH u AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 19 = 0 THEN {objects.UPLOAD_BYTES} + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 3 = 0 THEN '%PDF-' || text ELSE text END AS content FROM documents)
    SELECT doc_id, CASE WHEN coalesce(size, 0) = 0 THEN 'empty' WHEN size > {objects.UPLOAD_BYTES} THEN 'too_large' WHEN NOT coalesce(starts_with(content, '%PDF-'), false) THEN 'not_pdf' ELSE 'ok' END AS upload,
    CASE WHEN coalesce(size, 0) = 0 THEN 'empty' ELSE 'ok' END AS document FROM u""",
)
def upload_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads, every third a PDF; some are empty, some too large for an upload but not for a document."""
    size = F.when(F.col("doc_id") % 17 == 0, 0).when(F.col("doc_id") % 19 == 0, objects.UPLOAD_BYTES + 1).otherwise(F.col("n_chars"))
    content = F.encode(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("%PDF-"), "text")).otherwise(F.col("text")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), content.alias("content"))
    return rows.select("doc_id", objects.admission(F.col("size"), F.col("content")).alias("upload"), objects.admission(F.col("size"), F.col("content"), "document").alias("document"))


@query(
    "object_keys",
    """WITH n AS (SELECT c_custkey, c_nationkey || '/' || c_custkey AS root, c_custkey % 4 AS k, c_nationkey % 7 AS m FROM customer)
    SELECT c_custkey, root || '/source.pdf' AS source, root || '/metadata.json' AS metadata, root || '/tables/t1.json' AS table_key, root || '/images/' || c_custkey || '.png' AS image, root || '/assets/' || c_custkey || '.png' AS asset,
    CASE WHEN k = 0 THEN '.pdf' WHEN k = 3 THEN '.txt' ELSE CASE m WHEN 0 THEN '.pdf' WHEN 1 THEN '.json' WHEN 2 THEN '.txt' WHEN 3 THEN '.html' WHEN 4 THEN '.png' WHEN 5 THEN '.jpg' ELSE '.bin' END END AS suffix, k <> 2 AS safe FROM n""",
)
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a customer's objects, and the suffix by a name or by a MIME type."""
    user, doc = F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    kind = F.col("c_custkey") % 4
    name = F.when(kind == 0, "A.PDF").when(kind == 1, "plain").when(kind == 2, "../.hidden").otherwise("a.b.TXT")
    mime = F.element_at(F.array(*map(F.lit, _MIMES)), (F.col("c_nationkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", objects.source_key(user, doc).alias("source"), objects.metadata_key(user, doc).alias("metadata"), objects.table_key(user, doc, F.lit("t1")).alias("table_key"),
        objects.image_key(user, doc, doc, F.lit("png")).alias("image"), objects.asset_key(user, doc, doc, F.lit("png")).alias("asset"), objects.suffix(name, mime).alias("suffix"), objects.safe_key(name).alias("safe"),
    )


def _upload_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages of uploads; some lack a field, climb out of their root, have a negative size or are no object."""
    key = F.col("o_orderkey")
    event = F.struct(
        key.cast("string").alias("doc_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("user_id"), F.col("o_orderpriority").alias("source_name"),
        F.when(key % 7 == 0, "../x").otherwise(F.concat(F.lit("u/"), key.cast("string"))).alias("storage_key"), F.when(key % 2 == 0, F.concat(F.lit("j"), key.cast("string"))).alias("job_id"), F.when(key % 11 == 0, -1).otherwise(5).alias("size_bytes"),
    )
    value = F.when(key % 13 == 0, "[1]").otherwise(F.to_json(event))
    return table(spark, sf_dir, "orders").select(key, F.encode(value, "UTF-8").alias("value"))


_REASON = "CASE WHEN o_orderkey % 13 = 0 THEN 'decode:json' WHEN o_orderstatus = 'P' THEN 'decode:user_id' WHEN o_orderkey % 7 = 0 THEN 'decode:storage_key' WHEN o_orderkey % 11 = 0 THEN 'decode:size_bytes' END"


@query(
    "decode_uploads",
    f"""WITH r AS (SELECT *, {_REASON} AS reject_reason FROM orders)
    SELECT o_orderkey, reject_reason, CASE WHEN reject_reason IS NULL THEN o_custkey::VARCHAR END AS user_id, CASE WHEN reject_reason IS NULL THEN CASE WHEN o_orderkey % 2 = 0 THEN 'j' || o_orderkey ELSE o_orderkey::VARCHAR END END AS job_id, CASE WHEN reject_reason IS NULL THEN 1 END AS schema_version FROM r""",
)
def decode_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.decode_uploads(_upload_messages(spark, sf_dir))
    return found.select("o_orderkey", "reject_reason", "event.user_id", "event.job_id", "event.schema_version")


@query("upload_dead_letters", f"WITH r AS (SELECT o_orderkey, {_REASON} AS reason FROM orders) SELECT o_orderkey, reason[1:10] AS dlq_reason FROM r WHERE reason IS NOT NULL")
def upload_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.dead_letters(events.decode_uploads(_upload_messages(spark, sf_dir)), "o_orderkey", most=10)


@query(
    "decode_chunks",
    """WITH d AS (SELECT doc_id AS id, text, doc_id % 11 = 0 AS bad FROM documents)
    SELECT id, CASE WHEN bad THEN 'decode:chunk_id' END AS reject_reason, CASE WHEN NOT bad THEN CASE WHEN id % 5 = 0 THEN 9 ELSE 1 END END AS page, CASE WHEN NOT bad THEN CASE WHEN id % 2 = 0 THEN 'table' ELSE 'text' END END AS block_type,
    CASE WHEN NOT bad THEN length(coalesce(text, '')) END AS n_text, CASE WHEN NOT bad THEN length(text) END AS n_embed FROM d""", ints=("page", "n_text", "n_embed"))
def decode_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages of chunks, odd ones nested; every fifth says its page among the extras, every third has a
    blank text to embed."""
    i = F.col("doc_id")
    chunk = F.struct(
        F.when(i % 11 != 0, F.concat(F.lit("c"), i.cast("string"))).alias("chunk_id"), i.cast("string").alias("doc_id"), F.lit("u").alias("user_id"), "text", F.when(i % 3 == 0, "  ").alias("embed_text"),
        F.lit(1).alias("page"), F.when(i % 2 == 0, "table").alias("block_type"), F.when(i % 5 == 0, F.create_map(F.lit("page"), F.lit("9"))).alias("extra"),
    )
    value = F.when(i % 2 == 1, F.to_json(F.struct(chunk.alias("chunk")))).otherwise(F.to_json(chunk))
    found = events.decode_chunks(table(spark, sf_dir, "documents").select(i.alias("id"), F.encode(value, "UTF-8").alias("value")))
    return found.select("id", "reject_reason", "chunk.page", "chunk.block_type", F.length("chunk.text").alias("n_text"), F.length("chunk.embed_text").alias("n_embed"))


@query(
    "image_requests",
    f"""WITH p AS (SELECT p_partkey, 'd' || p_partkey % 7 AS doc, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'Image from s' || p_partkey % 5 || ', unit ' || p_size || ', dimensions ' || p_size * 10 || 'x' || p_partkey % 900 || '.' END AS text, doc || ':' || p_size || ':image:' || p_partkey AS name FROM part)
    SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'decode:json' END AS reject_reason, text, {sql_estimate('text')} AS token_count, {sql_uuid5('name')} AS chunk_id, 'u/' || doc || '/assets/h' || p_partkey % 50 || '.png' AS storage_key,
    CASE WHEN p_partkey % 10 <> 0 THEN text END AS fallback, CASE WHEN p_partkey % 10 <> 0 THEN 'h' || p_partkey % 50 END AS digest, CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END AS ocr FROM p""",
)
def image_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pictures; their requests are sent as messages, every tenth of them cut off, and decoded."""
    k = F.col("p_partkey")
    t = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), t("d", k % 7).alias("doc_id"), F.lit("u").alias("user_id"), t("s", k % 5).alias("source_name"), F.col("p_size").cast("int").alias("unit"), k.cast("int").alias("chunk_index"), F.array(F.lit("Parts")).alias("section_path"), F.lit(None).cast("array<double>").alias("bbox"), t("h", k % 50).alias("digest"), F.lit("png").alias("extension"), F.lit("image/png").alias("content_type"), F.when(k % 3 == 0, F.concat(F.lit(" "), "p_name", F.lit("\n"))).alias("ocr_text"), (F.col("p_size") * 10).cast("int").alias("width"), (k % 900).cast("int").alias("height"))
    sent = images.pictures(rows).withColumn("value", F.encode(F.when(F.col("id") % 10 == 0, F.left("request", F.length("request") - 5)).otherwise(F.col("request")), "UTF-8")).drop("request")
    found = images.decode_requests(sent)
    return found.select("id", "reject_reason", "text", "token_count", "chunk_id", "storage_key", F.col("request.fallback_text").alias("fallback"), F.col("request.image_sha256").alias("digest"), F.col("extra")["ocr"].alias("ocr"))


@query(
    "caption_cache",
    """WITH c AS (SELECT o_orderkey % 2000 AS image, max(o_orderdate) AS at FROM orders GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, CASE WHEN c.at >= l_shipdate - INTERVAL 30 DAY THEN strftime(c.at, '%Y-%m-%d') END AS caption FROM lineitem LEFT JOIN c ON c.image = l_partkey""",
)
def caption_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pictures, asked for when they ship; the caption tells the day on which it was made."""
    cached = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2000).cast("string").alias("image_sha256"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("caption"), F.col("o_orderdate").alias("cached_at"))
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("image_sha256"), "l_shipdate")
    return events.with_captions(asked, cached, "l_shipdate").select("l_orderkey", "l_linenumber", "caption")

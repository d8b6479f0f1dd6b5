"""Messages as rows: decoding, checks, and what goes to the dead letters.

A message is never lost: ``decode_*`` keep key, value and offset, and give every row either its fields or a
``reject_reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import blank_to_null
from quern.schemas import CHUNK, UPLOAD_EVENT
from quern.sources.objects import safe_key


def utf8(value: Column) -> Column:
    """Bytes as UTF-8; null where they aren't."""
    return F.try_validate_utf8(value.cast("string"))


def json_object(value: Column) -> Column:
    """Whether bytes are a JSON object."""
    return F.coalesce(F.ltrim(utf8(value)).startswith("{") & F.try_parse_json(utf8(value)).isNotNull(), F.lit(False))


def decode_uploads(messages: DataFrame, value: str = "value") -> DataFrame:
    """``messages`` with ``event`` (fields of an upload; job_id falls back to doc_id) and ``reject_reason``."""
    e = F.from_json(utf8(F.col(value)), UPLOAD_EVENT)
    rows = messages.withColumn("event", e)
    has = lambda c: F.coalesce(F.col(f"event.{c}") != "", F.lit(False))
    reason = F.when(~json_object(F.col(value)), "decode:json")
    for c in ("doc_id", "user_id", "source_name", "storage_key"):
        reason = reason.when(~has(c), f"decode:{c}")
    reason = reason.when(~safe_key(F.col("event.storage_key")), "decode:storage_key").when(F.col("event.size_bytes") < 0, "decode:size_bytes")
    fields = F.struct(F.coalesce("event.schema_version", F.lit(1)).alias("schema_version"), "event.doc_id", "event.user_id", "event.source_name", "event.storage_key", "event.content_type", F.coalesce(blank_to_null(F.col("event.job_id")), "event.doc_id").alias("job_id"), "event.size_bytes")
    return rows.withColumn("reject_reason", reason).withColumn("event", F.when(F.col("reject_reason").isNull(), fields))


def decode_chunks(messages: DataFrame, value: str = "value") -> DataFrame:
    """``messages`` with ``chunk`` and ``reject_reason``.

    A chunk stands in the event's ``chunk`` or is the event itself; entries of its ``extra`` take precedence over
    its own. A chunk without embed_text takes its text; one without an id, document or user is rejected.
    """
    fields = [f.split(" ")[0] for f in CHUNK.split(", ")]
    text = utf8(F.col(value))
    flat, nested = F.from_json(text, CHUNK), F.from_json(text, f"chunk struct<{', '.join(f.replace(' ', ':', 1) for f in CHUNK.split(', '))}>")["chunk"]
    # One row for each message: a filter on what was read isn't pushed below this, so that no message is parsed anew for
    # each condition.
    read = F.struct(F.coalesce(nested, flat).alias("chunk"), json_object(F.col(value)).alias("whole"))
    rows = messages.select("*", F.explode(F.array(read)).alias("__read")).withColumn("chunk", F.col("__read.chunk"))
    kinds = dict(f.split(" ", 1) for f in CHUNK.split(", "))

    def merged(name: str) -> Column:
        if name in ("extra", "section_path", "bbox"):
            return F.col(f"chunk.{name}")
        return F.coalesce(F.try_element_at(F.col("chunk.extra"), F.lit(name)).try_cast(kinds[name]), F.col(f"chunk.{name}")).alias(name)

    rows = rows.withColumn("chunk", F.struct(*[merged(f) for f in fields]))
    reason = F.when(~F.col("__read.whole"), "decode:json")
    for c in ("chunk_id", "doc_id", "user_id"):
        reason = reason.when(F.coalesce(F.col(f"chunk.{c}"), F.lit("")) == "", f"decode:{c}")
    filled = F.col("chunk").withField("embed_text", F.coalesce(blank_to_null(F.col("chunk.embed_text")), F.col("chunk.text"))).withField("text", F.coalesce("chunk.text", F.lit(""))).withField("block_type", F.coalesce("chunk.block_type", F.lit("text")))
    return rows.withColumn("reject_reason", reason).withColumn("chunk", F.when(F.col("reject_reason").isNull(), filled)).drop("__read")


def dead_letters(decoded: DataFrame, *keep: str, most: int = 512) -> DataFrame:
    """Rejected messages with their original key and value, and the reason cut to ``most`` characters."""
    return decoded.where("reject_reason is not null").select(*keep, F.left("reject_reason", F.lit(most)).alias("dlq_reason"))


def wire(chunks: DataFrame, kind: str = "block_type") -> Column:
    """Chunks as JSON, the kind under ``type`` and ``block_type`` both."""
    return F.to_json(F.struct(*[F.col(c) for c in chunks.columns if c not in (kind, "type", "block_type")], F.col(kind).alias("type"), F.col(kind).alias("block_type")))


def chunk_messages(chunks: DataFrame) -> DataFrame:
    """``key`` and ``value`` of chunks (their columns, doc_id, user_id, source_name, page) for the topic of chunks: the
    chunks of a unit have one key, so that they keep their order."""
    inner = [c for c in chunks.columns if c not in ("user_id", "source_name", "block_type")]
    chunk = F.struct(*inner, F.col("block_type").alias("type"), F.col("block_type").alias("block_type"))
    event = F.struct(F.lit(1).alias("schema_version"), "doc_id", "user_id", "source_name", F.coalesce(F.size("section_path") > 0, F.lit(False)).alias("require_title"), chunk.alias("chunk"))
    return chunks.select(F.concat_ws(":", "doc_id", F.coalesce("page", F.lit(0)).cast("string")).alias("key"), F.to_json(event).alias("value"))


def image_messages(pictures: DataFrame) -> DataFrame:
    """``key`` and ``value`` of requests to describe pictures, by chunk."""
    return pictures.where("request is not null").select(F.col("chunk_id").alias("key"), F.col("request").alias("value"))


def ingested_messages(documents: DataFrame) -> DataFrame:
    """``key`` and ``value`` that tell of documents read as a whole (doc_id, user_id, job_id, source_name,
    units_processed, chunks_published, images_queued), by document."""
    fields = ("doc_id", "user_id", "job_id", "source_name", "units_processed", "chunks_published", "images_queued")
    return documents.select(F.col("doc_id").cast("string").alias("key"), F.to_json(F.struct(F.lit(1).alias("schema_version"), *fields)).alias("value"))


def read_kafka(spark: SparkSession, servers: str, topic: str, per_batch: int = 32) -> DataFrame:
    """A topic as a stream of messages, at most ``per_batch`` offsets a micro-batch. Needs Spark's Kafka package."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", per_batch).load()


def write_kafka(rows: DataFrame, servers: str, topic: str) -> None:
    """Write ``key`` and ``value`` of a batch, acknowledged by all replicas; a failure fails the batch."""
    rows.select(F.col("key").cast("binary"), F.col("value").cast("binary")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("kafka.compression.type", "zstd").option("topic", topic).save()


def with_captions(requests: DataFrame, cached: DataFrame, at: str, days: int = 30) -> DataFrame:
    """Requests to describe pictures with the caption that their digest has from the last ``days``, or null.

    ``cached``: image_sha256, caption, cached_at. What has no caption is what a model must still be asked.
    """
    newest = cached.groupBy("image_sha256").agg(F.max_by("caption", "cached_at").alias("caption"), F.max("cached_at").alias("__cached"))
    rows = requests.join(newest, "image_sha256", "left")
    fresh = F.col("__cached") >= F.col(at) - F.make_interval(days=F.lit(days))
    return rows.withColumn("caption", F.when(fresh, F.col("caption"))).drop("__cached")

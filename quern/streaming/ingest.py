"""Chunks from a stream of messages into a collection: decoding, dead letters, gate, last write wins.

A collection is a keyed table (``store``): batches written under their number in buckets by chunk id, and a base. A batch
that is delivered again after a failure replaces itself; a read merges only buckets that were written since the base.
With each batch the sink notes whose documents it changed, which is what makes cached answers of these users void.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.collection import gate, latest
from quern.sources.events import dead_letters, decode_chunks
from quern.sources.tables import exists
from quern.streaming import index, store

KEY, ORDER = ["chunk_id"], ["offset", "partition"]


def accepted(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of decoded ``messages`` the chunks to store, the last of each id, and the dead letters."""
    decoded = decode_chunks(messages)
    rows = decoded.where("reject_reason is null").select("chunk.*", "topic", "partition", "offset")
    good = rows.where(gate(F.col("embed_text"), F.col("block_type")).isNull())
    return latest(good, ["chunk_id"], ["offset", "partition"]), dead_letters(decoded, "key", "value", "topic", "partition", "offset")


def collection(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame | None:
    """The stored chunks, of each id the newest; with ``ids`` (chunk_id) only those, from their buckets. None where
    nothing has been stored."""
    rows = store.read(spark, path, KEY, ORDER, ids)
    return None if rows is None else rows.drop("batch")


def sink(path: str, most_deltas: int = store.MOST_DELTAS, indexed: bool = False):
    """A function for ``foreachBatch``: it writes a batch's chunks, its dead letters and the users it touched under the
    batch's number, so a batch delivered again replaces itself. Buckets written ``most_deltas`` times are compacted.
    With ``indexed`` the inverted index at ``path``/index is kept up as well."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            chunks, rejected = accepted(batch)
            rejected.write.mode("overwrite").parquet(f"{path}/dead_letters/batch={batch_id}")
            touched_users(chunks).write.mode("overwrite").parquet(f"{path}/touched/batch={batch_id}")
            if indexed:
                old = store.read(batch.sparkSession, path, KEY, ORDER, chunks.select("chunk_id"), before=batch_id)
                rows = lambda df, *more: df.select("chunk_id", "user_id", F.col("embed_text").alias("text"), *more)
                index.add(f"{path}/index", rows(chunks), batch_id, None if old is None else rows(old, "batch"))
            store.write(path, chunks, batch_id, KEY)
            store.compact(batch.sparkSession, path, KEY, ORDER, most_deltas)
        finally:
            batch.unpersist()

    return write


def start(messages: DataFrame, path: str, checkpoint: str, **trigger):
    """Run the stream into the collection at ``path``; by default over what is there, then it ends."""
    return messages.writeStream.foreachBatch(sink(path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write the current rows as one table, split by a hash of the id."""
    rows = collection(spark, path)
    if rows is not None:
        rows.withColumn("bucket", store.bucket(KEY)).repartition(store.BUCKETS, "bucket").write.partitionBy("bucket").parquet(into)


def touched_users(chunks: DataFrame) -> DataFrame:
    """Users whose documents a batch changes: each gets a new generation."""
    return chunks.select("user_id").distinct()


def generations(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, generation): how many batches have changed a user's documents."""
    if not exists(spark, f"{path}/touched"):
        return spark.createDataFrame([], "user_id string, generation bigint")
    return spark.read.schema("user_id string, batch bigint").parquet(f"{path}/touched").groupBy("user_id").agg(F.count("*").alias("generation"))

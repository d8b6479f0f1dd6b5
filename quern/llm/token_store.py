"""Operator 5: documents as token ids in binary shards with a minimal perfect hash index.

The store is a folder of Parquet files that any store Spark writes to can hold. A row is a shard: consecutive
documents in ascending order of key, with

* ``payload``: the ids of its documents as little-endian unsigned 32-bit integers, one after the other;
* ``keys`` and ``ends``: key of each document, and the number of ids up to its end within the shard;
* ``seeds``, ``prints``, ``slots``: the index. A key hashes to a bucket, the bucket's seed sends it to its own
  slot of exactly as many as there are distinct keys, and the slot holds a 32-bit fingerprint of the key and the
  first document and number of documents that have it. A lookup thus reads one seed and one slot, and a key
  that the shard doesn't hold fails its fingerprint but for one time in 2**32;
* ``part``, ``shard``, ``part_base``: the range partition, the shard's number in it and the ids before it in it.

Documents are range-partitioned by (key, hash of text, number of the row), so that a key or a whole row that a third
of all rows repeat is spread too.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.segments import Rows, SegmentTable, in_slices, rows_of
from quern.llm.shared import give_back, mix, shared_path, text_slices

SHARD_SCHEMA = "part int, shard int, part_base bigint, n_ids bigint, min_key bigint, max_key bigint, keys array<bigint>, ends array<bigint>, seeds binary, prints binary, slots binary, payload binary"
_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("part_base", pa.int64()), ("n_ids", pa.int64()), ("min_key", pa.int64()), ("max_key", pa.int64()), ("keys", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("seeds", pa.binary()), ("prints", pa.binary()), ("slots", pa.binary()), ("payload", pa.binary())])
#: Fixed value: how byte-level vocabularies write the space.
SPACE = "\u0120"
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _hash(keys: np.ndarray, seed) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys.astype(np.int64).view(np.uint64) ^ (np.asarray(seed, dtype=np.uint64) + np.uint64(1)) * _SPREAD)


def _buckets(n: int) -> int:
    return max(1, n // 4)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of the buckets, slot of each of the distinct ``keys``, fingerprint of each slot (hash and displace)."""
    n = len(keys)
    seeds = np.zeros(_buckets(n), dtype=np.uint32)
    slots = np.zeros(n, dtype=np.int64)
    prints = np.zeros(n, dtype=np.uint32)
    if not n:
        return seeds, slots, prints
    bucket = (_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    taken = np.zeros(n, dtype=bool)
    for group in sorted(groups, key=lambda g: (-len(g), bucket[g[0]])):
        tries = np.arange(1, 65, dtype=np.uint64)
        while True:
            at = (_hash(keys[group][None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~taken[at].any(axis=1)
            if len(group) > 1:
                ordered = np.sort(at, axis=1)
                free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            good = np.flatnonzero(free)
            if len(good):
                break
            tries = tries + np.uint64(64)
        seeds[bucket[group[0]]] = tries[good[0]]
        slots[group] = at[good[0]]
        taken[at[good[0]]] = True
    prints[slots] = (_hash(keys, 2**31) >> np.uint64(32)).astype(np.uint32)
    return seeds, slots, prints


def lookup(keys: np.ndarray, seeds: bytes, prints: bytes, slots: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First document and number of documents of each key in a shard; 0 documents for a key it doesn't hold."""
    seed, fp, slot = np.frombuffer(seeds, "<u4"), np.frombuffer(prints, "<u4"), np.frombuffer(slots, "<u4").reshape(-1, 2)
    if not len(fp) or not len(keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    bucket = (_hash(keys, 0) % np.uint64(len(seed))).astype(np.int64)
    at = (_hash(keys, seed[bucket].astype(np.uint64)) % np.uint64(len(fp))).astype(np.int64)
    known = fp[at] == (_hash(keys, 2**31) >> np.uint64(32)).astype(np.uint32)
    return np.where(known, slot[at, 0], 0).astype(np.int64), np.where(known, slot[at, 1], 0).astype(np.int64)


@lru_cache(maxsize=2)
def _table(path: str) -> SegmentTable:
    # Spark runs a worker for each core; threads of the library's own in each would only contend for them.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    spaced = np.array([(tokenizer.id_to_token(k) or "").startswith(SPACE) for k in range(tokenizer.get_vocab_size())])

    def encode(segments: list[str]) -> Rows:
        return rows_of([e.ids for e in tokenizer.encode_batch_fast(segments, add_special_tokens=False)])

    def encode_spaced(segments: list[str]) -> Rows:
        parts, lengths = [], []
        for some in in_slices(segments, 4096):
            # One text of many segments: only their own first tokens begin with a space.
            ids = np.array(tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            starts = np.flatnonzero(spaced[ids])
            if len(starts) != len(some):
                raise ValueError("the tokenizer doesn't begin a token at each space")
            parts.append(ids)
            lengths.append(np.diff(starts, append=len(ids)))
        return np.concatenate(parts), np.concatenate(lengths)

    return SegmentTable(encode, encode_spaced, whole=tuple(t.content for t in tokenizer.get_added_tokens_decoder().values()))


def _shard(part: int, number: int, base: int, keys: list, ids: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum([len(x) // 4 for x in ids])
    known = [(k, i) for i, k in enumerate(keys) if k is not None]
    values, first, count = np.unique(np.array([k for k, _ in known], dtype=np.int64), return_index=True, return_counts=True)
    seeds, slots, prints = build_index(values)
    table = np.zeros((len(values), 2), dtype="<u4")
    if len(values):
        table[slots, 0] = np.array([i for _, i in known], dtype=np.int64)[first]
        table[slots, 1] = count
    row = [part, number, base, int(ends[-1]), int(values[0]) if len(values) else None, int(values[-1]) if len(values) else None, keys, ends.tolist(), seeds.astype("<u4").tobytes(), prints.astype("<u4").tobytes(), table.tobytes(), b"".join(ids)]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 2048, shard_ids: int = 1 << 20) -> None:
    """Encode every whole text, append ``end_id`` and write the store at ``path``.

    A null text is empty. Rows are in ascending order of key, null keys first, equal keys by a hash of their
    text; rows with an equal key are found together, those with a null key are stored but not in the index.
    A very long text is cut into segments whole, so it must fit in a task's memory; it makes a shard of its own.
    A text that holds an added token of the tokenizer, such as ``<|endoftext|>``, has it encoded as that token, which
    is what the library does without special tokens being added. A shard holds at most ``shard_docs`` documents and, unless one document is longer, ``shard_ids`` ids.
    Encoding follows the shuffle, so what moves is the text once; the sort spills.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = _table(tokenizer), TaskContext.get().partitionId()
        keys, ids, size, base, number = [], [], 0, 0, 0
        for batch in batches:
            at = iter(batch.column(0).to_pylist())
            for texts in text_slices(batch.column(1)):
                for found in table.of(texts).texts():
                    data, key = found.astype("<u4").tobytes() + end, next(at)
                    if keys and (len(keys) >= shard_docs or size + len(data) // 4 > shard_ids):
                        yield _shard(part, number, base, keys, ids)
                        base, number, keys, ids, size = base + size, number + 1, [], [], 0
                    keys.append(key)
                    ids.append(data)
                    size += len(data) // 4
                give_back()
        if keys:
            yield _shard(part, number, base, keys, ids)

    rows = docs.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).alias("text")).withColumn("salt", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "key", "salt", "row").sortWithinPartitions("key", "salt").select("key", "text").mapInArrow(run, SHARD_SCHEMA).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``base``, the ids of all shards before each. What is gathered is a number for each range partition."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, total = {}, 0
    for r in sorted(sums, key=lambda r: r.part):
        before[r.part], total = total, total + r.n
    bases = spark.createDataFrame(list(before.items()), "part int, before bigint")
    return shards.join(F.broadcast(bases), "part").withColumn("base", F.col("before") + F.col("part_base")).drop("before")


def rows_of_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    """The shards of a batch one at a time, as their payloads and keys are large."""
    return (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows))


def documents_of(shards: DataFrame) -> DataFrame:
    """A row for each stored document, read by its key through the index: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in rows_of_batch(batch):
                keys, ends, payload = s["keys"], np.array([0, *s["ends"]], dtype=np.int64), memoryview(s["payload"])
                held = np.array(sorted({k for k in keys if k is not None}), dtype=np.int64)
                first, count = lookup(held, s["seeds"], s["prints"], s["slots"])
                if (count == 0).any():
                    raise ValueError("a shard's index doesn't hold its keys")
                rows = [(None, i) for i, k in enumerate(keys) if k is None]
                rows += [(k, i) for k, f, c in zip(held.tolist(), first.tolist(), count.tolist(), strict=True) for i in range(f, f + c)]
                out = [(k, s["base"] + int(ends[i]), int(ends[i + 1] - ends[i]), zlib.crc32(payload[4 * ends[i] : 4 * ends[i + 1]])) for k, i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return shards.select("base", "keys", "ends", "seeds", "prints", "slots", "payload").mapInArrow(run, schema)


def fetch(shards: DataFrame, wanted: DataFrame, key_col: str = "doc_id", slice_shards: int = 500_000) -> DataFrame:
    """Ids (array<bigint>) of the documents of each wanted key: the shard by its key range, then a constant-time lookup.

    The directory of key ranges, one row a shard, goes to the tasks in slices of at most ``slice_shards`` rows.
    A key that no shard holds gives no row, a key with several documents a row for each.
    """
    spark = shards.sparkSession
    keys = wanted.select(F.col(key_col).cast("bigint").alias("key")).where("key is not null").distinct()
    arrow = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int64()))])
    places = "part int, shard int, key bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in rows_of_batch(batch):
                asked, ends, ids = np.array(s["asked"], dtype=np.int64), [0, *s["ends"]], np.frombuffer(s["payload"], "<u4")
                first, count = lookup(asked, s["seeds"], s["prints"], s["slots"])
                rows = [(k, ids[ends[i] : ends[i + 1]].astype(np.int64)) for k, f, c in zip(asked.tolist(), first.tolist(), count.tolist(), strict=True) for i in range(f, f + c)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], schema=arrow)

    def placed(directory: list) -> DataFrame:
        low, high = np.array([r.min_key for r in directory], dtype=np.int64), np.array([r.max_key for r in directory], dtype=np.int64)
        part, shard = np.array([r.part for r in directory], dtype=np.int32), np.array([r.shard for r in directory], dtype=np.int32)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column(0).to_numpy(zero_copy_only=False)
                start, end = np.searchsorted(high, key, "left"), np.searchsorted(low, key, "right")
                n = np.maximum(end - start, 0)
                at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(shard[at]), pa.array(np.repeat(key, n))], names=["part", "shard", "key"])

        return keys.where(F.col("key").between(int(low[0]), int(high[-1]))).mapInArrow(place, places)

    ranges = shards.where("min_key is not null").select("part", "shard", "min_key", "max_key").orderBy("part", "shard")
    asked, directory = spark.createDataFrame([], places), []
    for r in ranges.toLocalIterator():
        directory.append(r)
        if len(directory) == slice_shards:
            asked, directory = asked.union(placed(directory)), []
    if directory:
        asked = asked.union(placed(directory))
    found = shards.join(asked.groupBy("part", "shard").agg(F.collect_list("key").alias("asked")), ["part", "shard"])
    return found.mapInArrow(run, "key bigint, ids array<bigint>").withColumnRenamed("key", key_col)


def store_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the store into the shared folder and return what its files hold: doc_id, start, n_tokens, ids_crc32.

    One row for each row of ``docs``, repeated ones included; an empty table gives an empty result.
    """
    path = shared_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer, id_col=id_col, text_col=text_col)
    return documents_of(read_store(docs.sparkSession, path))

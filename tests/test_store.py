"""The keyed table: merged reads, pruned buckets, redelivery, compaction, what is left over."""

import json
import random

from quern.streaming import ingest, store

SCHEMA = "k int, seq int, v string"


def test_merges_only_what_was_written_since(spark, tmp_path):
    path, rng, want = f"file://{tmp_path}/t", random.Random(2), {}
    assert store.read(spark, path, ["k"], ["seq"]) is None and store.compact(spark, path, ["k"], ["seq"]) == [] and store.vacuum(spark, path) == []
    for batch in range(6):
        keys = range(300) if batch == 0 else rng.sample(range(330), 12)
        rows = [(k, rng.randrange(9), f"{batch}-{k}") for k in keys]
        want |= {k: v for k, _, v in rows}
        store.write(path, spark.createDataFrame(rows, SCHEMA), batch, ["k"])
        if batch == 3:
            done = store.compact(spark, path, ["k"], ["seq"], least=2)
            assert 0 < len(done) < store.BUCKETS
    got = store.read(spark, path, ["k"], ["seq"])
    assert {r.k: r.v for r in got.collect()} == want
    store.write(path, spark.createDataFrame(rows, SCHEMA), 5, ["k"])  # delivered again
    assert {r.k: r.v for r in store.read(spark, path, ["k"], ["seq"]).collect()} == want
    gone = store.vacuum(spark, path)
    assert any("/manifest/" in f for f in gone) and {r.k: r.v for r in store.read(spark, path, ["k"], ["seq"]).collect()} == want


def test_look_ups_read_their_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for batch in range(3):
        store.write(path, spark.createDataFrame([(k, batch, "x" * batch) for k in range(500)], SCHEMA), batch, ["k"])
    wanted = spark.createDataFrame([(7,), (7,), (9999,)], "k int")
    got = store.read(spark, path, ["k"], ["seq"], wanted)
    assert [(r.k, r.v, r.batch) for r in got.collect()] == [(7, "xx", 2)]
    files = got.inputFiles()
    assert 0 < len({f.rpartition("bucket=")[2].split("/")[0] for f in files}) <= 2
    assert [r.v for r in store.read(spark, path, ["k"], ["seq"], wanted, before=2).collect()] == ["x"]
    store.compact(spark, path, ["k"], ["seq"], least=1)
    assert {b for _, _, b in store.manifest(spark, path)} == {-1, 2}  # the newest batch may come again
    store.compact(spark, path, ["k"], ["seq"], least=1, newest=True)
    plan = store.read(spark, path, ["k"], ["seq"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan  # a table at rest is read as it is
    assert store.read(spark, path, ["k"], ["seq"]).count() == 500


def test_the_sink_compacts_and_tells_generations(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    text = "one two three four five six seven eight "
    sink = ingest.sink(path, most_deltas=2)
    assert ingest.generations(spark, path).count() == 0
    for batch in range(5):
        rows = [(None, json.dumps({"chunk": {"chunk_id": f"c{k}", "doc_id": "d", "user_id": f"u{k % 2}", "text": text + str(batch)}}).encode(), "chunks", 0, 10 * batch + k) for k in range(batch, batch + 3)]
        sink(spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset bigint"), batch)
    got = {r.chunk_id: r.text for r in ingest.collection(spark, path).collect()}
    assert got == {f"c{k}": text + str(min(k, 4)) for k in range(7)}
    assert {r.user_id: r.generation for r in ingest.generations(spark, path).collect()} == {"u0": 5, "u1": 5}
    assert any(b < 0 for _, _, b in store.manifest(spark, path))
    some = ingest.collection(spark, path, spark.createDataFrame([("c6",)], "chunk_id string"))
    assert [r.text for r in some.collect()] == [text + "4"]

"""Pictures as chunks and requests; the stream that describes each once and keeps that for a time."""

import json
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.streaming import images

PICTURES = "doc_id string, user_id string, source_name string, unit int, chunk_index int, section_path array<string>, bbox array<double>, digest string, extension string, content_type string, ocr_text string, width int, height int"


@pytest.fixture()
def placed(spark):
    rows = [("d", "u", "a.pdf", 3, 7, ["Heat"], None, "abc", "png", "image/png", "  ", 640, 480), ("d", "u", "a.pdf", 3, 8, [], [0.0, 1.0, 2.0, 3.0], "def", "jpg", "image/jpeg", " words seen ", 10, 20)]
    return spark.createDataFrame(rows, PICTURES)


def test_pictures_as_chunks_and_requests(spark, placed):
    got = {r.digest: r for r in images.pictures(placed).collect()}
    assert got["abc"].text == "Image from a.pdf, unit 3, dimensions 640x480." == got["abc"].embed_text and got["def"].text == "words seen"
    assert got["abc"].storage_key == "u/d/assets/abc.png" and got["abc"].extra == {"image_id": "abc", "storage_key": "u/d/assets/abc.png", "width": "640", "height": "480", "ocr": "true", "enrichment_pending": "true"}
    sent = json.loads(got["def"].request)
    assert sent["page"] == 3 and sent["image_sha256"] == "def" and sent["fallback_text"] == "words seen" and sent["chunk_id"] == got["def"].chunk_id
    want = placed.select(T.chunk_id(F.lit("d"), F.lit(3), F.lit("image"), F.lit(7)).alias("x")).first().x
    assert got["abc"].chunk_id == want
    assert [r.request for r in images.pictures(placed, describe=False).collect()] == [None, None]
    back = images.decode_requests(images.pictures(placed).select(F.col("request").cast("binary").alias("value"))).collect()
    assert [r.reject_reason for r in back] == [None, None] and {r.request.storage_key for r in back} == {"u/d/assets/abc.png", "u/d/assets/def.jpg"}


def test_requests_that_cannot_be_read(spark):
    good = {"doc_id": "d", "user_id": "u", "source_name": "s", "chunk_id": "c", "chunk_index": 0, "page": None, "storage_key": "k", "content_type": "t", "image_sha256": "x", "fallback_text": ""}
    values = [json.dumps(good), json.dumps({**good, "chunk_index": None}), json.dumps({k: v for k, v in good.items() if k != "image_sha256"}), "[]", "{", None]
    rows = images.decode_requests(spark.createDataFrame([(i, None if v is None else v.encode()) for i, v in enumerate(values)] + [(9, b"\xff")], "i int, value binary")).orderBy("i").collect()
    assert [r.reject_reason for r in rows] == [None, "decode:chunk_index", "decode:image_sha256", "decode:json", "decode:json", "decode:json", "decode:json"]
    assert rows[0].request.section_path == [] and rows[0].request.schema_version == 1 and rows[3].request is None


def request(n, digest, fallback="fallback"):
    return (1, "d", "u", "s", f"c{n}", n, None if n == 0 else n, ["Heat"] if n else [], f"key/{digest}", "image/png", digest, fallback)


def model_in(folder):
    """A model that notes each call in a folder, and says that it is asked too often while a file ``busy`` is there."""

    def model(key, content_type):
        import os

        from quern.streaming.images import TooOften

        if os.path.exists(f"{folder}/busy"):
            raise TooOften
        name = key.rpartition("/")[2]
        with open(f"{folder}/{name}.calls", "a") as f:
            f.write("x")
        return "" if name == "blank" else f"a picture of {name}"

    return model


def test_stream_describes_once_and_forgets_in_time(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    calls = lambda name: len((tmp_path / f"{name}.calls").read_text())

    def put(*rows):
        spark.createDataFrame(list(rows), images.REQUEST).coalesce(1).write.mode("append").parquet(source)

    put(request(0, "cat"), request(1, "cat"), request(2, "blank"), request(3, "blank"))
    stream = images.describe_stream(spark.readStream.schema(images.REQUEST).parquet(source), model_in(str(tmp_path)), kept_seconds=6, circuit_seconds=2)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="0 seconds").start()

    def until(*chunks):
        for _ in range(120):
            try:
                got = {r.chunk_id: (r.text, r.cached, r.partition_key, r.require_title) for r in spark.read.parquet(out).collect()}
            except AnalysisException:
                got = {}
            if set(chunks) <= set(got):
                return got
            assert query.exception() is None
            time.sleep(0.5)
        raise AssertionError(f"{chunks} not in {sorted(got)}")

    try:
        got = until("c0", "c1", "c2", "c3")
        assert sorted(got[c][1] for c in ("c0", "c1")) == [False, True] and got["c0"][0] == "a picture of cat" and calls("cat") == 1
        assert got["c2"][:2] == ("fallback", False) and calls("blank") == 2  # nothing to keep
        assert got["c0"][2:] == ("d:0", False) and got["c1"][2:] == ("d:1", True)
        time.sleep(7)
        (tmp_path / "busy").touch()
        put(request(5, "dog"))
        time.sleep(4)
        (tmp_path / "busy").unlink()
        put(request(4, "cat"), request(6, "dog"))
        got = until("c4", "c5", "c6")
        assert got["c4"][:2] == ("a picture of cat", False) and calls("cat") == 2  # forgotten by then
        assert got["c5"][0] == got["c6"][0] == "a picture of dog" and calls("dog") == 1  # one waited for the other
    finally:
        query.stop()
        spark.conf.unset(name)

"""The answer cache as a stream: hits, misses, overwriting, eviction, changes and expiry."""

import time

from pyspark.errors import AnalysisException

from quern.streaming import answers


def test_answer_stream(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    near, other = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    store = lambda n, q, a, v, docs=("d",), user="u": (user, n, "store", list(docs), q, a, v)
    look = lambda n, v, docs=("d",), user="u": (user, n, "lookup", list(docs), None, None, v)

    def put(*rows):
        spark.createDataFrame(list(rows), answers.EVENT).coalesce(1).write.mode("append").parquet(source)

    put(look(1, near), store(2, "What is heat?", "old", near), store(3, " what is HEAT? ", "new", near), store(4, "Other", "o", other), look(5, [1.0, 0.0, 0.0]), look(6, [1.0, 1.0, 0.0]), look(7, near, ("e",)), look(8, near, user="v"), store(9, "blank", " ", [0.0, 0.0, 1.0]), look(10, [0.0, 0.0, 1.0]), look(11, None))
    stream = answers.answer_stream(spark.readStream.schema(answers.EVENT).parquet(source), ttl_seconds=15, most=2)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="0 seconds").start()

    def until(*ids):
        for _ in range(150):
            try:
                got = {r.event_id: (r.outcome, r.answer) for r in spark.read.parquet(out).collect()}
            except AnalysisException:
                got = {}
            if set(ids) <= set(got):
                return got
            assert query.exception() is None
            time.sleep(0.4)
        raise AssertionError(sorted(got))

    try:
        got = until(1, 5, 6, 7, 8, 10, 11)
        assert got[1] == got[7] == got[8] == ("empty", None) and got[5] == ("hit", "new") and got[6] == ("below", None) == got[11]
        assert got[10] == ("below", None)  # a blank answer isn't kept
        put(store(20, "Third", "t", [0.0, 0.0, 1.0]), look(21, near), look(22, other), look(23, [0.0, 0.0, 1.0]))
        got = until(21, 22, 23)
        assert got[21] == ("below", None) and got[22] == ("hit", "o") and got[23] == ("hit", "t")  # two at most: the oldest went
        put(("u", 30, "change", None, None, None, None), look(31, other), store(32, "Again", "a", other), look(33, other))
        got = until(31, 33)
        assert got[31] == ("empty", None) and got[33] == ("hit", "a")
        time.sleep(16)
        put(look(40, other))
        assert until(40)[40] == ("empty", None)
    finally:
        query.stop()
        spark.conf.unset(name)

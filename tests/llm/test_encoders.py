"""Operators 5 and 9 against the libraries whose files they read and write."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from quern.llm import byte_bpe, segments, token_store
from quern.llm.queries import PATTERN, op5_token_store, op9_byte_bpe, tokenizer_file
from quern.llm.shared import shared_path

JSON, RANKS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_row(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe_query(spark, sf_dir, sample, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op9_byte_bpe(spark, sf_dir).collect()}
    assert got == {i: bpe_row(library, t) for i, t in zip(sample.doc_id, sample.text, strict=True)}


def test_byte_bpe_odd_texts(odd, library):
    got = sorted((tuple(r)[1:] for r in byte_bpe.round_trip(odd, RANKS, PATTERN).collect()))
    assert got == sorted(bpe_row(library, r.text) for r in odd.collect())
    assert byte_bpe.round_trip(odd.limit(0), RANKS, PATTERN).count() == 0


def test_segment_tables_roll_over(library, monkeypatch):
    monkeypatch.setattr(segments, "RECENT", 5)
    codec = byte_bpe._codec(RANKS, PATTERN)
    table = segments.SegmentTable(lambda some: segments.rows_of(codec.ids(some)), limit=40)
    rng = np.random.default_rng(5)
    for _ in range(30):
        texts = [" ".join(rng.choice(["alpha", "beta.", "beta", "gamma,", "w%d" % rng.integers(200), "\n", "", "naïve!"], 12)) for _ in range(5)]
        assert [t.tolist() for t in table.of(texts).texts()] == [library.encode_ordinary(t) for t in texts]
    assert len(table.newer.key) <= 60 and len(table.older.key) <= 60


@pytest.mark.parametrize("text", ["  two  spaces ", "a\n b \n\n", "x" * 700, "aab" * 300, "don't 'll 12 3", " x　y\tz", "ab" * 65, "\r\n", "Word. word, word.word wörd! ɐx. 12. a\x85b \u2003x", "one", ""])
def test_byte_bpe_segments(text, library):
    codec = byte_bpe._codec(RANKS, PATTERN)
    table = byte_bpe._table(codec)
    ids = next(table.of([text]).texts()).tolist()
    assert ids == library.encode_ordinary(text) and codec.text(ids) == text.encode()


def test_encode_and_decode_columns(odd):
    rows = byte_bpe.decode(byte_bpe.encode(odd, RANKS, PATTERN, into="tokens"), RANKS, PATTERN, "tokens")
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows.collect())


def store_rows(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    out, start = [], 0
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_store_query(spark, sf_dir, sample):
    ordered = sample.sort_values("doc_id")
    got = sorted(map(tuple, op5_token_store(spark, sf_dir).collect()))
    assert got == store_rows(zip(ordered.doc_id, ordered.text, strict=True))


def test_token_store_odd_rows(odd):
    got = token_store.store_round_trip(odd, JSON).orderBy("start").collect()
    assert len(got) == 10 and [r.doc_id for r in got] == [None, None, 1, 2, 3, 4, 5, 5, 6, 7]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert token_store.store_round_trip(odd.limit(0), JSON).count() == 0


def test_token_store_added_token_in_a_text(docs_of):
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end} two  spaces {end}\n x", f"no{end}gap <|endoftext| > {end} ", "plain text"]
    t, want, start = Tokenizer.from_file(JSON), [], 0
    for k, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_store.store_round_trip(docs_of(list(enumerate(texts))), JSON).collect())) == want


def test_token_store_spreads_equal_rows(spark, docs_of):
    docs = spark.range(0, 20_000, numPartitions=4).selectExpr("7L AS doc_id", "'the same text in every row' AS text")
    path = shared_path(spark, "test-equal")
    token_store.write_store(docs, path, JSON)
    sizes = [r.n for r in token_store.read_store(spark, path).groupBy("part").agg({"n_ids": "sum"}).withColumnRenamed("sum(n_ids)", "n").collect()]
    assert len(sizes) > 2 and max(sizes) < 0.5 * sum(sizes)
    got = token_store.documents_of(token_store.read_store(spark, path))
    assert got.count() == got.select("start").distinct().count() == 20_000 and got.select("ids_crc32").distinct().count() == 1


def test_keyed_access(spark, docs_of):
    docs = docs_of([(k, f"text number {k}") for k in range(300)] + [(7, "another seven"), (None, "x")])
    path = shared_path(spark, "test-store")
    token_store.write_store(docs, path, JSON, shard_docs=16)
    shards = token_store.read_store(spark, path)
    wanted = spark.createDataFrame([(7,), (250,), (9999,), (None,)], "doc_id bigint")
    got = token_store.fetch(shards, wanted, slice_shards=3).collect()
    assert sorted(r.doc_id for r in got) == [7, 7, 250]
    assert shards.count() >= 19


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**60), 2**60, 3000))
    seeds, slots, prints = token_store.build_index(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    table = np.zeros((len(keys), 2), dtype="<u4")
    table[slots, 0], table[slots, 1] = np.arange(len(keys)), 1
    first, count = token_store.lookup(keys, seeds.astype("<u4").tobytes(), prints.astype("<u4").tobytes(), table.tobytes())
    assert (first == np.arange(len(keys))).all() and (count == 1).all()
    missing = rng.integers(2**61, 2**62, 3000)
    assert token_store.lookup(missing, seeds.astype("<u4").tobytes(), prints.astype("<u4").tobytes(), table.tobytes())[1].sum() == 0


def test_looking_segments_up_takes_memory_by_the_texts_alone():
    import tracemalloc

    import pyarrow as pa

    table = segments.SegmentTable(lambda names: (np.zeros(20 * len(names), dtype=np.uint32), np.full(len(names), 20)))
    table.of([" ".join(["a", *(f"word{k}" for k in range(100_000))])])
    names = pa.array([f"{k}" * 200 for k in range(1000, 6000)], pa.large_string())
    alone = [segments.names_hashed(names.slice(k, 1)) for k in range(0, 5000, 500)]
    for work, most in ((lambda: table.of(["a word1 word2", "a word99"]), 2_000_000), (lambda: segments.names_hashed(names), 16_000_000)):
        tracemalloc.start()
        found = work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most
    assert [tuple(h[k] for h in found) for k in range(0, 5000, 500)] == [(a[0], b[0]) for a, b in alone]

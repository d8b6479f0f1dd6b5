"""Queries over texts: estimates, tokens, the gate, chunks, readers, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.hashing import BUCKETS, bucket
from quern.operators import encoding
from quern.operators.collection import gate
from quern.plans.registry import SPACE, query, sql_strip, sql_tokens, sql_words, table
from quern.sources import files

_SENTENCES = f"len(list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?。！？]){SPACE}+', '\\1' || chr(1), 'g'), '\\n{{2,}}', chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')} <> ''))"


@query(
    "token_estimate",
    f"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, CAST(trunc(len({sql_words('text')}) * 1.35::DOUBLE + length(regexp_replace(text, '[\\x00-\\x7f]', '', 'g')) / 4.0::DOUBLE) AS INTEGER)) END AS tokens,
    len({sql_words('text')}) AS words, {_SENTENCES} AS sentences FROM documents""", ints=("words", "sentences"))
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(t).alias("tokens"), T.word_count(t).alias("words"), F.size(T.sentences(t)).alias("sentences"))


@query(
    "word_gate",
    f"""SELECT conv_id, turn, len(list_filter({sql_words('text')}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) AS counted,
    CASE WHEN {sql_strip("coalesce(text, '')")} = '' THEN 'empty' WHEN len(list_filter({sql_words('text')}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) < 8 THEN 'too_short' ELSE 'keep' END AS outcome FROM conversations""", ints=("counted",))
def word_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.counted_words(t).alias("counted"), F.coalesce(gate(t, F.lit("paragraph")), F.lit("keep")).alias("outcome"))


_TERMS = f"WITH t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL)"


@query("term_frequency", f"{_TERMS} SELECT doc_id, term, n, round(n * 2.2::DOUBLE / (n + 1.2::DOUBLE), 6) AS weight FROM c")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = encoding.term_counts(table(spark, sf_dir, "documents"), "doc_id")
    return counts.select("doc_id", "term", "n", F.round(encoding.saturated(F.col("n")), 6).alias("weight"))


@query("doc_freq_idf", f"{_TERMS} SELECT term, count(*) AS n_with, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM c GROUP BY term")
def doc_freq_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n_with = encoding.term_counts(docs, "doc_id").groupBy("term").agg(F.count("*").alias("n_with"))
    n_docs = F.broadcast(docs.agg(F.count("*").alias("n_docs")))  # one row
    return n_with.crossJoin(n_docs).select("term", "n_with", F.round(encoding.idf(F.col("n_docs"), F.col("n_with")), 6).alias("idf"))


def _murmur(terms: str) -> str:
    """CTEs that end in ``bk`` (term, bucket): MurmurHash3 of the terms of a table by whole numbers of 64 bits."""
    u = lambda x: f"{x}::UBIGINT"
    rotl = lambda x, r: f"(((({x}) << {r}) | (({x}) >> {32 - r})) & {u(0xFFFFFFFF)})"
    low = lambda x: f"(({x}) % {u(1 << 32)})"
    byte = lambda i: f"p[8 * k + {2 * i + 1}:8 * k + {2 * i + 2}]"
    block = f"('0x' || {byte(3)} || {byte(2)} || {byte(1)} || {byte(0)})::UBIGINT"
    shifted = lambda r: f"xor(h, h >> {r})"
    return f"""m0 AS (SELECT term, octet_length(encode(term)) AS n, rpad(hex(encode(term)), ((octet_length(encode(term)) + 3) // 4 * 8)::INTEGER, '0') AS p FROM (SELECT DISTINCT term FROM {terms})),
    m1 AS (SELECT term, n, list_transform(range(0, (n + 3) // 4), lambda k: {low(f"{block} * {u(0xCC9E2D51)}")}) AS b FROM m0),
    m2 AS (SELECT term, n, list_transform(b, lambda x: {low(f"{rotl('x', 15)} * {u(0x1B873593)}")}) AS b FROM m1),
    m3 AS (SELECT term, n, list_reduce(list_prepend({u(0)}, b[1:n // 4]), lambda h, x: {low(f"{rotl('xor(h, x)', 13)} * {u(5)} + {u(0xE6546B64)}")}) AS h, CASE WHEN n % 4 > 0 THEN b[n // 4 + 1] ELSE {u(0)} END AS tail FROM m2),
    m4 AS (SELECT term, xor(xor(h, tail), n::UBIGINT) AS h FROM m3), m5 AS (SELECT term, {low(f"{shifted(16)} * {u(0x85EBCA6B)}")} AS h FROM m4), m6 AS (SELECT term, {low(f"{shifted(13)} * {u(0xC2B2AE35)}")} AS h FROM m5),
    bk AS (SELECT term, ({shifted(16)} % {BUCKETS})::INTEGER AS bucket FROM m6)"""


@query(
    "sparse_vectors",
    f"""WITH t AS (SELECT item_id, unnest({sql_tokens('text')}) AS term FROM benchmark), {_murmur('t')}
    SELECT item_id, bucket, round(count(*) * 2.2::DOUBLE / (count(*) + 1.2::DOUBLE), 6) AS value FROM t JOIN bk USING (term) GROUP BY ALL""",
)
def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoding.sparse_vectors(table(spark, sf_dir, "benchmark"), "item_id")
    return found.select("item_id", "bucket", F.round("value", 6).alias("value"))


@query(
    "token_buckets",
    f"""WITH t AS (SELECT unnest({sql_tokens('text')}) AS term FROM documents), c AS (SELECT term, count(*) AS n FROM t GROUP BY term), {_murmur('c')}
    SELECT bucket, count(*) AS terms, sum(n)::BIGINT AS tokens FROM c JOIN bk USING (term) GROUP BY bucket""",
)
def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    terms = docs.select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.groupBy(bucket(F.col("term")).alias("bucket")).agg(F.count("*").alias("terms"), F.sum("n").alias("tokens"))


@query(
    "lesson_parse",
    f"""WITH h AS (SELECT doc_id, doc_id % 40 || ' ' || source AS heading FROM documents)
    SELECT doc_id, TRY_CAST(nullif(regexp_extract(heading, '^\\s*(\\d+)\\s+(.+)$', 1), '') AS INTEGER) AS lesson_number, {sql_strip("regexp_extract(heading, '^\\s*(\\d+)\\s+(.+)$', 2)")} AS lesson_title FROM h""",
)
def lesson_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", (F.col("doc_id") % 40).cast("string"), "source").alias("heading"))
    return rows.select("doc_id", T.lesson_number(F.col("heading")).alias("lesson_number"), T.lesson_title(F.col("heading")).alias("lesson_title"))


_NS = T.NAMESPACE.hex


@query(
    "stable_ids",
    f"""WITH s AS (SELECT doc_id, sha1(unhex('{_NS}') || encode(doc_id || ':1:paragraph:0')) AS d FROM documents)
    SELECT doc_id, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || lower(printf('%02x', (('0x' || d[17:18])::INTEGER & 63) | 128)) || d[19:20] || '-' || d[21:32] AS chunk_id,
    'C-' || upper(sha256(doc_id::VARCHAR)[1:10]) AS citation FROM s""",
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.chunk_id(F.col("doc_id"), F.lit(1), F.lit("paragraph"), F.lit(0)).alias("chunk_id"), T.citation_id(F.col("doc_id")).alias("citation"))


@query("html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page read as an HTML file."""
    pages = table(spark, sf_dir, "pages")
    found = files.units(pages.select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"), F.lit("text/html").alias("content_type")))
    return found.select(F.col("path").cast("bigint").alias("page_id"), "reader", F.try_element_at("blocks", F.lit(1))["text"].alias("text"), "error")

"""Queries over a collection: counts, facets, top-k by terms and vectors, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import cells
from quern.operators import collection as C
from quern.operators import search as S
from quern.plans.registry import query, sql_dot, sql_estimate, sql_strip, sql_tokens, sql_unit, sql_uuid5, sql_words, table
from quern.sources.tables import new_path, stored
from quern.streaming import index


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the source as user, the language as title."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("user_id"), "text", F.col("lang").alias("lesson_title"), F.lit(None).cast("int").alias("page_number"), F.lit("paragraph").alias("block_type"), F.col("source").alias("source_file"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("user_id"), "text")


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the chunks of one user."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit(0).alias("user_id"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks, the label as user."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("user_id"), "embedding")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 asks."""
    return _vectors(spark, sf_dir).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "user_id", "embedding")


_SPARSE = f"""dt AS (SELECT chunk_id, term, count(*) AS n FROM (SELECT doc_id AS chunk_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS n FROM (SELECT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM dt GROUP BY term),
ss AS (SELECT query_id, chunk_id, round(sum(dt.n * 2.2::DOUBLE / (dt.n + 1.2::DOUBLE) * (qt.n * 2.2::DOUBLE / (qt.n + 1.2::DOUBLE) * idf)), 6) AS score FROM qt JOIN dt USING (term) JOIN w USING (term) GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ss)"""
_DENSE = f"""u AS (SELECT vec_id AS chunk_id, label AS user_id, {sql_unit('embedding')} AS v FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
ds AS (SELECT q.chunk_id AS query_id, u.chunk_id, round({sql_dot('q.v', 'u.v')}, 6) AS score FROM u JOIN u q ON q.user_id = u.user_id WHERE q.chunk_id % 100 = 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds)"""


@query("sparse_topk", f"WITH {_SPARSE} SELECT query_id, chunk_id, score, rank FROM sr WHERE rank <= 10", ints=("rank",))
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sparse_topk(_shared(spark, sf_dir), _asked(spark, sf_dir), 10)


@query("indexed_topk", f"WITH {_SPARSE} SELECT query_id, chunk_id, score, rank FROM sr WHERE rank <= 10", ints=("rank",))
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``sparse_topk`` from a stored index, which three batches have built over the first texts of some
    documents, so that these are overwritten."""
    path, chunks = new_path(spark, "index"), _shared(spark, sf_dir)
    early = chunks.where("chunk_id % 5 = 0").withColumn("text", F.left("text", F.lit(200)))
    index.add(path, early, 0)
    for batch in (1, 2, 3):
        rows = chunks.where(F.col("chunk_id") % 3 == batch - 1)
        index.add(path, rows, batch, early.join(rows.select("chunk_id"), "chunk_id", "left_semi").withColumn("batch", F.lit(0).cast("bigint")))
    index.merge(spark, path)
    return index.topk(spark, path, _asked(spark, sf_dir), 10)


@query("dense_topk", f"WITH {_DENSE} SELECT query_id, chunk_id, score, rank FROM dr WHERE rank <= 10", ints=("rank",))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dense_topk(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 10)


@query("dense_cells", f"WITH {_DENSE} SELECT query_id, chunk_id, score, rank FROM dr WHERE rank <= 10", ints=("rank",))
def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``dense_topk`` from an index of cells."""
    return cells.topk(cells.build(_vectors(spark, sf_dir)), _vector_queries(spark, sf_dir), 10)[0]


_BOTH = f"""doc AS (SELECT d.doc_id AS chunk_id, coalesce(e.label, d.doc_id % 10) AS user_id, d.text, e.embedding, d.lang FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id),
dt AS (SELECT chunk_id, term, count(*) AS n FROM (SELECT chunk_id, unnest({sql_tokens('text')}) AS term FROM doc) GROUP BY ALL),
w AS (SELECT term, ln(1 + ((SELECT count(*) FROM doc) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM dt GROUP BY term),
ow AS (SELECT chunk_id, user_id, lang FROM doc),
ss AS (SELECT q.chunk_id AS query_id, d.chunk_id, round(sum(d.n * 2.2::DOUBLE / (d.n + 1.2::DOUBLE) * (q.n * 2.2::DOUBLE / (q.n + 1.2::DOUBLE) * idf)), 6) AS score FROM dt q JOIN ow qo ON qo.chunk_id = q.chunk_id JOIN dt d ON d.term = q.term JOIN ow o ON o.chunk_id = d.chunk_id AND o.user_id = qo.user_id JOIN w ON w.term = q.term WHERE q.chunk_id % 100 = 0 GROUP BY ALL),
u AS (SELECT chunk_id, user_id, {sql_unit('embedding')} AS v FROM doc WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
ds AS (SELECT q.chunk_id AS query_id, u.chunk_id, round({sql_dot('q.v', 'u.v')}, 6) AS score FROM u JOIN u q ON q.user_id = u.user_id WHERE q.chunk_id % 100 = 0)"""


def _fused(name: str, fetch: int, among: str = "TRUE") -> str:
    """Both legs over ``among`` (a condition on the query and the chunk), fused; CTEs named by ``name``."""
    legs = "".join(f"""{name}_{leg} AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r, score FROM {rows} WHERE {among} QUALIFY r <= {fetch}), """ for leg, rows in (("s", "ss"), ("d", "ds")))
    return f"""{legs}{name}_b AS (SELECT coalesce(s.query_id, d.query_id) AS query_id, coalesce(s.chunk_id, d.chunk_id) AS chunk_id, d.r AS dense_rank, s.r AS sparse_rank, d.score AS dsc, s.score AS ssc FROM {name}_s s FULL JOIN {name}_d d ON s.query_id = d.query_id AND s.chunk_id = d.chunk_id),
{name}_f AS (SELECT query_id, chunk_id, CASE WHEN max(sparse_rank) OVER (PARTITION BY query_id) IS NULL THEN dsc WHEN max(dense_rank) OVER (PARTITION BY query_id) IS NULL THEN ssc ELSE round(coalesce(1 / (60.0::DOUBLE + dense_rank), 0) + coalesce(1 / (60.0::DOUBLE + sparse_rank), 0), 6) END AS score, dense_rank, sparse_rank FROM {name}_b),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_f)"""


def _combined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents, with the embedding of the same id where there is one, and those that ask. A document without an
    embedding belongs to the user of its last digit and is found by its words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", F.col("lang").alias("lesson_title"), F.lit(None).cast("int").alias("page_number"), F.lit("paragraph").alias("block_type"), F.col("source").alias("source_file"))
    chunks = docs.join(_vectors(spark, sf_dir), "chunk_id", "left").withColumn("user_id", F.coalesce("user_id", (F.col("chunk_id") % 10).cast("int")))
    asked = chunks.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "user_id", "text", "embedding", F.array("lesson_title").alias("titles"), F.when(F.col("chunk_id") % 200 == 0, 0.9).otherwise(0.5).alias("title_confidence"))
    return chunks, asked


@query("hybrid_rrf", f"WITH {_BOTH}, {_fused('h', 30)} SELECT query_id, chunk_id, score, dense_rank, sparse_rank, rank FROM h WHERE rank <= 10", ints=("dense_rank", "sparse_rank", "rank"))
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = _combined(spark, sf_dir)
    asked = stored(asked, "queries")
    return S.hybrid(chunks, asked, 10, prepared=S.prepare(chunks, asked))


_SAME_TITLE = "EXISTS (SELECT 1 FROM ow a, ow b WHERE a.chunk_id = query_id AND b.chunk_id = {rows}.chunk_id AND a.lang = b.lang)"


_WEIGHTED = f"""{_BOTH}, {_fused('g', 90)},
    st AS (SELECT x.* FROM ss x JOIN ow a ON a.chunk_id = x.query_id JOIN ow b ON b.chunk_id = x.chunk_id WHERE a.lang = b.lang),
    dt2 AS (SELECT x.* FROM ds x JOIN ow a ON a.chunk_id = x.query_id JOIN ow b ON b.chunk_id = x.chunk_id WHERE a.lang = b.lang),
    {_fused('t', 270).replace('FROM ss WHERE', 'FROM st WHERE').replace('FROM ds WHERE', 'FROM dt2 WHERE')},
    f AS (SELECT query_id, chunk_id, round(sum(p), 6) AS score FROM (SELECT query_id, chunk_id, 0.8::DOUBLE / (60 + rank) AS p FROM t WHERE rank <= 90 UNION ALL SELECT query_id, chunk_id, 0.2::DOUBLE / (60 + rank) AS p FROM g WHERE rank <= 30) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f)"""


@query("title_weighted_rrf", f"WITH {_WEIGHTED} SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 30", ints=("rank",))
def title_weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query within its own title (weight 0.8) and everywhere (0.2)."""
    chunks, asked = _combined(spark, sf_dir)
    asked = stored(asked, "queries")
    prepared = S.prepare(chunks, asked)
    within = S.hybrid(chunks, S.by_titles(asked), 90, prepared=S.within_titles(prepared))
    return S.title_weighted(within, S.hybrid(chunks, asked, 30, prepared=prepared), 30)


def _diverse(hits: str) -> str:
    """CTEs that pass over the rows of ``hits`` by rank with those kept so far; the last is ``k``."""
    alike = "len(list_filter(f.kept, lambda y: len(list_intersect(y, o.toks)) >= 0.8::DOUBLE * (len(y) + len(o.toks) - len(list_intersect(y, o.toks)))))"
    return f"""tk AS (SELECT h.*, list_distinct({sql_tokens('d.text')}) AS toks FROM {hits} h JOIN documents d ON d.doc_id = h.chunk_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS n FROM tk WHERE len(toks) > 0),
kf AS (SELECT DISTINCT query_id, 0::BIGINT AS n, NULL::BIGINT AS chunk_id, NULL::DOUBLE AS score, false AS keep, []::VARCHAR[][] AS kept FROM o UNION ALL
SELECT query_id, n, chunk_id, score, keep, CASE WHEN keep THEN list_append(kept, toks) ELSE kept END FROM (SELECT o.*, f.kept, len(f.kept) < 10 AND {alike} = 0 AS keep FROM kf f JOIN o ON o.query_id = f.query_id AND o.n = f.n + 1)),
k AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY n) AS rank FROM kf WHERE keep)"""


_HITS = f"""{_WEIGHTED}, hits AS (SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 30 AND query_id % 200 = 0 UNION ALL SELECT query_id, chunk_id, score, rank FROM g WHERE rank <= 30 AND query_id % 200 <> 0), {_diverse('hits')}"""


@query("search_hits", f"WITH RECURSIVE {_HITS} SELECT query_id, chunk_id, score, rank, lang AS title, 0 AS page, 'C-' || upper(sha256(chunk_id::VARCHAR)[1:10]) AS citation FROM k JOIN ow USING (chunk_id)", ints=("rank",))
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = _combined(spark, sf_dir)
    return S.search(chunks, asked)[0].select("query_id", "chunk_id", "score", "rank", "title", "page", "citation")


@query(
    "search_status",
    f"""WITH RECURSIVE {_HITS}, n AS (SELECT query_id, count(*) AS hit_count, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS hit_titles FROM k JOIN ow USING (chunk_id) GROUP BY query_id), c AS (SELECT user_id, count(*) AS total FROM ow GROUP BY user_id)
    SELECT a.chunk_id AS query_id, total AS total_user_chunks, false AS user_has_no_documents, coalesce(hit_count, 0) AS hit_count, CASE WHEN hit_count IS NULL THEN 'no_matches' END AS empty_reason, hit_titles FROM ow a JOIN c USING (user_id) LEFT JOIN n ON n.query_id = a.chunk_id WHERE a.chunk_id % 100 = 0""",
)
def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = _combined(spark, sf_dir)
    return S.search(chunks, asked)[1].select("query_id", "total_user_chunks", "user_has_no_documents", "hit_count", "empty_reason", F.array_join("hit_titles", ",").alias("hit_titles"))


@query("diversify", f"WITH RECURSIVE {_SPARSE}, hits AS (SELECT query_id, chunk_id, score, rank FROM sr WHERE rank <= 30), {_diverse('hits')} SELECT query_id, chunk_id, score, rank FROM k", ints=("rank",))
def diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _shared(spark, sf_dir)
    hits = S.sparse_topk(chunks, _asked(spark, sf_dir), 30).join(chunks.select("chunk_id", "text"), "chunk_id")
    return S.diversify(hits, 10)


@query("chunk_filter", "WITH u AS (SELECT doc_id, text FROM documents WHERE source = (SELECT min(source) FROM documents)) SELECT doc_id, length(text) AS n FROM u WHERE doc_id IN (SELECT doc_id FROM u ORDER BY doc_id LIMIT 12) OR doc_id = 3", ints=("n",))
def chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by their ids: twelve that the smallest source owns; ids of others' chunks are asked for in vain, but for one
    that may be its own."""
    chunks = _chunks(spark, sf_dir)
    user = chunks.agg(F.min("user_id")).first()[0]
    own = [str(r[0]) for r in C.tenant(chunks, user).select("chunk_id").orderBy("chunk_id").limit(12).collect()]
    others = [str(r[0]) for r in chunks.where(F.col("user_id") != user).select("chunk_id").orderBy("chunk_id").limit(5).collect()]
    condition, _ = C.payload_filter({"chunk_id": [*own, *others, "3", ""]})
    return C.tenant(chunks, user).where(condition).select("doc_id", F.length("text").alias("n"))


@query("tenant_filter", "SELECT doc_id, lang FROM documents WHERE source = (SELECT min(source) FROM documents) AND lang IN ('en', 'de')")
def tenant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    user = chunks.agg(F.min("user_id")).first()[0]
    condition, _ = C.payload_filter({"lesson_title": ["en", "de", ""], "no_such_key": ["x"]})
    return C.tenant(chunks, user).where(condition).select("doc_id", F.col("lesson_title").alias("lang"))


@query("count_owned", "SELECT source AS user_id, count(*) AS total_chunks FROM documents GROUP BY source")
def count_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.count_owned(_chunks(spark, sf_dir))


_FACET = "c AS (SELECT source AS user_id, lang AS title, count(*) AS chunk_count FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY chunk_count DESC, title) AS lesson_index, sum(chunk_count) OVER (PARTITION BY user_id) AS total_chunks, false AS truncated FROM c)"


@query("title_facet", f"WITH {_FACET} SELECT user_id, title, chunk_count, lesson_index, total_chunks::BIGINT AS total_chunks, truncated FROM f", ints=("lesson_index",))
def title_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.title_facet(_chunks(spark, sf_dir))


@query("facet_scan_prefix", "WITH r AS (SELECT source AS user_id, lang AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), s AS (SELECT * FROM r WHERE n <= 51), t AS (SELECT user_id, count(*) FILTER (WHERE n <= 50) AS total_chunks, max(n) > 50 AS truncated FROM s GROUP BY user_id) SELECT user_id, title, count(*) AS chunk_count, any_value(total_chunks) AS total_chunks, any_value(truncated) AS truncated FROM s JOIN t USING (user_id) WHERE n <= 50 AND title IS NOT NULL GROUP BY user_id, title")
def facet_scan_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded scan's feature is its limit; 50 rows a user."""
    return C.title_scan(_chunks(spark, sf_dir), "chunk_id", most=50)


@query("catalog_version", f"WITH {_FACET}, l AS (SELECT user_id, string_agg(title, chr(10) ORDER BY lesson_index) AS titles FROM f GROUP BY user_id) SELECT user_id, sha256(titles)[1:12] AS version FROM l")
def catalog_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.catalogue(C.title_facet(_chunks(spark, sf_dir))).select("user_id", "version")


@query("latest_by_key", "SELECT event_type AS key, user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "user_id", "event_id", "value")
    return C.latest(events, ["key", "user_id"], ["event_id"])


@query(
    "payload_projection",
    f"""WITH c AS (SELECT *, {sql_uuid5("doc_id || ':1:text:0'")} AS chunk_id, 'Lesson' || coalesce(' ' || lang, '') AS lesson_title FROM documents WHERE {sql_strip("coalesce(text, '')")} <> '' AND len(list_filter({sql_words('text')}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) >= 8)
    SELECT {sql_uuid5('chunk_id')} AS point_id, doc_id, lesson_title, (doc_id % 40)::INTEGER AS lesson_number, {sql_estimate('text')} AS token_count, 2 AS n_extras FROM c""",
)
def payload_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a collection, past the gate."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(T.chunk_id(F.col("doc_id"), F.lit(1), F.lit("text"), F.lit(0)).alias("chunk_id"), "doc_id", F.col("source").alias("user_id"), "text", F.lit(None).cast("string").alias("lesson_title"), F.array(F.concat_ws(" ", (F.col("doc_id") % 40).cast("string"), F.lit("Lesson"), "lang")).alias("section_path"), F.lit(1).alias("page"), F.lit("text").alias("block_type"), F.lit(0).alias("chunk_index"), T.token_estimate(F.col("text")).alias("token_count"), F.col("source").alias("source_name"), F.create_map(F.lit("table_id"), F.lit("t1"), F.lit("n_rows"), F.lit("3"), F.lit("ocr"), F.lit("false")).alias("extra"))
    return C.payload(chunks.where(C.gate(F.col("text"), F.col("block_type")).isNull())).select("point_id", "doc_id", "lesson_title", "lesson_number", "token_count", F.size("extras").alias("n_extras"))

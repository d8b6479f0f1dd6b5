"""Queries of the chunker with SQL that folds and packs by recursion, and of what readers make of whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking
from quern.plans.registry import SPACE, query, sql_estimate, sql_strip, sql_uuid5, sql_words, table

_FOREIGN = "length(regexp_replace({}, '[\\x00-\\x7f]', '', 'g'))"
_TOKENS = "greatest(1, CAST(trunc(({w}) * 1.35::DOUBLE + ({f}) / 4.0::DOUBLE) AS INTEGER))"


def _total(values: str) -> str:
    return f"coalesce(list_sum({values}), 0)"


def sql_chunks(rows: str, key: str, most: int, overlap: int) -> str:
    """CTEs that end in ``c`` (key, part, piece): texts of ``rows`` (key, text), each a single block, as chunks.

    A text within the limit is one. Sentences above it are cut into word windows (``win``), the rest is packed (``pk``).
    Running sums make each step a count over a list.
    """
    cut = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([.!?。！？]){SPACE}+', '\\1' || chr(1), 'g'), '\\n{{2,}}', chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '')"
    cost = lambda a, e: _TOKENS.format(w=f"{e} - {a}", f=f"cf[{e} + 1] - cf[{a} + 1]")
    window = f"a + 1 + len(list_filter(range(a + 2, len(w) + 1), lambda e: {cost('a', 'e')} <= {most}))"
    back = f"e - len(list_filter(range(a, e), lambda b: {cost('b', 'e')} <= {overlap}))"
    held = f"CASE WHEN s = f THEN 0 ELSE {_TOKENS.format(w=_total('ws[s + 1:f]'), f=_total('fs[s + 1:f]'))} END"
    end = f"f + greatest(1, len(list_filter(range(1, len(ps) - f + 1), lambda j: ({held}) + cc[f + j + 1] - cc[f + 1] <= {most})))"
    tail = f"len(list_filter(range(1, e - s + 1), lambda k: cc[e + 1] - cc[e - k + 1] <= {overlap}))"
    running = lambda xs: f"list_transform(range(0, len({xs}) + 1), lambda i: {_total(f'{xs}[1:i]')})"
    return f"""tx AS (SELECT {key}, {sql_strip("coalesce(text, '')")} AS t FROM {rows}), sz AS (SELECT *, {sql_estimate('t')} AS tok FROM tx WHERE t <> ''),
    se AS (SELECT {key}, unnest(range(1, len(ss) + 1)) AS sn, unnest(ss) AS s, len(ss) AS n FROM (SELECT *, {cut} AS ss FROM sz WHERE tok > {most})),
    lw AS (SELECT {key}, sn, w, {running('fw')} AS cf FROM (SELECT *, list_transform(w, lambda x: {_FOREIGN.format('x')}) AS fw FROM (SELECT {key}, sn, {sql_words('s')} AS w FROM se WHERE n = 1 OR {sql_estimate('s')} > {most}))),
    win AS (SELECT {key}, sn, 0 AS n, 0::BIGINT AS a, 0::BIGINT AS e, 0::BIGINT AS nx FROM lw UNION ALL
    SELECT {key}, sn, n + 1, a, e, CASE WHEN e = len(w) THEN -1 ELSE b + len(list_filter(range(b, e), lambda b: {cost('b', 'e + 1')} > {most})) END FROM (SELECT *, {back} AS b FROM (SELECT *, {window} AS e FROM (SELECT x.{key}, x.sn, x.n, x.nx AS a, lw.w, lw.cf FROM win x JOIN lw ON lw.{key} = x.{key} AND lw.sn = x.sn WHERE x.nx >= 0)))),
    wt AS (SELECT win.{key}, win.sn, win.n, array_to_string(lw.w[win.a + 1:win.e], ' ') AS p FROM win JOIN lw ON lw.{key} = win.{key} AND lw.sn = win.sn WHERE win.n > 0),
    pt AS (SELECT {key}, sn, 0 AS n, s AS p FROM se WHERE se.n > 1 AND {sql_estimate('s')} <= {most} UNION ALL SELECT wt.* FROM wt JOIN (SELECT DISTINCT {key} FROM se WHERE n > 1) m ON m.{key} = wt.{key}),
    pl AS (SELECT {key}, ps, ws, fs, {running('cs')} AS cc FROM (SELECT {key}, list(p ORDER BY sn, n) AS ps, list(len({sql_words('p')}) ORDER BY sn, n) AS ws, list({_FOREIGN.format('p')} ORDER BY sn, n) AS fs, list({sql_estimate('p')} ORDER BY sn, n) AS cs FROM pt GROUP BY {key})),
    pk AS (SELECT {key}, 0 AS n, 0::BIGINT AS s, 0::BIGINT AS e, 0::BIGINT AS ns, 0::BIGINT AS f, len(ps) AS total FROM pl UNION ALL
    SELECT {key}, n + 1, s, e, e - {tail}, e, len(ps) FROM (SELECT *, {end} AS e FROM (SELECT x.{key}, x.n, x.ns AS s, x.f, pl.ps, pl.ws, pl.fs, pl.cc FROM pk x JOIN pl ON pl.{key} = x.{key} WHERE x.f < x.total))),
    c AS (SELECT {key}, 0 AS part, t AS piece FROM sz WHERE tok <= {most} UNION ALL SELECT wt.{key}, wt.n - 1, p FROM wt JOIN se ON se.{key} = wt.{key} AND se.n = 1
    UNION ALL SELECT pk.{key}, pk.n - 1, array_to_string(pl.ps[pk.s + 1:pk.e], ' ') FROM pk JOIN pl ON pl.{key} = pk.{key} WHERE pk.n > 0)"""


@query(
    "chunk_documents",
    f"""WITH RECURSIVE {sql_chunks('documents', 'doc_id', chunking.MAX_TOKENS, chunking.OVERLAP)}
    SELECT doc_id, {sql_uuid5("doc_id || ':1:paragraph:' || part")} AS chunk_id, part AS chunk_index, 'paragraph' AS chunk_type, {sql_estimate('piece')} AS token_count, piece AS text FROM c""", ints=("chunk_index",))
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every whole document, under its source as section, numbered through the document."""
    units = chunking.paragraphs(table(spark, sf_dir, "documents"), "doc_id", section=F.col("source"))
    chunks = chunking.number(chunking.chunk(units, "doc_id", "unit"))
    return chunks.select("doc_id", "chunk_id", "chunk_index", "chunk_type", "token_count", "text")


@query("word_windows", f"WITH RECURSIVE {sql_chunks('benchmark', 'item_id', 24, 8)} SELECT item_id, part, {sql_estimate('piece')} AS token_count, piece AS text FROM c", ints=("part",))
def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at a small limit: sentences, and words of sentences above it."""
    units = chunking.paragraphs(table(spark, sf_dir, "benchmark"), "item_id")
    return chunking.chunk(units, "item_id", most=24, overlap=8).select("item_id", "part", "token_count", "text")


_MOST, _OVERLAP = 100, 30
_SUM = "coalesce(list_sum(list_transform({}, lambda x: costs[x])), 0)"
_TAIL = f"h1[len(h1) + 1 - len(list_filter(range(1, len(h1) + 1), lambda k: {_SUM.format('h1[len(h1) + 1 - k:]')} <= {_OVERLAP})):]"
_NONE = "[]::BIGINT[]"


@query(
    "block_chunks",
    f"""WITH RECURSIVE w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
    b AS (SELECT doc_id, i + 1 AS i, array_to_string(w[20 * i + 1:20 * i + 20], ' ') AS t, 's' || i // 5 AS sect, CASE WHEN i % 7 = 4 THEN 'table' WHEN i % 3 = 0 THEN 'list' ELSE 'paragraph' END AS kind FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 19) // 20)) AS i FROM w)),
    l AS (SELECT doc_id, list({sql_estimate('t')} ORDER BY i) AS costs, list(sect ORDER BY i) AS sects, list(kind ORDER BY i) AS kinds, list(t ORDER BY i) AS ts, count(*) AS total FROM b GROUP BY doc_id),
    f AS (SELECT doc_id, 0::BIGINT AS n, {_NONE} AS held, 0 AS fresh, []::BIGINT[][] AS outs FROM l UNION ALL
    SELECT doc_id, n, CASE WHEN alone THEN h2 ELSE h2 || [n] END, CASE WHEN alone THEN f2 ELSE f2 + 1 END, out1 || out2 || CASE WHEN alone THEN [[n]] ELSE [] END FROM
    (SELECT *, CASE WHEN fl AND f1 > 0 THEN [h1] ELSE [] END AS out2, CASE WHEN fl THEN {_TAIL} ELSE h1 END AS h2, CASE WHEN fl THEN 0 ELSE f1 END AS f2 FROM
    (SELECT *, alone OR (len(h1) > 0 AND {_SUM.format('h1')} + costs[n] > {_MOST}) AS fl FROM
    (SELECT *, coalesce(kinds[n] = 'table', false) AS alone, CASE WHEN brk AND fresh > 0 THEN [held] ELSE [] END AS out1, CASE WHEN brk THEN {_NONE} ELSE held END AS h1, CASE WHEN brk THEN 0 ELSE fresh END AS f1 FROM
    (SELECT *, len(held) > 0 AND (n > total OR sects[n] <> sects[held[-1]]) AS brk FROM (SELECT l.*, f.n + 1 AS n, f.held, f.fresh FROM f JOIN l USING (doc_id) WHERE f.n <= l.total)))))),
    e AS (SELECT doc_id, n, unnest(range(1, len(outs) + 1)) AS k, unnest(outs) AS ids FROM f),
    x AS (SELECT e.doc_id, row_number() OVER (PARTITION BY e.doc_id ORDER BY n, k) - 1 AS part, sects[ids[1]] AS sect, list_distinct(list_transform(ids, lambda i: kinds[i])) AS ks, array_to_string(list_transform(ids, lambda i: ts[i]), chr(10) || chr(10)) AS text FROM e JOIN l USING (doc_id))
    SELECT doc_id, {sql_uuid5("doc_id || ':1:' || CASE WHEN len(ks) = 1 THEN ks[1] ELSE 'text' END || ':' || part")} AS chunk_id, part AS chunk_index, CASE WHEN len(ks) = 1 THEN ks[1] ELSE 'text' END AS chunk_type, {sql_estimate('text')} AS token_count, sect || chr(10) || text AS embed_text FROM x""", ints=("chunk_index",))
def block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twenty words of a document as a block, five blocks a section, among them tables, at a limit of 100 tokens."""
    words = T.words(F.col("text"))
    kind = lambda i: F.when(i % 7 == 4, "table").when(i % 3 == 0, "list").otherwise("paragraph")
    block = lambda w, i: F.struct(kind(i).alias("block_type"), F.array_join(F.slice(w, i * 20 + 1, F.lit(20)), " ").alias("text"), F.array(F.concat(F.lit("s"), F.floor(i / 5).cast("string"))).alias("section_path"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("map<string,string>").alias("metadata"))
    made = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(w) / 20).cast("int") - 1)), lambda i: block(w, i))
    units = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("unit"), words.alias("w")).select("doc_id", "unit", made(F.col("w")).alias("blocks"))
    chunks = chunking.number(chunking.chunk(units, "doc_id", "unit", most=_MOST, overlap=_OVERLAP))
    return chunks.select("doc_id", "chunk_id", "chunk_index", "chunk_type", "token_count", "embed_text")

"""Queries over page layout and files: lines from spans, split titles, sections over pages, tables, pictures, readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import layout
from quern.plans.registry import file_order, query, sql_strip, table
from quern.sources import files


@query(
    "line_assembly",
    f"""WITH s AS (SELECT l_orderkey AS doc_id, (l_partkey % 2)::INTEGER AS line_no, l_linenumber AS span_no, CASE WHEN l_linenumber % 4 = 0 THEN '  ' ELSE repeat(l_returnflag, (l_suppkey % 7 + 1)::INTEGER) || ' ' END AS text, l_quantity AS size, l_linestatus = 'O' AS bold FROM lineitem),
    c AS (SELECT *, length({sql_strip('text')}) AS chars FROM s), u AS (SELECT doc_id, line_no, size, sum(chars) OVER (PARTITION BY doc_id, line_no ORDER BY size) AS upto, sum(chars) OVER (PARTITION BY doc_id, line_no) AS total FROM c WHERE chars > 0),
    z AS (SELECT doc_id, line_no, min(size) AS size FROM u WHERE upto >= total / 2 GROUP BY ALL), t AS (SELECT doc_id, line_no, string_agg(text, '' ORDER BY span_no, text) AS text, sum(CASE WHEN bold THEN chars ELSE 0 END) >= 0.6::DOUBLE * sum(chars) AS bold FROM c GROUP BY ALL)
    SELECT doc_id, line_no, text, size, bold FROM t JOIN z USING (doc_id, line_no) WHERE {sql_strip('text')} <> ''""",
)
def line_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as spans of two lines an order, every fourth one blank, sized by quantity."""
    text = F.when(F.col("l_linenumber") % 4 == 0, "  ").otherwise(F.concat(F.expr("repeat(l_returnflag, cast(l_suppkey % 7 + 1 AS int))"), F.lit(" ")))
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_partkey") % 2).cast("int").alias("line_no"), F.col("l_linenumber").alias("span_no"), text.alias("text"), F.col("l_quantity").alias("size"), (F.col("l_linestatus") == "O").alias("bold"))
    return layout.assemble_lines(spans).select("doc_id", "line_no", "text", "size", "bold")


@query(
    "titles_joined",
    """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, 'Part ' || l_partkey || CASE WHEN l_partkey % 5 = 0 THEN '.' ELSE '' END AS text, CASE WHEN l_linenumber % 3 = 0 THEN 10.0 ELSE 20.0 + l_quantity % 2 / 2 END::DOUBLE AS size, l_linenumber * 12.0 AS y0 FROM lineitem),
    b AS (SELECT doc_id, median(size) AS body FROM l GROUP BY doc_id), t AS (SELECT l.*, body, size >= body * 1.6::DOUBLE AND NOT text LIKE '%.' AS is_title FROM l JOIN b USING (doc_id)),
    n AS (SELECT *, lag(size) OVER w AS above_size, lag(y0) OVER w AS above_y0, lead(size) OVER w AS below_size, lead(y0) OVER w AS below_y0, lead(text) OVER w AS below FROM t WINDOW w AS (PARTITION BY doc_id, is_title ORDER BY y0, line_no))
    SELECT doc_id, line_no, body, CASE WHEN is_title AND coalesce(abs(size - below_size) <= 0.6 AND below_y0 - y0 - 10 BETWEEN 0 AND 18, false) THEN text || ' ' || below ELSE text END AS text,
    is_title AND NOT coalesce(abs(size - above_size) <= 0.6 AND y0 - above_y0 - 10 BETWEEN 0 AND 18, false) AS is_title FROM n""",
)
def titles_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines close to each other; two of three are large enough for a title if most of their page is small. Lines
    of one number stand in the file's order."""
    k = F.col("l_linenumber")
    size = F.when(k % 3 == 0, 10.0).otherwise(20.0 + F.col("l_quantity") % 2 / 2)
    text = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 5 == 0, ".").otherwise(""))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), k.alias("line_no"), text.alias("text"), size.alias("size"), F.lit(0.0).alias("x0"), (k * 12.0).alias("y0"), F.lit(100.0).alias("x1"), (k * 12.0 + 10).alias("y1"), *file_order())
    return layout.titled(rows, ("file", "row")).select("doc_id", "line_no", "body", "text", "is_title")


@query(
    "section_pages",
    """WITH l AS (SELECT l_orderkey % 50 AS doc_id, (l_orderkey // 50)::INTEGER AS page, l_linenumber AS line_no, 'Part ' || l_partkey AS text, l_quantity >= 49 AS is_title FROM lineitem),
    n AS (SELECT doc_id, page, line_no, max(CASE WHEN is_title THEN text END) AS title FROM l GROUP BY ALL), s AS (SELECT doc_id, page, line_no, last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS section FROM n)
    SELECT doc_id, page, line_no, section FROM l JOIN s USING (doc_id, page, line_no)""",
)
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of fifty documents, so that most sections begin on an earlier page."""
    y = F.col("l_linenumber") * 40.0
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("doc_id"), F.floor(F.col("l_orderkey") / 50).cast("int").alias("page"), F.col("l_linenumber").alias("line_no"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_quantity") >= 49).alias("is_title"), y.alias("y0"))
    return layout.with_sections(rows).select("doc_id", "page", "line_no", "section")


@query(
    "table_markdown",
    """WITH t AS (SELECT s_nationkey AS doc_id, s_suppkey AS table_no, CASE WHEN s_suppkey % 11 <> 0 THEN '| Part | a\\|b |' || chr(10) || '| --- | --- |' || chr(10) || '| n' || s_suppkey % 3 || ' |  |' END AS markdown FROM supplier)
    SELECT doc_id, min(table_no) AS table_no, markdown FROM t WHERE markdown IS NOT NULL GROUP BY doc_id, markdown""",
)
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tables of their nation, every eleventh of blanks only; equal ones of a nation are one."""
    k = F.col("s_suppkey")
    text = F.array(F.array(F.lit(" Part"), F.lit("a|b")), F.array(F.lit(""), F.lit(None).cast("string")), F.array(F.concat(F.lit("n"), (k % 3).cast("string"))))
    blank = F.array(F.array(F.lit(" "), F.lit("")), F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.lit(1).alias("page"), k.alias("table_no"), F.when(k % 11 != 0, text).otherwise(blank).alias("rows"))
    return layout.tables(rows).select("doc_id", "table_no", "markdown")


@query("recognition_pages", f"SELECT source AS doc_id, (doc_id % 500)::INTEGER AS page, sum(length({sql_strip("coalesce(text, '')")}))::BIGINT AS chars FROM documents GROUP BY ALL HAVING sum(length({sql_strip("coalesce(text, '')")})) < 80")
def recognition_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks of five hundred pages for each source."""
    blocks = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), (F.col("doc_id") % 500).cast("int").alias("page"), "text")
    return layout.needs_recognition(blocks).select("doc_id", "page", "chars")


@query(
    "placed_images",
    """WITH p AS (SELECT l_orderkey AS doc_id, l_partkey % 5 AS xref, min(l_linenumber) AS order_no, arg_max(l_quantity * 10, l_linenumber) AS width, arg_max(l_suppkey % 300 + 50, l_linenumber) AS height, max(l_linenumber * 10.0) AS area FROM lineitem GROUP BY ALL)
    SELECT doc_id, xref, order_no, height FROM p WHERE width >= 120 AND height >= 120 AND area / 1000.0 >= 0.02 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY order_no) <= 8""",
)
def placed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as places of pictures, five a page; the last place is the largest, of several the first in the file."""
    k = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_partkey") % 5).alias("xref"), k.alias("order_no"), (F.col("l_quantity") * 10).alias("width"), (F.col("l_suppkey") % 300 + 50).alias("height"), (k * 10.0).alias("area"), F.lit(1000.0).alias("page_area"), *file_order())
    return layout.images(rows, ("file", "row")).select("doc_id", "xref", "order_no", "height")


@query("unit_sections", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || ' > ' || lang WHEN 1 THEN lang ELSE 'Page ' || doc_id END AS section FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def unit_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks a document; the first has a path, or the second, or none."""
    none = F.array().cast("array<string>")
    path = lambda at, value: F.struct(F.when(F.col("doc_id") % 3 == at, value).otherwise(none).alias("section_path"))
    blocks = F.array(path(0, F.array("source", "lang")), path(1, F.array("lang")))
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    return rows.select("doc_id", F.array_join(layout.section_of(blocks, F.concat(F.lit("Page "), F.col("doc_id").cast("string"))), " > ").alias("section"))


_FILE = "CASE WHEN c_custkey % 13 = 0 THEN 'xyz' ELSE ['csv', 'tsv', 'json', 'jsonl', 'md', 'html'][(c_custkey % 6 + 1)::INTEGER] END"


@query(
    "read_files",
    f"""WITH f AS (SELECT c_custkey AS id, c_name, c_mktsegment AS seg, {_FILE} AS suffix FROM customer)
    SELECT id, CASE suffix WHEN 'xyz' THEN NULL WHEN 'tsv' THEN 'csv' WHEN 'jsonl' THEN 'json' WHEN 'md' THEN 'text' ELSE suffix END AS reader, CASE WHEN suffix <> 'xyz' THEN 'f' || id || '.' || suffix END AS label, CASE WHEN suffix IN ('csv', 'tsv') THEN 'table' WHEN suffix <> 'xyz' THEN 'text' END AS block_type,
    CASE suffix WHEN 'csv' THEN c_name || ' | ' || seg || ', x' || chr(10) || id || ' | padded' WHEN 'tsv' THEN c_name || ' | a,b | ' || seg WHEN 'md' THEN '# ' || c_name || chr(10) || '<b>' || seg WHEN 'html' THEN c_name || chr(10) || seg || ' & more'
    WHEN 'json' THEN concat_ws(chr(10), '{{', '  "name": "' || c_name || '",', '  "key": ' || id || ',', '  "tags": [', '    "é",', '    null', '  ],', '  "x": 1.5', '}}')
    WHEN 'jsonl' THEN concat_ws(chr(10), '[', '  {{', '    "a": ' || id, '  }},', '  "' || seg || '"', ']') END AS text, CASE WHEN suffix = 'xyz' THEN 'ValueError: unsupported' END AS error FROM f""",
)
def read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files of six formats, each in its own writing, and of one that no reader knows. A table of some
    megabytes makes very many files, so its rows are dealt to all tasks before they become such."""
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    key = k.cast("string")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    contents = {
        "csv": text(name, ',"', seg, ', x"\n', key, ", padded \n"), "tsv": text(name, "\ta,b\t ", seg), "json": text('{"name":"', name, '","key": ', key, ',"tags":["é", null],"x":1.5}'),
        "jsonl": text('{"a":', key, '}\n\n"', seg, '"\n'), "md": text("# ", name, "\n<b>", seg), "html": text("<html><style>p {}</style><p> ", name, " </p><script>x</script><div>", seg, " &amp; more</div></html>"),
    }
    suffix = F.when(k % 13 == 0, "xyz").otherwise(F.element_at(F.array(*map(F.lit, contents)), (k % 6 + 1).cast("int")))
    content = F.coalesce(*[F.when(F.col("suffix") == s, c) for s, c in contents.items()], F.lit("?"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey").withColumn("suffix", suffix)
    found = files.units(rows.select(F.concat(F.lit("/in/f"), key, F.lit("."), F.col("suffix")).alias("path"), F.encode(content, "UTF-8").alias("content"), F.lit(None).cast("string").alias("content_type")))
    block = F.try_element_at("blocks", F.lit(1))
    return found.select(F.regexp_extract("path", r"f(\d+)\.", 1).cast("bigint").alias("id"), "reader", "label", block["block_type"].alias("block_type"), block["text"].alias("text"), "error")

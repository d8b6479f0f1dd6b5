"""Queries over records: pages, conversations, citations, practice, memory, cache, tokens, page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import cache, identity, layout, memory, practice, records
from quern.plans.registry import query, sql_dot, sql_strip, sql_unit, table

_PAGE = 20


@query("keyset_first_page", f"WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, count(*) OVER (PARTITION BY o_custkey) > {_PAGE} AS more FROM orders) SELECT o_custkey, o_orderkey, place, more FROM r WHERE place <= {_PAGE}", ints=("place",))
def keyset_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest orders of every customer."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return records.keyset_pages(rows, "o_custkey", "o_orderdate", "o_orderkey", _PAGE).select("o_custkey", "o_orderkey", "place", "more")


@query("keyset_next_page", f"WITH a AS (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1 OFFSET {_PAGE - 1}) SELECT o.o_orderkey, o.o_totalprice FROM orders o, a WHERE (o.o_orderdate, o.o_orderkey) < (a.o_orderdate, a.o_orderkey) ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT {_PAGE}")
def keyset_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of all orders, by the cursor that ends the first."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    last = records.keyset_page(rows, "o_orderdate", "o_orderkey", _PAGE, ascending=True).first()
    cursor = (last.o_orderdate, last.o_orderkey) if last else None
    return records.keyset_page(rows, "o_orderdate", "o_orderkey", _PAGE, cursor).select("o_orderkey", "o_totalprice")


@query("message_normalise", "WITH o AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) AS n FROM conversations), f AS (SELECT conv_id, min(n) AS first FROM o WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, turn, role, n - first + 1 AS place FROM o JOIN f USING (conv_id) WHERE n >= first", ints=("place",))
def message_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in order, two of a turn at one time."""
    rows = table(spark, sf_dir, "conversations").withColumn("at", F.floor(F.col("turn") / 2))
    return records.normalise_messages(rows, "conv_id", "at", "turn").select("conv_id", "turn", "role", "place")


@query("turn_slice", "WITH l AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS last FROM conversations GROUP BY conv_id) SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN l USING (conv_id) WHERE last IS NULL OR turn > last")
def turn_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.turn_slice(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("final_reply", f"SELECT conv_id, arg_max(text, turn) AS reply, max(turn) AS at FROM conversations WHERE role = 'assistant' AND {sql_strip('text')} <> '' GROUP BY conv_id")
def final_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.final_reply(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


_TURNS = "CASE WHEN role = 'user' THEN 1 END"


@query("turn_numbers", f"SELECT conv_id, turn, count({_TURNS}) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS user_turn FROM conversations")
def turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.turn_numbers(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("i"), "role"), "conv_id", "i")
    return rows.select("conv_id", F.col("i").alias("turn"), F.col("turn").alias("user_turn"))


_CITE = "'C-' || upper(sha256((conv_id * 10 + {k})::VARCHAR)[1:10])"


@query(
    "cite_resolve",
    f"""WITH r AS (SELECT DISTINCT conv_id FROM conversations), c AS (SELECT conv_id, 0 AS place, {_CITE.format(k=1)} AS citation, (conv_id * 10 + 1)::VARCHAR AS chunk_id, true AS valid FROM r UNION ALL SELECT conv_id, 1, {_CITE.format(k=9)}, NULL, false FROM r) SELECT * FROM c""",
)
def cite_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each conversation that cites a passage it was shown, twice, and one it wasn't."""
    convs = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    name = lambda k: T.citation_id((F.col("conv_id") * 10 + k).cast("string"))
    replies = convs.select("conv_id", F.concat(F.lit("So it is ["), name(1), F.lit("], and not ["), name(9), F.lit("]; again ["), name(1), F.lit("]")).alias("reply"))
    passages = convs.select("conv_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select("conv_id", (F.col("conv_id") * 10 + F.col("k")).cast("string").alias("chunk_id"))
    return records.resolve_citations(replies, passages, "conv_id")


_RAW = "CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 30 THEN 1 ELSE NULL END"


@query(
    "mark_choice",
    f"SELECT l_orderkey, l_linenumber, {_RAW} = l_linenumber % 2 AS is_correct, CASE WHEN {_RAW} IS NULL THEN NULL WHEN {_RAW} = l_linenumber % 2 THEN 10 ELSE 0 END::DOUBLE AS marks, CASE WHEN {_RAW} IS NULL THEN 'selected_index' END AS reject_reason FROM lineitem",
)
def mark_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an order as an answer: the quantity chooses, the line number is right."""
    selected = F.when(F.col("l_quantity") <= 10, 0).when(F.col("l_quantity") <= 30, 1)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", selected.alias("selected_index"), (F.col("l_linenumber") % 2).alias("correct_index"), F.lit(10).alias("max_marks"), F.lit(None).cast("string").alias("explanation"))
    return practice.mark_choice(rows).select("l_orderkey", "l_linenumber", "is_correct", F.col("marks").cast("double").alias("marks"), "reject_reason")


@query(
    "rubric_rescale",
    """WITH s AS (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY l_orderkey), m AS (SELECT l_orderkey, l_linenumber, CASE WHEN abs(total - 10) > 0.01 THEN CAST(round_even(CAST(l_quantity * 10 / total AS DECIMAL(30, 12)), 1) AS DOUBLE) ELSE l_quantity END AS marks FROM lineitem JOIN s USING (l_orderkey))
    SELECT l_orderkey, count(*) AS points, round(sum(marks), 6) AS marks FROM m GROUP BY l_orderkey""",
)
def rubric_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as a question's rubric, their quantities as marks."""
    point = F.struct(F.col("l_linenumber").cast("string").alias("point"), F.col("l_quantity").cast("string").alias("marks"))
    q = F.struct(F.lit("What is it?").alias("question"), F.array().cast("array<string>").alias("options"), F.lit(None).cast("string").alias("correct_index"), F.lit(None).cast("string").alias("explanation"), F.lit(None).cast("string").alias("model_answer"), F.col("rubric"), F.array(F.lit("1"), F.lit("x")).alias("source_pages"))
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(point)).alias("rubric")).select("l_orderkey", F.lit("essay").alias("qtype"), F.array(q).alias("questions"))
    return practice.normalise(sets, "l_orderkey").select("l_orderkey", F.size("rubric").cast("bigint").alias("points"), F.round(F.aggregate("rubric", F.lit(0.0), lambda a, r: a + r["marks"]), 6).alias("marks"))


@query(
    "mark_written",
    "WITH a AS (SELECT l_orderkey, l_linenumber, least(l_quantity, greatest(0, l_discount * 1000 - 20)) AS awarded FROM lineitem) SELECT l_orderkey, CAST(greatest(0, least(100, sum(CAST(round(awarded, 6) AS DECIMAL(18, 6))))) AS DOUBLE) AS marks FROM a GROUP BY l_orderkey",
)
def mark_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as a rubric and what a judge awarded for each."""
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("ls"))
    rows = rows.select("l_orderkey", F.transform("ls", lambda x: F.struct(x["l_linenumber"].cast("string").alias("point"), x["l_quantity"].alias("marks"))).alias("rubric"), F.transform("ls", lambda x: F.struct(F.round(x["l_discount"] * 1000 - 20, 6).alias("awarded_marks"), F.lit(None).cast("string").alias("feedback"))).alias("judged"), F.lit("text").alias("answer_text"), F.lit(100).alias("max_marks"))
    return practice.mark_written(rows).select("l_orderkey", F.col("marks").cast("double").alias("marks"))


@query("practice_totals", "SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 10 ELSE 0 END)::BIGINT AS marks, sum(10)::BIGINT AS max_marks, round(sum(CASE WHEN l_returnflag = 'R' THEN 10 ELSE 0 END) * 100 / sum(10)::DOUBLE, 2) AS pct FROM lineitem GROUP BY l_orderkey")
def practice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", 10).otherwise(0).alias("marks"), F.lit(10).alias("max_marks"))
    return practice.totals(rows, "l_orderkey")


_MEM = f"m AS (SELECT vec_id, label, {sql_unit('embedding')} AS v, CASE WHEN vec_id % 3 = 0 THEN 'semantic' WHEN vec_id % 3 = 1 THEN 'episodic' ELSE 'procedural' END AS kind FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0)"


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    kind = F.when(F.col("vec_id") % 3 == 0, "semantic").when(F.col("vec_id") % 3 == 1, "episodic").otherwise("procedural")
    return v.select(F.col("vec_id").alias("memory_id"), F.col("label").alias("user_id"), kind.alias("kind"), F.lit(True).alias("active"), (F.col("vec_id") % 7 != 0).alias("rule_active"), F.col("vec_id").alias("updated_at"), "embedding")


@query(
    "memory_recall",
    f"""WITH {_MEM}, n AS (SELECT q.vec_id AS query_id, m.kind, m.vec_id AS memory_id, round(greatest(0, {sql_dot('q.v', 'm.v')}), 6) AS score FROM m q JOIN m ON q.label = m.label WHERE q.vec_id % 100 = 0 AND m.kind <> 'procedural'),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, memory_id) AS rank FROM n), p AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rank FROM m WHERE kind = 'procedural')
    SELECT query_id, kind, memory_id, score, rank FROM r WHERE rank <= CASE kind WHEN 'semantic' THEN 6 ELSE 2 END UNION ALL SELECT q.vec_id, 'procedural', p.vec_id, 1.0, p.rank FROM m q JOIN p ON p.label = q.label WHERE q.vec_id % 100 = 0 AND p.rank <= 8 AND p.vec_id % 7 <> 0""", ints=("rank",))
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 recalls what its label remembers."""
    stored = _memories(spark, sf_dir)
    asked = stored.where("memory_id % 100 = 0").select(F.col("memory_id").alias("query_id"), "user_id", F.lit("a question").alias("text"), "embedding")
    return memory.recall(stored, asked)


@query("memory_upsert", "WITH o AS (SELECT user_id, event_type, max(event_id) AS e FROM events WHERE event_id % 2 = 0 GROUP BY ALL), n AS (SELECT user_id, event_type, max(event_id) AS e FROM events WHERE event_id % 2 = 1 GROUP BY ALL) SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS kind, greatest(o.e % 10, n.e % 10) AS version, coalesce(n.e, o.e) AS payload FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type")
def memory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events as stored memories, odd ones as those put."""
    events = table(spark, sf_dir, "events")
    side = lambda odd: events.where(F.col("event_id") % 2 == odd).groupBy("user_id", F.col("event_type").alias("kind")).agg(F.max("event_id").alias("payload")).select("user_id", "kind", (F.col("payload") % 10).alias("version"), "payload")
    return memory.put(side(0), side(1), ["user_id", "kind"])


@query(
    "rule_merge",
    f"""WITH {_MEM}, w AS (SELECT vec_id, label, v, string_split('always answer with an example and the page ' || vec_id % 5, ' ') AS words FROM m),
    n AS (SELECT q.vec_id AS new_id, s.vec_id AS memory_id, q.words AS a, s.words AS b, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0, {sql_dot('q.v', 's.v')}), 6) DESC, s.vec_id) AS rank FROM w q JOIN w s ON q.label = s.label WHERE q.vec_id % 2 = 1 AND s.vec_id % 2 = 0),
    b AS (SELECT new_id, arg_min(memory_id, rank) AS memory_id FROM n WHERE rank <= 8 AND len(list_intersect(a, b)) >= 0.6::DOUBLE * len(list_distinct(a || b)) GROUP BY new_id)
    SELECT vec_id AS new_id, memory_id, CASE WHEN memory_id IS NULL THEN 1 ELSE 3 END AS version FROM embeddings LEFT JOIN b ON new_id = vec_id WHERE vec_id % 2 = 1""",
)
def rule_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rules of their label; the odd ones arrive, the even ones are stored."""
    v = table(spark, sf_dir, "embeddings")
    words = F.concat(F.lit("always answer with an example and the page "), (F.col("vec_id") % 5).cast("string"))
    rows = v.select("vec_id", F.col("label").alias("user_id"), F.lit("answer").alias("scope"), words.alias("instruction"), F.lit(2).alias("version"), F.lit(True).alias("active"), "embedding")
    return memory.merge_rules(rows.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "memory_id"), rows.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "new_id"))


def _says(pattern: str) -> str:
    return "regexp_matches(t, '(?i)" + pattern.replace("'", "''") + "')"


_PHRASES = cache.Phrases()
_POLICY = f"""CASE WHEN {_says(_PHRASES.greeting)} THEN 'greeting' WHEN {_says(_PHRASES.personal)} THEN 'personal' WHEN h AND {_says(_PHRASES.follow_up)} THEN 'followup'
WHEN h THEN 'has_history' WHEN length(t) < 12 THEN 'too_short' ELSE 'cacheable' END"""


@query("cache_policy", f"WITH c AS (SELECT conv_id, turn, turn > 1 AS h, {sql_strip('text')} AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn, {_POLICY} AS decision FROM c")
def cache_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", cache.request_policy(F.col("text"), F.col("turn") > 1).alias("decision"))


@query(
    "cache_scope",
    "SELECT c_custkey, c_custkey || ':' || sha256(CASE WHEN c_custkey % 3 = 0 THEN 'all' ELSE 'd1,d2' END || ':' || c_custkey % 5 || ':0')[1:16] AS scope, sha256(lower(c_name))[1:24] AS field FROM customer",
)
def cache_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("d2"), F.lit("d1")))
    return table(spark, sf_dir, "customer").select("c_custkey", cache.scope_key(F.col("c_custkey"), docs, F.col("c_custkey") % 5, F.lit(None)).alias("scope"), cache.field_key(F.concat(F.lit(" "), "c_name")).alias("field"))


@query(
    "cache_lookup",
    f"WITH {_MEM}, p AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, round({sql_dot('q.v', 'e.v')}, 6) AS similarity FROM m q JOIN m e ON q.label = e.label WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS n FROM p) SELECT query_id, entry_id, similarity FROM b WHERE n = 1 AND similarity >= 0.1",
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar other vector of the same label, from 0.1 on, as the test vectors are far apart."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("label").alias("scope"), "embedding")
    asked = v.where("entry_id % 100 = 0").select(F.col("entry_id").alias("query_id"), "scope", "embedding")
    # A question's own entry isn't stored yet.
    return cache.lookup(v, asked, 0.1, without="query_id")


@query("cache_evict", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id FROM r WHERE n <= 20")
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.col("ts").alias("stored_at"), F.col("event_id").alias("field"))
    return cache.evict(rows, 20).select(F.col("scope").alias("user_id"), F.col("field").alias("event_id"))


@query("token_reuse", "WITH p AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type, event_id // 3 ORDER BY ts, event_id) AS n FROM events) SELECT user_id AS family_id, count(*) AS reuses FROM p WHERE n > 1 GROUP BY user_id")
def token_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("family_id"), F.concat_ws(":", "event_type", F.floor(F.col("event_id") / 3).cast("string")).alias("token_hash"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return identity.reused(rows).select("family_id", "reuses")


@query("readiness", "SELECT o_custkey, bool_and(o_orderstatus = 'O') AS ready, bool_and(o_orderstatus <> 'F') AS alive FROM orders GROUP BY o_custkey")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "healthy").when(F.col("o_orderstatus") == "F", "failed").otherwise("degraded")
    rows = table(spark, sf_dir, "orders").select("o_custkey", state.alias("state"), F.lit(True).alias("required"), F.lit(False).alias("draining"))
    return identity.readiness(rows, "o_custkey")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as lines of a page: the quantity as size, down the page by number."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("line_no"), F.concat_ws(" ", F.lit("Part"), F.col("l_partkey").cast("string")).alias("text"), F.col("l_quantity").alias("size"))
    y = F.col("line_no") * 40.0
    return rows.select("*", F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(100.0).alias("x1"), (y + 5).alias("y1"))


@query(
    "layout_sections",
    """WITH b AS (SELECT l_orderkey, median(l_quantity) AS body FROM lineitem GROUP BY l_orderkey), t AS (SELECT l.l_orderkey AS doc_id, l_linenumber AS line_no, 'Part ' || l_partkey AS text, l_quantity >= body * 1.6::DOUBLE AS is_title FROM lineitem l JOIN b USING (l_orderkey)),
    n AS (SELECT doc_id, line_no, max(CASE WHEN is_title THEN text END) AS title FROM t GROUP BY ALL), s AS (SELECT doc_id, line_no, last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM n)
    SELECT doc_id, line_no, is_title, section FROM t JOIN s USING (doc_id, line_no)""",
)
def layout_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_sections(layout.titled(_lines(spark, sf_dir))).select("doc_id", "line_no", "is_title", "section")


@query(
    "layout_outside_tables",
    "WITH b AS (SELECT l_orderkey, median(l_quantity) AS body FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT l_orderkey AS doc_id, l_linenumber AS line_no FROM lineitem l JOIN b USING (l_orderkey) WHERE l_quantity >= body * 1.6::DOUBLE OR NOT (l_orderkey IN (SELECT o_orderkey FROM o) AND l_linenumber BETWEEN 2 AND 3)",
)
def layout_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table box over the second and third line of finished orders."""
    boxes = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0.0).alias("x0"), F.lit(70.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(130.0).alias("y1"))
    return layout.outside_tables(layout.titled(_lines(spark, sf_dir)), boxes).select("doc_id", "line_no")

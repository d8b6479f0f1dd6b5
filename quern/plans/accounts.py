"""Queries over users' own records: sessions and turns, practice, memories, cache policy, tokens and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import cache, consolidate, identity, memory, practice, records
from quern.plans.registry import query, sql_strip, table

_SAID = sql_strip("coalesce(text, '')")


@query(
    "response_policy",
    f"SELECT conv_id, turn, CASE WHEN (conv_id % 7 <> 0 AND conv_id % 5 = 0) OR {_SAID} = '' THEN 'empty_answer' WHEN turn % 3 = 1 THEN 'side_effects' ELSE 'cacheable' END AS decision FROM conversations",
)
def response_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as an answer; some after a tool with side effects, some timed out, some that don't say."""
    tools = F.when(F.col("turn") % 3 == 0, F.array(F.lit("search"))).when(F.col("turn") % 3 == 1, F.array(F.lit("search"), F.lit(cache.SIDE_EFFECTS[0])))
    timed_out = F.when(F.col("conv_id") % 7 != 0, F.col("conv_id") % 5 == 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cache.response_policy(F.col("text"), tools, timed_out).alias("decision"))


@query("cache_generations", "SELECT c_custkey AS user_id, count(event_id) FILTER (WHERE event_type = 'purchase') AS doc_generation, count(event_id) FILTER (WHERE event_type = 'signup') AS memory_generation FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey")
def cache_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    what = F.when(F.col("event_type") == "purchase", "documents").when(F.col("event_type") == "signup", "memory")
    return cache.generations(table(spark, sf_dir, "events").select("user_id", what.alias("what")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")))


@query(
    "open_sessions",
    """WITH a AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS session_id, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS user_id, repeat(o_orderpriority || ' ', 10) AS message, o_orderkey % 2 = 0 AS named FROM orders),
    j AS (SELECT a.*, o_custkey, o_orderpriority, o_orderstatus, CASE WHEN o_custkey = user_id THEN 'use' WHEN o_custkey IS NOT NULL THEN 'not_found' ELSE 'insert' END AS action FROM a LEFT JOIN orders ON o_orderkey = session_id)
    SELECT request_id, action, CASE action WHEN 'use' THEN o_orderpriority WHEN 'insert' THEN message[1:60] END AS title, CASE WHEN action <> 'not_found' THEN CASE WHEN named THEN 'd' ELSE o_orderstatus END END AS docs FROM j""",
)
def open_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions of their customers; a third of the requests name none that exists, a fifth come from another."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    sessions = orders.select(key.alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"), F.array("o_orderstatus").alias("doc_ids"))
    asked = orders.select(key.alias("request_id"), F.when(key % 3 == 0, -key).otherwise(key).alias("session_id"), F.when(key % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("user_id"), F.repeat(F.concat("o_orderpriority", F.lit(" ")), 10).alias("message"), F.when(key % 2 == 0, F.array(F.lit("d"))).alias("doc_ids"))
    return records.open_sessions(sessions, asked).select("request_id", "action", "title", F.array_join("doc_ids", ",").alias("docs"))


@query("turn_rows", "SELECT o_orderkey AS session_id, o_custkey AS user_id, 0 AS place, 'user' AS role, o_orderstatus AS content FROM orders UNION ALL SELECT o_orderkey, o_custkey, 1, 'assistant', o_orderpriority FROM orders")
def turn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("question"), F.col("o_orderpriority").alias("answer"), F.col("o_orderdate").alias("at"))
    return records.turn_rows(turns).select("session_id", "user_id", "place", "role", "content")


@query(
    "session_rows",
    """WITH t AS (SELECT o_custkey, max(o_orderdate) AS newest FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY o_custkey)
    SELECT c_custkey::VARCHAR AS session_id, strftime(greatest(TIMESTAMP '1995-06-01', newest), '%Y-%m-%dT%H:%M:%S') AS last_message_at, CASE WHEN c_custkey % 2 = 0 THEN '1,2' ELSE '' END AS doc_ids FROM customer LEFT JOIN t ON o_custkey = c_custkey""",
)
def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each customer, moved on by the orders; a tenth of these name another user and move nothing."""
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_custkey").alias("user_id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit(1), F.lit(2))).alias("doc_ids"), F.lit("1995-06-01 00:00:00").cast("timestamp_ntz").alias("last_message_at"))
    turns = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.when(F.col("o_orderkey") % 10 == 0, 0).otherwise(F.col("o_custkey")).alias("user_id"), F.col("o_orderdate").alias("at"))
    return records.session_rows(records.moved_on(sessions, turns)).select("session_id", "last_message_at", F.array_join("doc_ids", ",").alias("doc_ids"))


@query(
    "turn_summary",
    """WITH l AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS last FROM conversations GROUP BY conv_id), s AS (SELECT c.* FROM conversations c JOIN l USING (conv_id) WHERE last IS NULL OR turn > last)
    SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS replies, sum(CASE WHEN turn % 4 = 0 THEN 0 ELSE turn * 3 END)::BIGINT AS tokens, coalesce(string_agg(CASE WHEN turn % 2 = 1 THEN 't' || turn % 3 END, ',' ORDER BY turn), '') AS tools FROM s GROUP BY conv_id""",
)
def turn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("tokens", F.when(turn % 4 != 0, turn * 3)).withColumn("tool", F.when(turn % 2 == 1, F.concat(F.lit("t"), (turn % 3).cast("string"))))
    return records.turn_summary(rows, "conv_id", "turn").select("conv_id", "replies", "tokens", F.array_join("tools", ",").alias("tools"))


@query("newest_first", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.newest_first(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    "practice_questions",
    """SELECT l_orderkey, 'Q' || l_linenumber AS question, l_partkey % 4 AS correct_index, CASE WHEN l_partkey % 3 = 0 THEN 3 ELSE 2 END AS n_options FROM lineitem
    WHERE l_linenumber % 5 <> 0 AND l_suppkey % 9 <> 0 AND l_partkey % 4 < CASE WHEN l_partkey % 3 = 0 THEN 3 ELSE 2 END""", ints=("correct_index", "n_options"))
def practice_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as choices: some without text, with a blank option, or with a correct one that isn't there."""
    none = F.lit(None).cast("string")
    options = F.array(F.col("l_returnflag"), F.when(F.col("l_partkey") % 3 == 0, "third").otherwise(" "), F.concat(F.lit(" "), "l_linestatus"))
    right = F.when(F.col("l_suppkey") % 9 == 0, "x").otherwise((F.col("l_partkey") % 4).cast("string"))
    q = F.struct(F.when(F.col("l_linenumber") % 5 == 0, "  ").otherwise(F.concat(F.lit(" Q"), F.col("l_linenumber").cast("string"))).alias("question"), options.alias("options"), right.alias("correct_index"), none.alias("explanation"), none.alias("model_answer"), F.array().cast("array<struct<point:string,marks:string>>").alias("rubric"), F.array(F.lit("1")).alias("source_pages"))
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(q).alias("questions")).withColumn("qtype", F.when(F.col("l_orderkey") % 2 == 0, "mcq").otherwise("true_false"))
    return practice.normalise(sets, "l_orderkey").select("l_orderkey", "question", "correct_index", F.size("options").alias("n_options"))


@query(
    "practice_saved",
    """WITH o AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) SELECT o_custkey AS set_id, o_orderkey AS seq, row_number() OVER w AS position, first_value(o_orderstatus) OVER w AS qtype FROM orders JOIN o ON c_custkey = o_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""", ints=("position",))
def practice_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set for each customer, its orders as questions; a third of the sets name a session of another user."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("set_id"), F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("user_id"))
    sessions = customer.select("session_id", F.when(F.col("session_id") % 3 == 0, -1).otherwise(F.col("user_id")).alias("user_id"))
    questions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("qtype"), F.col("o_orderpriority").alias("question"))
    return practice.saved(customer, questions, sessions).select("set_id", "seq", "position", "qtype")


@query("practice_view", "SELECT o_custkey AS set_id, o_orderkey AS question_id, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 4 END AS correct_index FROM orders JOIN customer ON c_custkey = o_custkey")
def practice_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions; finished ones are answered."""
    orders = table(spark, sf_dir, "orders")
    questions = orders.select(F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("set_id"), (F.col("o_orderkey") % 4).alias("correct_index"))
    answers = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("answer_id"), F.col("o_orderkey").alias("question_id"))
    return practice.practice_view(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("set_id")), questions, answers).select("set_id", "question_id", "correct_index")


@query("memory_erase", "SELECT event_id FROM events WHERE NOT coalesce(user_id = 7 AND event_type = 'view', false)")
def memory_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("kind"))
    return memory.erase(stored, 7, "view")[0].select("event_id")


@query(
    "memory_put_alike",
    """WITH e AS (SELECT event_id, user_id, event_type AS kind, sha256(CASE WHEN event_id % 3 = 0 THEN 'one' ELSE 'two ' || event_id // 4 END) AS hash, event_id % 5 AS version FROM events),
    s AS (SELECT min(event_id) AS memory_id, user_id, kind, hash, arg_min(version, event_id) AS version FROM e WHERE event_id % 2 = 0 GROUP BY ALL), n AS (SELECT max(event_id) AS new_id, user_id, kind, hash, arg_max(version, event_id) AS version FROM e WHERE event_id % 2 = 1 GROUP BY ALL)
    SELECT coalesce(s.memory_id, n.new_id) AS memory_id, coalesce(s.user_id, n.user_id) AS user_id, coalesce(s.kind, n.kind) AS kind, coalesce(s.hash, n.hash) AS content_hash, greatest(s.version, n.version) AS version FROM s FULL JOIN n ON s.user_id = n.user_id AND s.kind = n.kind AND s.hash = n.hash""",
)
def memory_put_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events as memories stored; odd ones are put, and those of an equal text overwrite what has it."""
    said = F.when(F.col("event_id") % 3 == 0, "One!").otherwise(F.concat(F.lit("two,  "), F.floor(F.col("event_id") / 4).cast("string")))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), T.content_hash(said).alias("content_hash"), (F.col("event_id") % 5).alias("version"))
    group = lambda odd, pick, best: rows.where(F.col("event_id") % 2 == odd).groupBy("user_id", "kind", "content_hash").agg(pick("event_id").alias("memory_id"), best("version", "event_id").alias("version"))
    stored, new = group(0, F.min, F.min_by), group(1, F.max, F.max_by)
    return memory.put(stored, memory.alike(stored, new), ["memory_id"]).select("memory_id", "user_id", "kind", "content_hash", "version")


@query(
    "memory_exemplar",
    """SELECT o_orderkey, concat_ws(chr(10), 'Situation: ' || o_orderpriority, 'Action: ' || o_orderstatus, 'Outcome (' || CASE WHEN o_orderkey % 3 = 1 THEN 'DID NOT WORK' ELSE 'WORKED' END || '): ' || o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Lesson: ' || o_orderkey END) AS text FROM orders""",
)
def memory_exemplar(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key, F.col("o_orderpriority").alias("situation"), F.col("o_orderstatus").alias("action"), F.col("o_custkey").cast("string").alias("outcome"), F.when(key % 2 == 0, key.cast("string")).otherwise("").alias("lesson"), F.when(key % 3 == 1, False).when(key % 3 == 2, True).alias("success"))
    return rows.select("o_orderkey", memory.exemplar().alias("text"))


_KINDS = {"procedural": "signup", "semantic": "view", "episodic": "purchase"}
_PART = "'{title}:' || chr(10) || string_agg('- e' || event_id, chr(10) ORDER BY event_id) FILTER (WHERE event_type = '{event}')"


@query("memory_prompt", "SELECT user_id AS query_id, concat_ws(chr(10) || chr(10), " + ", ".join(_PART.format(title=t, event=e) for t, e in zip(("Rules", "Facts", "Episodes"), _KINDS.values(), strict=True)) + ") AS prompt FROM events GROUP BY user_id")
def memory_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for name, event in _KINDS.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), kind.alias("kind"), F.col("event_id").alias("memory_id"), F.col("event_id").alias("rank"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("text"))
    return memory.render_recall(rows.drop("text"), rows)


@query(
    "memory_transcript",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, coalesce(string_agg(upper(role) || ': ' || text[1:1000], chr(10) ORDER BY turn), '') AS transcript FROM r WHERE n <= 2 GROUP BY conv_id",
)
def memory_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.transcript(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(
    "working_window",
    """WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' WHEN turn % 4 = 3 THEN 'tool' ELSE 'assistant' END AS role, turn % 2 AS calls, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
    s AS (SELECT *, min(turn) FILTER (WHERE role <> 'tool') OVER (PARTITION BY conv_id) AS first FROM m WHERE n <= 3) SELECT conv_id, turn, role FROM s WHERE turn >= first AND NOT (n = 1 AND role = 'assistant' AND calls > 0)""",
)
def working_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three messages, some of the assistant's taken as results of tools."""
    role = F.when(F.col("role") == "user", "user").when(F.col("turn") % 4 == 3, "tool").otherwise("assistant")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"), (F.col("turn") % 2).alias("calls"))
    return memory.working_window(rows, "conv_id", "turn", 3).select("conv_id", "turn", "role")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh token for each customer, three to a family; times are whole numbers, now is 10."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), key.cast("string")).alias("token_hash"), F.floor(key / 3).alias("family_id"), F.col("c_nationkey").alias("user_id"), (key % 4 == 0).alias("revoked"), (key % 20).alias("expires_at"))


def _presented(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.concat(F.when(key % 10 == 0, "x").otherwise("t"), key.cast("string"))
    return table(spark, sf_dir, "customer").where(key % 3 != 0).select(name.alias("token_hash"), F.concat(F.lit("s"), key.cast("string")).alias("successor"), F.lit(10).alias("now"))


_OUTCOME = "CASE WHEN c_custkey % 10 = 0 THEN 'unknown' WHEN c_custkey % 4 = 0 THEN 'reuse' WHEN c_custkey % 20 < 10 THEN 'expired' ELSE 'rotated' END"


@query("token_outcomes", f"SELECT CASE WHEN c_custkey % 10 = 0 THEN 'x' ELSE 't' END || c_custkey AS token_hash, {_OUTCOME} AS outcome FROM customer WHERE c_custkey % 3 <> 0")
def token_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.rotate(_tokens(spark, sf_dir), _presented(spark, sf_dir))[1]


@query("token_rotation", f"WITH c AS (SELECT *, c_custkey % 3 <> 0 AND {_OUTCOME} = 'rotated' AS done FROM customer) SELECT 't' || c_custkey AS token_hash, c_custkey // 3 AS family_id, c_custkey % 4 = 0 OR done AS revoked FROM c UNION ALL SELECT 's' || c_custkey, c_custkey // 3, false FROM c WHERE done")
def token_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.rotate(_tokens(spark, sf_dir), _presented(spark, sf_dir))[0].select("token_hash", "family_id", "revoked")


@query("token_revoke", "SELECT 't' || c_custkey AS token_hash, c_custkey % 4 = 0 OR c_custkey = 5 OR (c_custkey // 3) % 5 = 0 OR c_nationkey = 7 AS revoked FROM customer")
def token_revoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token, every fifth family, and all of one user."""
    tokens = _tokens(spark, sf_dir)
    one = identity.revoke(tokens, tokens.where("token_hash = 't5'"), "token_hash")
    families = identity.revoke(one, tokens.where("family_id % 5 = 0"))
    return identity.revoke(families, tokens.where("user_id = 7"), "user_id").select("token_hash", "revoked")


@query("token_purge", "SELECT 't' || c_custkey AS token_hash, (SELECT count(*) FROM customer WHERE c_custkey % 20 < 10) AS purged FROM customer WHERE c_custkey % 20 >= 10")
def token_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, count = identity.purge(_tokens(spark, sf_dir), 10)
    return live.select("token_hash").crossJoin(F.broadcast(count))  # one row


@query("token_users", "SELECT 't' || c_custkey AS token_hash, n_nationkey AS user_id, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 0 AND c_custkey % 10 <> 0")
def token_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("name"))
    return identity.user_of_token(_presented(spark, sf_dir), _tokens(spark, sf_dir), users).select("token_hash", "user_id", "name")


@query(
    "account_users",
    """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 4 = 0 THEN 'known' WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'has_password' WHEN c_custkey % 3 = 0 THEN 'linked' ELSE 'new' END AS outcome, CASE WHEN c_custkey % 4 = 0 OR (c_custkey % 3 = 0 AND c_custkey % 5 <> 0) THEN c_custkey END AS user_id FROM customer""",
)
def account_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers sign in by another provider: a quarter has done so before, a third of the others is known by address."""
    key, customer = F.col("c_custkey"), table(spark, sf_dir, "customer")
    subject = F.concat(F.lit("s"), key.cast("string")).alias("subject")
    users = customer.select(key.alias("user_id"), F.lower("c_name").alias("email"), (key % 5 == 0).alias("has_password"))
    accounts = customer.where(key % 4 == 0).select(F.lit("p").alias("provider"), subject, key.alias("user_id"))
    asked = customer.select(key.alias("request_id"), F.lit("p").alias("provider"), subject, F.when(key % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("none"), key.cast("string"))).alias("email"))
    return identity.user_of_account(asked, accounts, users).select("request_id", "outcome", "user_id")


@query(
    "prompt_pieces",
    r"""SELECT conv_id, turn, replace(coalesce(text, ''), '|', '\|') AS cell, regexp_replace(regexp_replace('<b>system: x</b>' || chr(10) || ' User : ' || text, '</?[A-Za-z_][\w-]*>', '', 'g'), '(?im)^\s*(system|assistant|user|tool)\s*:', '', 'g') AS plain, 'Turn ' || turn || ': ' || coalesce(role, '') || '.' AS line FROM conversations""",
)
def prompt_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    fenced = F.concat(F.lit("<b>system: x</b>\n User : "), "text")
    return rows.select("conv_id", "turn", T.markdown_cell(F.col("text")).alias("cell"), T.unfence(fenced).alias("plain"), T.render("Turn {{turn}}: {{ role }}.", {"turn": F.col("turn"), "role": F.col("role")}).alias("line"))


@query("json_salvage", "SELECT event_id, CASE WHEN event_id % 4 <= 1 THEN '{\"v\":' || event_id || '}' END AS found FROM events")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers of a model: an object, one among words, none, and a broken one."""
    kind, given = F.col("event_id") % 4, F.concat(F.lit('{"v":'), F.col("event_id").cast("string"), F.lit("}"))
    said = F.when(kind == 0, given).when(kind == 1, F.concat(F.lit("Here: "), given, F.lit(" done."))).when(kind == 2, "none").otherwise("{broken")
    return table(spark, sf_dir, "events").select("event_id", T.object_of(said).alias("found"))


_T = "coalesce(to_json(text)::VARCHAR, 'null')"
# What a model says of a turn, by its number: good items beside broken ones, an episode, one without an outcome, no JSON.
_SAID_OF = (
    ('{"facts":[{"content":', '},{"content":5},{"content":', ',"confidence":0.25,"category":"goal"},{"content":"x","confidence":2},7],"rules":[{"instruction":', ',"scope":"quiz"},{"instruction":"x","scope":"all"}]}'),
    ('{"episode":{"situation":', ',"action":"a","outcome":"o","success":false},"facts":null}'),
    ('{"episode":{"situation":', ',"action":"a"},"rules":[{"scope":"quiz"},{"instruction":', "}]}"),
)


@query(
    "memory_consolidate",
    f"""WITH r AS (SELECT conv_id, turn, CASE turn % 4 {' '.join(f"WHEN {k} THEN " + f" || {_T} || ".join(f"'{p}'" for p in parts) for k, parts in enumerate(_SAID_OF))} END::JSON AS j FROM conversations),
    i AS (SELECT conv_id, turn, kind, unnest(range(len(a)))::INTEGER AS place, unnest(a) AS x FROM (SELECT conv_id, turn, 'semantic' AS kind, CAST(j->'$.facts' AS JSON[]) AS a FROM r WHERE json_type(j->'$.facts') = 'ARRAY' UNION ALL SELECT conv_id, turn, 'procedural', CAST(j->'$.rules' AS JSON[]) FROM r WHERE json_type(j->'$.rules') = 'ARRAY' UNION ALL SELECT conv_id, turn, 'episodic', [j->'$.episode'] FROM r WHERE json_type(j->'$.episode') = 'OBJECT'))
    SELECT conv_id, turn, kind, place, CASE kind WHEN 'semantic' THEN x->>'$.content' WHEN 'procedural' THEN x->>'$.instruction' ELSE concat_ws(chr(10), x->>'$.situation', x->>'$.action', x->>'$.outcome', '') END AS searchable_text,
    CASE WHEN kind = 'semantic' THEN coalesce((x->>'$.confidence')::DOUBLE, 0.7::DOUBLE) END AS confidence, CASE WHEN kind = 'semantic' THEN coalesce(x->>'$.category', 'fact') END AS category, CASE WHEN kind = 'procedural' THEN coalesce(x->>'$.scope', 'global') END AS scope, CASE WHEN kind = 'episodic' THEN coalesce((x->>'$.success')::BOOLEAN, true) END AS success
    FROM i WHERE json_type(x) = 'OBJECT' AND CASE kind WHEN 'semantic' THEN json_type(x->'$.content') = 'VARCHAR' AND coalesce((x->>'$.confidence')::DOUBLE BETWEEN 0 AND 1, true) WHEN 'procedural' THEN json_type(x->'$.instruction') = 'VARCHAR' AND coalesce(x->>'$.scope' IN ('global', 'explanation', 'quiz', 'marking'), true)
    ELSE json_type(x->'$.situation') = 'VARCHAR' AND json_type(x->'$.action') = 'VARCHAR' AND json_type(x->'$.outcome') = 'VARCHAR' END""",
)
def memory_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.to_json(F.array("text"))
    said = F.substring(said, F.lit(2), F.length(said) - 2)
    reply = F.concat(F.lit("no object: "), said)
    for k, parts in enumerate(_SAID_OF):
        pieces = [x for p in parts for x in (F.lit(p), said)][:-1]
        reply = F.when(F.col("turn") % 4 == k, F.concat(*pieces)).otherwise(reply)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("reply"))
    return consolidate.consolidated(rows).select("conv_id", "turn", "kind", "place", "searchable_text", "confidence", "category", "scope", "success")

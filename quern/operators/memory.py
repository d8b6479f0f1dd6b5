"""Long-term memory: recall by vector, versioned puts, merging of like rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.search import vector_pairs

SEMANTIC, EPISODIC, RULES, RULE_SIMILARITY = 6, 2, 8, 0.6


def nearest(memories: DataFrame, queries: DataFrame, kind: str, k: int) -> DataFrame:
    """(query_id, memory_id, score, rank): the ``k`` memories of a kind with the largest cosine, each at least 0."""
    right = memories.where((F.col("kind") == kind) & F.col("active")).select(F.col("memory_id").alias("chunk_id"), "user_id", "embedding")
    scored = vector_pairs(queries, right, k, 0.0).select("query_id", F.col("chunk_id").alias("memory_id"), "score")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))).where(F.col("rank") <= k)


def active_rules(memories: DataFrame, most: int = RULES) -> DataFrame:
    """The newest rules of each user; those whose payload says inactive go after the limit, not before."""
    rules = memories.where((F.col("kind") == "procedural") & F.col("active"))
    newest = rules.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "memory_id"))).where(F.col("rank") <= most)
    return newest.where(F.coalesce(F.col("rule_active"), F.lit(True)))


def recall(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, kind, memory_id, score, rank) of facts, episodes and rules. A blank query recalls rules only."""
    asked = queries.where(T.blank_to_null(F.col("text")).isNotNull())
    facts = nearest(memories, asked, "semantic", SEMANTIC).withColumn("kind", F.lit("semantic"))
    episodes = nearest(memories, asked, "episodic", EPISODIC).withColumn("kind", F.lit("episodic"))
    rules = queries.select("query_id", "user_id").join(active_rules(memories).select("user_id", "memory_id", "rank"), "user_id").select("query_id", "memory_id", F.lit(1.0).alias("score"), "rank", F.lit("procedural").alias("kind"))
    return facts.unionByName(episodes).unionByName(rules).select("query_id", "kind", "memory_id", "score", "rank")


def put(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` after ``new``: rows with an equal key are replaced, their version the larger of both; others added.
    ``new`` has one row for a key."""
    rest = [c for c in stored.columns if c not in key]
    s = stored.select(*key, F.struct(*rest).alias("__s"))
    n = new.select(*key, F.struct(*rest).alias("__n"))
    both = s.join(n, key, "full_outer")
    version = F.greatest("__s.version", "__n.version")
    return both.select(*key, *[(version if c == "version" else F.when(F.col("__n").isNotNull(), F.col(f"__n.{c}")).otherwise(F.col(f"__s.{c}"))).alias(c) for c in rest])


def alike(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` memories under the memory_id that they overwrite: their own where it is stored, else that of the first
    stored one of the same user, kind and content_hash, else their own. Then ``put`` them by memory_id."""
    own = stored.select("memory_id", F.lit(True).alias("__own"))
    same = stored.groupBy("user_id", "kind", "content_hash").agg(F.min("memory_id").alias("__like"))
    rows = new.join(own, "memory_id", "left").join(same, ["user_id", "kind", "content_hash"], "left")
    return rows.withColumn("memory_id", F.when(F.col("__own"), F.col("memory_id")).otherwise(F.coalesce("__like", "memory_id"))).drop("__own", "__like")


def facts(said: DataFrame) -> DataFrame:
    """Facts (user_id, content) as memories to put, without a vector yet."""
    return said.select("user_id", F.lit("semantic").alias("kind"), T.content_hash(F.col("content")).alias("content_hash"), F.col("content").alias("searchable_text"))


def episodes(seen: DataFrame) -> DataFrame:
    """Episodes (user_id, situation, action, outcome, lesson) as memories to put; the four parts are a line each."""
    text = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("situation", "action", "outcome", "lesson")])
    return seen.select("user_id", F.lit("episodic").alias("kind"), T.content_hash(text).alias("content_hash"), text.alias("searchable_text"))


def merge_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """What becomes of each new rule (new_id, user_id, scope, instruction, embedding): ``memory_id`` of the rule it
    overwrites and its version, or null and 1. Among the eight nearest it is the first of the same scope whose
    tokens are alike (Jaccard of 0.6 or more)."""
    near = nearest(rules.withColumn("kind", F.lit("procedural")), new.select(F.col("new_id").alias("query_id"), "user_id", "embedding"), "procedural", RULES)
    pairs = near.join(rules.select("memory_id", F.col("scope").alias("old_scope"), F.col("instruction").alias("old"), F.col("version").alias("old_version")), "memory_id").join(new.select(F.col("new_id").alias("query_id"), "scope", "instruction"), "query_id")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"((?U)[\w\x{0D80}-\x{0DFF}]+)"), F.lit(1)))
    alike = pairs.where((F.col("scope") == F.col("old_scope")) & (T.jaccard(words(F.col("instruction")), words(F.col("old"))) >= RULE_SIMILARITY))
    first = alike.groupBy("query_id").agg(F.min_by(F.struct("memory_id", "old_version"), "rank").alias("m"))
    return new.select("new_id").join(first.withColumnRenamed("query_id", "new_id"), "new_id", "left").select("new_id", F.col("m.memory_id").alias("memory_id"), (F.coalesce(F.col("m.old_version"), F.lit(0)) + 1).alias("version"))


def erase(stored: DataFrame, user_id, kind: str) -> tuple[DataFrame, DataFrame]:
    """``stored`` without a user's memories of a kind, and how many there were."""
    gone = (F.col("user_id").eqNullSafe(F.lit(user_id))) & (F.col("kind").eqNullSafe(F.lit(kind)))
    return stored.where(~gone), stored.where(gone).agg(F.count("*").alias("erased"))


# How an episode's outcome is told.
VERDICTS = ("WORKED", "DID NOT WORK")


def verdict(success: Column) -> Column:
    """Of an episode; one that doesn't say is taken to have worked."""
    return F.when(F.coalesce(success, F.lit(True)), VERDICTS[0]).otherwise(VERDICTS[1])


def exemplar():
    """An episode as text."""
    return F.concat_ws("\n", F.concat(F.lit("Situation: "), "situation"), F.concat(F.lit("Action: "), "action"), F.concat(F.lit("Outcome ("), verdict(F.col("success")), F.lit("): "), "outcome"), F.concat(F.lit("Lesson: "), F.nullif("lesson", F.lit(""))))


def render_recall(recalled: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, prompt): sections of rules, facts and episodes, each a list; empty sections are left out."""
    rows = recalled.join(texts.select("memory_id", "text"), "memory_id")
    part = lambda kind, title: F.concat(F.lit(f"{title}:\n"), F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "text")))), lambda x: F.concat(F.lit("- "), x["text"])), "\n"), F.lit("")))
    return rows.groupBy("query_id").agg(F.concat_ws("\n\n", part("procedural", "Rules"), part("semantic", "Facts"), part("episodic", "Episodes")).alias("prompt"))


def transcript(messages: DataFrame, session: str, index: str, most: int = 2, chars: int = 1000) -> DataFrame:
    """The last messages of each session, each cut, for a model that draws memories from them."""
    ranked = messages.withColumn("__n", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(index)))).where(F.col("__n") <= most)
    return ranked.groupBy(session).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(index, F.concat(F.upper("role"), F.lit(": "), F.left("text", F.lit(chars))).alias("line")))), lambda x: x["line"]), "\n").alias("transcript"))


def flatten(hits: DataFrame, payload: str = "payload") -> DataFrame:
    """Recalled rows with ``content``: an episode's four parts, else its content, instruction or searchable text. Keys
    of the payload (a map) that begin with an underscore are dropped."""
    public = F.map_filter(F.col(payload), lambda k, v: ~k.startswith("_"))
    part = lambda k: F.try_element_at(F.col(payload), F.lit(k))
    episode = F.concat_ws("\n", F.concat(F.lit("Situation: "), part("situation")), F.concat(F.lit("Action: "), part("action")), F.concat(F.lit("Outcome ("), verdict(part("success").try_cast("boolean")), F.lit("): "), part("outcome")), F.concat(F.lit("Lesson: "), F.nullif(part("lesson"), F.lit(""))))
    return hits.withColumn(payload, public).withColumn("content", F.when(F.col("kind") == "episodic", episode).otherwise(F.coalesce(part("content"), part("instruction"), F.col("searchable_text"))))


def working_window(messages: DataFrame, session: str, index: str, most: int) -> DataFrame:
    """The last ``most`` messages of each session, without tool results whose call is cut off before them, and without
    a last message whose calls have no result yet."""
    ranked = messages.withColumn("__n", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(index)))).where(F.col("__n") <= most)
    whole = Window.partitionBy(session)
    start = F.min(F.when(F.col("role") != "tool", F.col(index))).over(whole)
    open_call = (F.col("__n") == 1) & (F.col("role") == "assistant") & (F.coalesce(F.col("calls"), F.lit(0)) > 0)
    return ranked.withColumn("__start", start).where((F.col(index) >= F.col("__start")) & ~open_call).drop("__n", "__start")

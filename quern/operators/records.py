"""Records of conversations: pages by key, sessions and turns, order of messages, citations of a reply."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

TITLE_CHARS, PAGE, MOST_PAGE = 60, 30, 100


def parse_cursor(text: str | None) -> datetime | None:
    """An ISO timestamp; None for anything else."""
    try:
        return datetime.fromisoformat(text) if text else None
    except ValueError:
        return None


def keyset_page(rows: DataFrame, at: str, key: str, limit: int, cursor: tuple | None = None, ascending: bool = False) -> DataFrame:
    """The page of ``limit`` rows that follows ``cursor`` (at, key) in descending order, with ``more``.

    The cursor holds both columns, so rows that share a time at the edge of a page are neither lost nor repeated.
    ``ascending`` shows the page the other way round. Spark keeps only limit + 1 rows in each task.
    """
    if cursor is not None:
        rows = rows.where((F.col(at) < F.lit(cursor[0])) | ((F.col(at) == F.lit(cursor[0])) & (F.col(key) < F.lit(cursor[1]))))
    page = rows.orderBy(F.desc(at), F.desc(key)).limit(limit + 1)
    # One page of bounded size: its rank needs no partition.
    page = page.withColumn("__n", F.row_number().over(Window.orderBy(F.desc(at), F.desc(key)))).withColumn("more", F.max("__n").over(Window.partitionBy()) > limit)
    page = page.where(F.col("__n") <= limit).drop("__n")
    return page.orderBy(at, key) if ascending else page.orderBy(F.desc(at), F.desc(key))


def keyset_pages(rows: DataFrame, by: str, at: str, key: str, limit: int) -> DataFrame:
    """The first page of every ``by`` at once, with place and more (whether older rows remain)."""
    order = Window.partitionBy(by).orderBy(F.desc(at), F.desc(key))
    ranked = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit + 1)
    return ranked.withColumn("more", F.max("place").over(Window.partitionBy(by)) > limit).where(F.col("place") <= limit)


def message_page(messages: DataFrame, limit: int | None = None, cursor: tuple | None = None) -> DataFrame:
    """The page of a session's ``messages`` (created_at, message_id) before ``cursor``, oldest first: 30 messages, or as
    many as wanted within 1 and 100."""
    return keyset_page(messages, "created_at", "message_id", PAGE if limit is None else max(1, min(MOST_PAGE, limit)), cursor, ascending=True)


def newest_first(rows: DataFrame, at: str, key: str) -> DataFrame:
    """All rows, the newest first, by key among equal times; sorted by ranges, so no task holds all."""
    return rows.orderBy(F.desc(at), F.desc(key))


def owned(rows: DataFrame, asked: DataFrame, key: str, user: str = "user_id") -> DataFrame:
    """Rows that exist and belong to the asking user; others are as if they didn't exist."""
    return rows.join(asked.select(key, user).distinct(), [key, user], "left_semi")


def normalise_messages(messages: DataFrame, session: str, at: str, index: str) -> DataFrame:
    """Messages of each session in order: by time (untimed last), the user's before the assistant's, then as they
    came; all before the first message of the user is dropped. Adds ``place`` from 1."""
    role = F.when(F.col("role") == "user", 0).otherwise(1)
    order = Window.partitionBy(session).orderBy(F.col(at).asc_nulls_last(), role, index)
    rows = messages.withColumn("__n", F.row_number().over(order))
    first = F.min(F.when(F.col("role") == "user", F.col("__n"))).over(Window.partitionBy(session))
    return rows.withColumn("place", F.col("__n") - first + 1).where("place >= 1").drop("__n")


def open_sessions(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """What becomes of each request (request_id, session_id, user_id, message, doc_ids): ``use`` an owned session,
    ``insert`` a new one titled by the message, or ``not_found`` for another user's."""
    known = sessions.select("session_id", F.col("user_id").alias("owner"), F.col("title").alias("old_title"), F.col("doc_ids").alias("old_docs"))
    rows = asked.join(known, "session_id", "left")
    action = F.when(F.col("owner") == F.col("user_id"), "use").when(F.col("owner").isNotNull(), "not_found").otherwise("insert")
    seen = lambda c: F.when(action != "not_found", c)
    return rows.select("request_id", "session_id", "user_id", action.alias("action"), seen(F.coalesce("old_title", F.left("message", F.lit(TITLE_CHARS)))).alias("title"), seen(F.coalesce("doc_ids", "old_docs")).alias("doc_ids"))


def moved_on(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """``sessions`` with last_message_at at their newest turn (session_id, user_id, at), never moved back. A turn of
    another user moves nothing."""
    newest = turns.groupBy("session_id", "user_id").agg(F.max("at").alias("__at"))
    return sessions.join(newest, ["session_id", "user_id"], "left").withColumn("last_message_at", F.greatest("last_message_at", "__at")).drop("__at")


def session_rows(sessions: DataFrame) -> DataFrame:
    """Sessions as they are shown: ids and documents as text, no documents as an empty list, the time in ISO form."""
    at = F.regexp_replace(F.date_format("last_message_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    docs = F.coalesce(F.col("doc_ids").cast("array<string>"), F.array().cast("array<string>"))
    return sessions.select(F.col("session_id").cast("string").alias("session_id"), "title", docs.alias("doc_ids"), at.alias("last_message_at"))


def turn_rows(turns: DataFrame) -> DataFrame:
    """Each turn (session_id, user_id, question, answer, at) as two messages of one time, and place 0 and 1."""
    both = F.array(F.struct(F.lit(0).alias("place"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("place"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return turns.select("session_id", "user_id", "at", F.explode(both).alias("m")).select("session_id", "user_id", "at", "m.*")


def turn_slice(messages: DataFrame, session: str, index: str, role: str = "role") -> DataFrame:
    """Messages after the last one of the user, of each session; of a session without one, all."""
    last = messages.groupBy(session).agg(F.max(F.when(F.col(role) == "user", F.col(index))).alias("__last"))
    return messages.join(last, session).where(F.col("__last").isNull() | (F.col(index) > F.col("__last"))).drop("__last")


def final_reply(messages: DataFrame, session: str, index: str, text: str, role: str = "role", calls: Column | None = None) -> DataFrame:
    """The last message of the assistant that says something and calls no tool."""
    said = messages.where((F.col(role) == "assistant") & T.blank_to_null(F.col(text)).isNotNull())
    said = said if calls is None else said.where(F.coalesce(calls, F.lit(0)) == 0)
    return said.groupBy(session).agg(F.max_by(text, index).alias("reply"), F.max(index).alias("at"))


def turn_summary(messages: DataFrame, session: str, index: str) -> DataFrame:
    """Assistant messages, their tokens, and the tools used in order, of each session's last turn."""
    rows = turn_slice(messages, session, index)
    return rows.groupBy(session).agg(F.count_if(F.col("role") == "assistant").alias("replies"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.transform(F.sort_array(F.collect_list(F.when(F.col("tool").isNotNull(), F.struct(index, "tool")))), lambda x: x["tool"]).alias("tools"))


def turn_numbers(messages: DataFrame, session: str, index: str) -> DataFrame:
    """``messages`` with turn: how many messages of the user stand up to and with each."""
    w = Window.partitionBy(session).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn", F.count(F.when(F.col("role") == "user", 1)).over(w))


def resolve_citations(replies: DataFrame, passages: DataFrame, key: str, text: str = "reply") -> DataFrame:
    """(key, citation, chunk_id, place, valid): citations in each reply, by first place, and the passage each names.

    A citation that names no passage shown to that reply (``passages``: key, chunk_id) has no chunk and isn't valid.
    """
    found = replies.select(key, F.posexplode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(C-[0-9A-F]{10})"), F.lit(1)))).alias("place", "citation"))
    known = passages.select(key, "chunk_id", T.citation_id(F.col("chunk_id")).alias("citation")).groupBy(key, "citation").agg(F.min("chunk_id").alias("chunk_id"))
    return found.join(known, [key, "citation"], "left").withColumn("valid", F.col("chunk_id").isNotNull())


def strip_citations(text: Column, invalid: Column) -> Column:
    """``text`` without the citations listed in ``invalid``, brackets around them included."""
    return F.aggregate(F.coalesce(invalid, F.array().cast("array<string>")), text, lambda t, c: F.replace(F.replace(t, F.concat(F.lit("["), c, F.lit("]")), F.lit("")), c, F.lit("")))

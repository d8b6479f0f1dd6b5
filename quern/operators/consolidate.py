"""Memories that a model draws from a conversation: its JSON as rows to put, malformed items left out one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

# What an item's fields may say, and what they say by default.
CATEGORIES = ("preference", "goal", "background", "misconception", "fact")
SOURCES = ("stated", "inferred")
SCOPES = ("global", "explanation", "quiz", "marking")
CONFIDENCE, STATED = 0.7, 1.0


def _field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


def _kind(item: Column, name: str) -> Column:
    """The type of a field; null if it isn't there, ``VOID`` if it is null."""
    return F.schema_of_variant(_field(item, name))


def _text(item: Column, name: str, default: str = "") -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit(default))


def _is_text(item: Column, name: str, needed: bool = False) -> Column:
    return F.coalesce(_kind(item, name) == "STRING", F.lit(not needed))


def _one_of(item: Column, name: str, values: tuple[str, ...]) -> Column:
    return _kind(item, name).isNull() | ((_kind(item, name) == "STRING") & _text(item, name).isin(*values))


def _converts(item: Column, name: str, kind: str) -> Column:
    """Whether a field is missing or a value of ``kind``, also one written as text."""
    return _kind(item, name).isNull() | F.try_variant_get(item, f"$.{name}", kind).isNotNull()


def _valid(item: Column, kind: Column) -> Column:
    confidence = F.try_variant_get(item, "$.confidence", "double")
    fact = _is_text(item, "content", True) & _is_text(item, "subject") & _one_of(item, "category", CATEGORIES) & _one_of(item, "source", SOURCES) & _converts(item, "confidence", "double") & F.coalesce(confidence.between(0, 1), F.lit(True))
    episode = _is_text(item, "situation", True) & _is_text(item, "action", True) & _is_text(item, "outcome", True) & _is_text(item, "lesson") & _is_text(item, "subject") & _converts(item, "success", "boolean")
    rule = _is_text(item, "instruction", True) & _is_text(item, "rationale") & _one_of(item, "scope", SCOPES) & _converts(item, "version", "bigint") & _converts(item, "active", "boolean")
    whole = F.schema_of_variant(item).startswith("OBJECT")
    return F.coalesce(whole & F.when(kind == "semantic", fact).when(kind == "episodic", episode).otherwise(rule), F.lit(False))


def consolidated(replies: DataFrame, reply: str = "reply", subject: str | None = None) -> DataFrame:
    """A row for each memory that ``replies`` (a model's texts) tell of, with the other columns of ``replies``.

    kind (``semantic``, ``episodic``, ``procedural``), place (in its list), content_hash, searchable_text, payload (a map),
    confidence and source (of facts), scope, version and active (of rules), success (of episodes). The JSON may stand
    within other text; a reply without any, or with lists that are none, tells of nothing, and an item that lacks what it
    needs, or holds what it may not, is left out alone. ``subject`` names a column for episodes without their own.
    """
    parsed = F.try_parse_json(T.object_of(F.col(reply)))
    none = F.array().cast("array<struct<kind:string,place:int,item:variant>>")
    several = lambda key, kind: F.coalesce(F.transform(F.try_variant_get("__v", f"$.{key}", "array<variant>"), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("place"), x.alias("item"))), none)
    one = F.when(F.schema_of_variant(_field(F.col("__v"), "episode")).startswith("OBJECT<"), F.array(F.struct(F.lit("episodic").alias("kind"), F.lit(0).alias("place"), _field(F.col("__v"), "episode").alias("item")))).otherwise(none)
    rows = replies.withColumn("__v", parsed).withColumn("__i", F.explode(F.concat(one, several("rules", "procedural"), several("facts", "semantic"))))
    kept = [c for c in replies.columns if c != reply]
    rows = rows.select(*kept, F.col("__i.kind").alias("kind"), F.col("__i.place").alias("place"), F.col("__i.item").alias("__x")).where(_valid(F.col("__x"), F.col("kind")))
    x, kind = F.col("__x"), F.col("kind")
    of = lambda what, value: F.when(kind == what, value)
    about = F.when(_kind(x, "subject").isNotNull(), _text(x, "subject")).otherwise(F.coalesce(F.col(subject), F.lit("")) if subject else F.lit(""))
    episode = F.concat_ws("\n", *[_text(x, c) for c in ("situation", "action", "outcome", "lesson")])
    text = F.when(kind == "episodic", episode).when(kind == "semantic", _text(x, "content")).otherwise(_text(x, "instruction"))
    typed = {
        "searchable_text": text,
        "confidence": of("semantic", F.coalesce(F.try_variant_get(x, "$.confidence", "double"), F.lit(CONFIDENCE))),
        "category": of("semantic", _text(x, "category", "fact")), "source": of("semantic", _text(x, "source", "inferred")),
        "scope": of("procedural", _text(x, "scope", "global")), "version": of("procedural", F.coalesce(F.try_variant_get(x, "$.version", "bigint"), F.lit(1))),
        "active": of("procedural", F.coalesce(F.try_variant_get(x, "$.active", "boolean"), F.lit(True))), "success": of("episodic", F.coalesce(F.try_variant_get(x, "$.success", "boolean"), F.lit(True))),
        "subject": F.when(kind == "episodic", about).when(kind == "semantic", _text(x, "subject")),
    }
    parts = {"semantic": ("content", "category", "subject", "confidence", "source"), "episodic": ("situation", "action", "outcome", "lesson", "success", "subject"), "procedural": ("instruction", "scope", "rationale", "version", "active")}
    value = lambda c: (typed[c] if c in typed else _text(x, c)).cast("string")
    payload = F.coalesce(*[of(k, F.create_map(*[y for c in cs for y in (F.lit(c), value(c))])) for k, cs in parts.items()])
    return rows.select(*kept, "kind", "place", T.content_hash(text).alias("content_hash"), *[v.alias(k) for k, v in typed.items() if k not in kept], payload.alias("payload"))


def stated_fact(said: DataFrame) -> DataFrame:
    """Facts that a user states (user_id, content, and if wanted category and subject), as memories to put: of full
    confidence. Other categories than the known ones are an error of the caller and dropped."""
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in said.columns else F.lit(default)
    rows = said.select("user_id", "content", has("category", "fact").alias("category"), has("subject", "").alias("subject")).where(F.col("content").isNotNull() & F.col("category").isin(*CATEGORIES))
    payload = F.create_map(*[y for c, v in (("content", F.col("content")), ("category", F.col("category")), ("subject", F.col("subject")), ("confidence", F.lit(str(STATED))), ("source", F.lit("stated"))) for y in (F.lit(c), v)])
    return rows.select("user_id", F.lit("semantic").alias("kind"), T.content_hash(F.col("content")).alias("content_hash"), F.col("content").alias("searchable_text"), F.lit(STATED).alias("confidence"), F.lit("stated").alias("source"), payload.alias("payload"))

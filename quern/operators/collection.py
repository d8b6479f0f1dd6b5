"""A collection of chunks: what enters it, who sees which rows, and what it holds by title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

LEAST_WORDS = 8
MOST_TITLES, SCAN_ROWS = 10_000, 20_000
# Keys that a search may filter by, and extras that are kept with a chunk.
FILTER_KEYS = {"lesson_title": "string", "lesson_number": "int", "page_number": "int", "block_type": "string", "source_file": "string", "chunk_id": "string"}
CARRIED = ("table_id", "n_rows", "n_cols", "image_id", "storage_key", "storage_url", "width", "height")


def gate(embed_text: Column, kind: Column, least: int = LEAST_WORDS) -> Column:
    """Why a chunk is not stored (``empty``, ``too_short``), or null: tables and images may be short."""
    return F.when(T.blank_to_null(embed_text).isNull(), "empty").when(~F.coalesce(kind.isin("table", "image"), F.lit(False)) & ~T.counts_words(embed_text, least), "too_short")


def payload(chunks: DataFrame) -> DataFrame:
    """Chunks as rows of the collection: the lesson's number and title from the first section, known extras only."""
    heading = F.try_element_at("section_path", F.lit(1))
    carried = F.map_filter(F.coalesce("extra", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: k.isin(*CARRIED) & v.isNotNull())
    return chunks.select(T.point_id(F.col("chunk_id")).alias("point_id"), "chunk_id", "doc_id", "user_id", "text", T.lesson_title(F.coalesce("lesson_title", heading)).alias("lesson_title"), T.lesson_number(heading).alias("lesson_number"), F.col("page").alias("page_number"), "block_type", "chunk_index", "token_count", F.col("source_name").alias("source_file"), carried.alias("extras"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order``. Combined before the shuffle, so a key with very many rows is no
    burden on one task."""
    rest = [c for c in rows.columns if c not in key]
    found = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return found.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those with equal keys. ``new`` has one row for a key."""
    return stored.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def checked(collection: DataFrame, dimension: int | None = None) -> DataFrame:
    """``collection``, or an error if a column that searches need is missing; a vector of another length fails its task."""
    missing = {"chunk_id", "doc_id", "user_id", "text", "lesson_title", "block_type"} - set(collection.columns)
    if missing:
        raise ValueError(f"the collection lacks {sorted(missing)}")
    if dimension is None:
        return collection
    right = F.col("embedding").isNull() | (F.size("embedding") == dimension)
    return collection.withColumn("embedding", F.when(right, F.col("embedding")).otherwise(F.raise_error(F.lit(f"an embedding hasn't {dimension} components")).cast("array<float>")))


def tenant(rows: DataFrame, user_id, doc_ids: list | None = None, user_col: str = "user_id", doc_col: str = "doc_id") -> DataFrame:
    """Rows of one user and, if any are named, of these documents. Every read of a collection goes through here."""
    rows = rows.where(F.col(user_col) == F.lit(user_id))
    return rows.where(F.col(doc_col).isin(*doc_ids)) if doc_ids else rows


def payload_filter(filters: dict[str, list[str]] | None) -> tuple[Column, list[str]]:
    """The condition for all known keys together and the keys applied, sorted. Empty values and unknown keys are
    ignored; a value of a whole-number key that is no number matches nothing."""
    condition, applied = F.lit(True), []
    for key, values in sorted((filters or {}).items()):
        wanted = [v for v in values if v != ""]
        if key not in FILTER_KEYS or not wanted:
            continue
        applied.append(key)
        kind = FILTER_KEYS[key]
        condition = condition & F.coalesce(F.col(key).isin(*[F.lit(v).try_cast(kind) for v in wanted]), F.lit(False))
    return condition, applied


def ignored(filters: dict[str, list[str]] | None, applied: list[str]) -> list[str]:
    """Keys that were asked for and not applied, sorted."""
    return sorted(set(filters or {}) - set(applied))


def sanitised(filters: dict[str, list[str]] | None) -> dict[str, list[str]]:
    """A client's filters without the keys that only the engine sets, and without empty values."""
    clean = {k: [v for v in vs if v] for k, vs in (filters or {}).items() if k not in ("user_id", "doc_id")}
    return {k: vs for k, vs in clean.items() if vs}


def count_owned(rows: DataFrame, by: str = "user_id") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("total_chunks"))


def title_facet(rows: DataFrame, by: str = "user_id", title: str = "lesson_title", most: int = MOST_TITLES) -> DataFrame:
    """(by, title, chunk_count, total_chunks, truncated, lesson_index): titles of each user, the most frequent first.

    The total is that of chunks with a title. At most ``most`` titles of a user are listed.
    """
    counts = rows.where(F.col(title).isNotNull() & F.col(by).isNotNull()).groupBy(by, F.col(title).alias("title")).agg(F.count("*").alias("chunk_count"))
    totals = counts.groupBy(by).agg(F.sum("chunk_count").alias("total_chunks"), (F.count("*") > most).alias("truncated"))
    ranked = counts.withColumn("lesson_index", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("chunk_count"), "title")))
    return ranked.where(F.col("lesson_index") <= most).join(totals, by)


def title_scan(rows: DataFrame, key: str, by: str = "user_id", title: str = "lesson_title", most: int = SCAN_ROWS) -> DataFrame:
    """The facet over the first ``most`` rows of each user in order of ``key``: the fallback of a bounded scan.

    The total is that of all rows scanned, ``truncated`` whether rows remain.
    """
    ranked = rows.select(by, title, F.row_number().over(Window.partitionBy(by).orderBy(key)).alias("__n"))
    seen = ranked.where(F.col("__n") <= most + 1)
    totals = seen.groupBy(by).agg(F.count_if(F.col("__n") <= most).alias("total_chunks"), (F.max("__n") > most).alias("truncated"))
    counts = seen.where((F.col("__n") <= most) & F.col(title).isNotNull()).groupBy(by, F.col(title).alias("title")).agg(F.count("*").alias("chunk_count"))
    return counts.join(totals, by)


def catalogue(facet: DataFrame, by: str = "user_id") -> DataFrame:
    """(by, titles, version): each user's titles in order and the version that names exactly this list."""
    listed = facet.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("lesson_index", "title"))), lambda x: x["title"]).alias("titles"))
    return listed.withColumn("version", T.catalogue_version(F.col("titles")))


def titles_by_index(asked: DataFrame, facet: DataFrame, listed: DataFrame, by: str = "user_id") -> DataFrame:
    """(query_id, titles, status) of requests (query_id, user, lesson_indexes, version) that name lessons by their place.

    Places count from 1 and hold for one version of the catalogue. Status: ``ok``, ``no_lessons``,
    ``stale_catalogue`` for another version than the present one, ``unknown_lesson`` for a place that isn't there.
    """
    wanted = asked.select("query_id", by, F.explode(F.array_distinct("lesson_indexes")).alias("lesson_index"))
    found = wanted.join(facet.select(by, "lesson_index", "title"), [by, "lesson_index"]).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("lesson_index", "title"))), lambda x: x["title"]).alias("found"))
    rows = asked.join(listed.select(by, F.col("version").alias("present")), by, "left").join(found, "query_id", "left")
    status = F.when(F.col("present").isNull(), "no_lessons").when(F.col("version") != F.col("present"), "stale_catalogue").when(F.coalesce(F.size("found"), F.lit(0)) < F.size(F.array_distinct("lesson_indexes")), "unknown_lesson").otherwise("ok")
    return rows.select("query_id", F.when(status == "ok", F.col("found")).alias("titles"), status.alias("status"))

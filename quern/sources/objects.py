"""Keys of stored objects, and what may be uploaded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of an upload, and of a document, at most.
UPLOAD_BYTES, DOCUMENT_BYTES, NAME_CHARS = 100 * 1024 * 1024, 200 * 1024 * 1024, 255

# Parts of keys.
SOURCE, IMAGES, TABLES, METADATA, ASSETS = "source.pdf", "images", "tables", "metadata.json", "assets"
# Suffixes for documents whose name has none.
SUFFIXES = {"application/pdf": ".pdf", "application/json": ".json", "text/plain": ".txt", "text/html": ".html", "image/png": ".png", "image/jpeg": ".jpg"}


def safe_key(key: Column) -> Column:
    """Whether a key stays below its root: not empty, no leading slash, no ``..`` part."""
    return F.coalesce((key != "") & ~key.startswith("/") & ~F.array_contains(F.split(key, "/"), ".."), F.lit(False))


def source_key(user: Column, doc: Column) -> Column:
    return F.concat_ws("/", user, doc, F.lit(SOURCE))


def image_key(user: Column, doc: Column, image: Column, extension: Column) -> Column:
    """The extension may begin with dots."""
    return F.concat_ws("/", user, doc, F.lit(IMAGES), F.concat_ws(".", image, F.ltrim(extension, F.lit("."))))


def table_key(user: Column, doc: Column, table: Column) -> Column:
    return F.concat_ws("/", user, doc, F.lit(TABLES), F.concat(table.cast("string"), F.lit(".json")))


def metadata_key(user: Column, doc: Column) -> Column:
    return F.concat_ws("/", user, doc, F.lit(METADATA))


def asset_key(user: Column, doc: Column, digest: Column, extension: Column) -> Column:
    return F.concat_ws("/", user, doc, F.lit(ASSETS), F.concat_ws(".", digest, extension))


def suffix(name: Column, mime: Column) -> Column:
    """The name's suffix, else that of the MIME type, else ``.bin``."""
    own = F.lower(F.regexp_extract(name, r"[^/](\.[A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return F.coalesce(F.when(own != "", own), F.try_element_at(known, mime), F.lit(".bin"))


def admission(size: Column, content: Column, mode: str = "upload") -> Column:
    """``ok``, or why a file is turned away: ``too_large``, ``not_pdf`` (uploads only), ``empty``."""
    most = UPLOAD_BYTES if mode == "upload" else DOCUMENT_BYTES
    out = F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > most, "too_large")
    if mode == "upload":
        out = out.when(~F.coalesce(F.startswith(content, F.lit(b"%PDF-")), F.lit(False)), "not_pdf")
    return out.otherwise("ok")


def stored_name(name: Column) -> Column:
    return F.left(name, F.lit(NAME_CHARS))

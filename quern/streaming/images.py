"""Pictures of documents: chunks that stand for them, requests to describe them, and a stream that describes them.

A picture's chunk goes out at once with the text that was recognised in it, or a sentence that names it; a request asks
for a description. The stream keeps the description of each picture by digest for some time, so that the same picture is
described once; a chunk with the description then overwrites the first one. Where the model says that it is asked too
often, requests wait in the state until a timer asks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from quern.functions import text as T
from quern.sources.events import json_object, utf8
from quern.sources.objects import asset_key

REQUEST = "schema_version int, doc_id string, user_id string, source_name string, chunk_id string, chunk_index int, page int, section_path array<string>, storage_key string, content_type string, image_sha256 string, fallback_text string"
REQUEST_NAMES = [f.split(" ")[0] for f in REQUEST.split(", ")]
NEEDED = ("doc_id", "user_id", "source_name", "chunk_id", "storage_key", "content_type", "image_sha256", "fallback_text")
#: Days that a description is kept, seconds until a model that is asked too often is asked again.
KEPT_DAYS, CIRCUIT_SECONDS = 30, 90


def pictures(images: DataFrame, describe: bool = True) -> DataFrame:
    """``images`` (doc_id, user_id, source_name, unit, chunk_index, section_path, bbox, digest, extension, content_type,
    ocr_text, width, height) with ``chunk_id``, ``storage_key``, the chunk's text and extras, and ``request``, the JSON that
    asks for a description (null unless ``describe``)."""
    # Fixed value: how a picture without recognised text is named.
    named = F.format_string("Image from %s, unit %d, dimensions %dx%d.", "source_name", "unit", "width", "height")
    recognised = T.blank_to_null(T.strip(F.col("ocr_text")))
    rows = images.withColumns({
        "chunk_type": F.lit("image"), "text": F.coalesce(recognised, named),
        "chunk_id": T.chunk_id(F.col("doc_id"), F.col("unit"), F.lit("image"), F.col("chunk_index")),
        "storage_key": asset_key(F.col("user_id"), F.col("doc_id"), F.col("digest"), F.col("extension")),
    })
    extra = F.create_map(*[x for k, v in (("image_id", F.col("digest")), ("storage_key", F.col("storage_key")), ("width", F.col("width")), ("height", F.col("height")), ("ocr", F.coalesce(F.col("ocr_text") != "", F.lit(False))), ("enrichment_pending", F.lit(describe))) for x in (F.lit(k), v.cast("string"))])
    fields = F.struct(F.lit(1).alias("schema_version"), "doc_id", "user_id", "source_name", "chunk_id", "chunk_index", F.col("unit").alias("page"), "section_path", "storage_key", "content_type", F.col("digest").alias("image_sha256"), F.col("text").alias("fallback_text"))
    return rows.withColumns({"embed_text": F.col("text"), "token_count": T.token_estimate(F.col("text")), "extra": extra, "request": F.to_json(fields) if describe else F.lit(None).cast("string")})


def decode_requests(messages: DataFrame, value: str = "value") -> DataFrame:
    """``messages`` with ``request`` and ``reject_reason``. A page may be null, a section may be missing."""
    rows = messages.withColumn("request", F.from_json(utf8(F.col(value)), REQUEST))
    reason = F.when(~json_object(F.col(value)), "decode:json")
    for c in NEEDED:
        reason = reason.when(F.col(f"request.{c}").isNull(), f"decode:{c}")
    reason = reason.when(F.col("request.chunk_index").isNull(), "decode:chunk_index")
    filled = F.col("request").withField("section_path", F.coalesce("request.section_path", F.array().cast("array<string>"))).withField("schema_version", F.coalesce("request.schema_version", F.lit(1)))
    return rows.withColumn("reject_reason", reason).withColumn("request", F.when(F.col("reject_reason").isNull(), filled))


def described(requests: DataFrame, caption: Column) -> DataFrame:
    """Chunks (REQUEST's fields, text, token_count, extra, partition_key) of requests with a description; a blank one is
    replaced by the request's own text."""
    text = F.coalesce(T.blank_to_null(caption), F.col("fallback_text"))
    extra = F.create_map(*[x for k, v in (("chunk_id", "chunk_id"), ("doc_id", "doc_id"), ("user_id", "user_id"), ("source_name", "source_name"), ("storage_key", "storage_key"), ("image_id", "image_sha256")) for x in (F.lit(k), F.col(v))], F.lit("enrichment_pending"), F.lit("false"))
    key = F.concat_ws(":", "doc_id", F.coalesce("page", F.lit(0)).cast("string"))
    return requests.withColumns({"text": text, "embed_text": text, "chunk_type": F.lit("image"), "token_count": T.token_estimate(text), "extra": extra, "partition_key": key, "require_title": F.size("section_path") > 0})


_request = Row(*REQUEST_NAMES)
_answered = Row(*REQUEST_NAMES, "caption", "cached")


def _row(request: Row, caption: str | None, cached: bool) -> Row:
    return _answered(*request, caption, cached)


class TooOften(Exception):
    """The model is asked too often and should be left alone for a while."""


class Describer(StatefulProcessor):
    """For each digest: its description, kept for a time, and the requests that wait for the model."""

    def __init__(self, model: Callable[[str, str], str | None], kept_ms: int, circuit_ms: int):
        self.model, self.kept_ms, self.circuit_ms = model, kept_ms, circuit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.caption = handle.getValueState("caption", "caption string", ttlDurationMs=self.kept_ms)
        self.waiting = handle.getListState("waiting", REQUEST)

    def _answer(self, requests: list[Row], now: int) -> Iterator[Row]:
        for n, r in enumerate(requests):
            known = self.caption.get() if self.caption.exists() else None
            if known is not None:
                yield _row(r, known[0], True)
                continue
            try:
                said = self.model(r.storage_key, r.content_type)
            except TooOften:
                for rest in requests[n:]:
                    self.waiting.appendValue(tuple(rest))
                self.handle.registerTimer(now + self.circuit_ms)
                return
            if said and said.strip():
                self.caption.update((said,))
            yield _row(r, said, False)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        new = list(rows)
        if self.waiting.exists():  # asked too often a while ago: these wait as well
            for r in new:
                self.waiting.appendValue(tuple(r))
            return
        yield from self._answer(new, now)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        waited = [_request(*r) for r in self.waiting.get()]
        self.waiting.clear()
        yield from self._answer(waited, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def describe_stream(requests: DataFrame, model: Callable[[str, str], str | None], kept_seconds: float = KEPT_DAYS * 86_400, circuit_seconds: float = CIRCUIT_SECONDS) -> DataFrame:
    """Chunks of a stream of requests (``REQUEST``), and ``cached``: whether the description was known.

    ``model`` takes a storage key and a content type. What it returns is kept for ``kept_seconds`` by the picture's
    digest, unless it is blank; then the request's own text stands in. Where it raises ``TooOften``, the requests of that
    digest wait ``circuit_seconds``; any other error fails the batch, which is then delivered again. The session needs
    the RocksDB state store.
    """
    found = requests.groupBy("image_sha256").transformWithState(Describer(model, int(kept_seconds * 1000), int(circuit_seconds * 1000)), f"{REQUEST}, caption string, cached boolean", "append", "ProcessingTime")
    return described(found, F.col("caption")).drop("caption")

"""The answer cache as a stream with state: stores, look-ups and changes of a user's data in order of arrival.

Each user has a map from scope and question to an answer, whose entries live for a time that every store into their scope
starts anew. A change of the user's documents or memories makes all their answers void at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from quern.operators.cache import MOST_ENTRIES, SIMILARITY

TTL_SECONDS = 86_400
EVENT = "user_id string, event_id bigint, kind string, docs array<string>, question string, answer string, embedding array<double>"
FOUND = "user_id string, event_id bigint, outcome string, question string, answer string, similarity double"

_found = Row("user_id", "event_id", "outcome", "question", "answer", "similarity")


def scope_of(docs: list[str] | None) -> str:
    """Documents of an answer, in whatever order; none means all."""
    return ",".join(sorted(set(docs or []))) or "*"


def field_of(question: str | None) -> str:
    """The same question overwrites its answer."""
    return hashlib.sha256((question or "").strip().lower().encode("utf-8", "surrogatepass")).hexdigest()[:24]


def cosine(a: list[float] | None, b: list[float] | None) -> float:
    """0 where there is none: null, zero or of another length."""
    if not a or not b or len(a) != len(b):
        return 0.0
    x, y = np.array(a, dtype=float), np.array(b, dtype=float)
    size = float(np.sqrt((x @ x) * (y @ y)))
    return float(x @ y) / size if size > 0 else 0.0


class Answers(StatefulProcessor):
    """Of one user: scope and question's field to (question, answer, embedding, nth store)."""

    def __init__(self, ttl_ms: int, least: float, most: int):
        self.ttl_ms, self.least, self.most = ttl_ms, least, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "scope string, field string", "question string, answer string, embedding array<double>, nth bigint", ttlDurationMs=self.ttl_ms)

    def _of(self, scope: str) -> list[tuple]:
        """Entries of a scope, oldest first."""
        return sorted(((k, v) for k, v in self.entries.iterator() if k[0] == scope), key=lambda e: e[1][3])

    def _store(self, e: Row) -> None:
        scope, field = scope_of(e.docs), field_of(e.question)
        kept = [(k, v) for k, v in self._of(scope) if k[1] != field]
        nth = kept[-1][1][3] + 1 if kept else 0
        for k, _ in kept[: max(0, len(kept) + 1 - self.most)]:
            self.entries.removeKey(tuple(k))
        for k, v in kept[max(0, len(kept) + 1 - self.most) :]:
            self.entries.updateValue(tuple(k), tuple(v))  # lives on from now
        self.entries.updateValue((scope, field), (e.question, e.answer, list(e.embedding), nth))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for e in sorted(rows, key=lambda r: r.event_id):
            if e.kind == "change":
                self.entries.clear()
            elif e.kind == "store" and e.embedding and e.answer and e.answer.strip():
                self._store(e)
            elif e.kind == "lookup":
                scored = [(cosine(e.embedding, v[2]), k[1], v) for k, v in self._of(scope_of(e.docs))]
                best = min(scored, key=lambda s: (-s[0], s[1]), default=None)
                if best is None:
                    yield _found(key[0], e.event_id, "empty", None, None, None)
                elif best[0] < self.least:
                    yield _found(key[0], e.event_id, "below", None, None, best[0])
                else:
                    yield _found(key[0], e.event_id, "hit", best[2][0], best[2][1], best[0])

    def close(self) -> None:
        pass


def answer_stream(events: DataFrame, ttl_seconds: float = TTL_SECONDS, least: float = SIMILARITY, most: int = MOST_ENTRIES) -> DataFrame:
    """``FOUND`` for each look-up of a stream of ``EVENT``: ``hit`` with the most similar answer of the same user and
    documents, ``below`` where none is similar enough, ``empty`` where there is none.

    Events of a user are taken in order of ``event_id`` within a batch. ``store`` keeps an answer (one without a vector or text
    isn't kept), at most the newest ``most`` of a scope; ``change`` makes a user's answers void. Of equally similar
    answers the one with the smaller field is found. The session needs the RocksDB state store.
    """
    return events.groupBy("user_id").transformWithState(Answers(int(ttl_seconds * 1000), least, most), FOUND, "append", "ProcessingTime")

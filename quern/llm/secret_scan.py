"""Operator 8: secret scan with multipart credential linking.

Strong patterns are found as they stand. Weak parts (an access identifier, a secret-looking value, an endpoint)
are candidates only: an interval join of a document's identifiers with its secrets, and of its secrets with its
endpoints, reports a part where one that complements it is in reach. Parts don't lengthen each other's reach. The join
is two sweeps over the sorted parts of one document, linear in their number, so thousands of parts make no pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "identifier", "value", "endpoint")

# Weak parts. An identifier and an endpoint are named or typed; a value is a long run of mixed characters.
IDENTIFIER = re.compile(r"""(?:access_?key(?:_?id)?|client_?id|account_?(?:id|name)|user(?:name)?|login|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})""", re.ASCII | re.IGNORECASE)
VALUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])", re.ASCII)
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~:/?#@!$&()*+,;=%\[\]-]+|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]+\.[A-Za-z]{2,}[A-Za-z0-9.:/_-]*)""", re.ASCII | re.IGNORECASE)
_DIGIT, _HINTS = re.compile(r"[0-9]"), ("password", "passwd", "secret", "token", "apikey", "api_key")

#: What each kind of part is to a credential, and what complements it.
ROLES = ("secret", "identifier", "secret", "identifier", "secret", "endpoint")
COMPLEMENTS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}
#: Characters between a part and one that complements it at most; no empty line stands between them.
SCOPE = 240
_EMPTY_LINE = re.compile(r"\n\n")
#: Bits a character that a weak value must have.
ENTROPY = 3.2

Span = tuple[int, int, int]  # start, index in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Spans of the strong patterns: whole matches, in order of start and kind."""
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts with a complementary part in reach. Base spans take part as what they are, and stay."""
    if not ("=" in text or ":" in text or base) or not (_DIGIT.search(text) or base):
        return []
    weak: list[Span] = []
    weak += [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)] if "=" in text or ":" in text else []
    weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if "=" in text or ":" in text else []
    taken = sorted([(s, e) for s, _, e in (*weak, *base)])
    values, k, reach = [], 0, -1
    for m in VALUE.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach, k = max(reach, taken[k][1]), k + 1
        if reach <= m.start() and _entropy(m.group()) >= ENTROPY:
            values.append((m.start(), 4, m.end()))
    weak = sorted(weak + values)
    if not weak:
        return []
    linked = in_reach(sorted([*weak, *base]), text)
    return [p for p, found in linked if found and p[1] >= 3]


def in_reach(parts: list[Span], text: str) -> list[tuple[Span, bool]]:
    """Each of the sorted ``parts``, and whether one that complements it stands within ``SCOPE`` in its paragraph.

    The interval of a part is its span and ``SCOPE`` characters to both sides. Of the parts that complement it the one
    that ends last before it and the one that begins next are the nearest, so two passes decide the join, however many
    parts there are.
    """
    breaks = [m.start() for m in _EMPTY_LINE.finditer(text)]
    found = [False] * len(parts)
    for order, back in ((range(len(parts)), False), (range(len(parts) - 1, -1, -1), True)):
        edge: dict[str, int] = {}  # of each role, how far the parts that were passed reach towards this one
        paragraph = -1
        for k in order:
            start, kind, end = parts[k]
            if (here := bisect_right(breaks, start)) != paragraph:
                edge, paragraph = {}, here
            for other in COMPLEMENTS[ROLES[kind]]:
                if other in edge and (edge[other] - end if back else start - edge[other]) <= SCOPE:
                    found[k] = True
            role = ROLES[kind]
            edge[role] = min(edge.get(role, start), start) if back else max(edge.get(role, end), end)
    return list(zip(parts, found, strict=True))


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a whole text; a null text is empty."""
    text = text or ""
    base = base_spans(text)
    return base, linked_spans(text, base)


def written(spans: list[Span]) -> str:
    """``kind:start:end`` by start, then kind as listed, joined by commas; code points, end exclusive."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    A null or empty text has no spans. Repeated rows give a row each; other columns are not read, so clashing
    names do no harm. An empty table gives an empty result. Nothing is shuffled.
    """

    @arrow_udf("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string,n_linked:bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for text in batch.to_pylist():
                base, linked = spans_of(text)
                n = Counter(k for _, k, _ in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(written(base).encode()).hexdigest(), written(base + linked), len(linked)))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("r")).select("doc_id", "r.*")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span, strong or linked, replaced by ``mark``; other texts and columns as they are.

    Overlapping spans are replaced together. A null text stays null.
    """

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                base, linked = spans_of(text)
                parts, at = [], 0
                for s, _, e in sorted(base + linked):
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                out.append("".join([*parts, text[at:]]) if at else text)
            yield pa.array(out, pa.string())

    return docs.withColumn(text_col, run(F.col(text_col)))

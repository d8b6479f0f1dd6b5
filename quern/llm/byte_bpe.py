"""Operator 9: byte-level BPE encoding and decoding by a segment tree over byte positions.

The leaves of a tree are the byte positions of a piece; each holds the rank of the pair that its token
forms with the next living one, and inner nodes hold the minimum of (rank, position). The root is thus the
leftmost pair of least rank. A merge changes three leaves (the pair, its right half, its left neighbour), and
each change climbs one path: O(log n) point updates a merge, O(n log n) for a piece of any length.

Many short pieces are merged side by side in numpy arrays, one tree a row; a long piece has a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quern.llm.segments import SegmentTable, in_slices, rows_of
from quern.llm.shared import text_slices

_NONE = np.int64(1) << 60
_LONG = 128  # bytes from which a piece gets a tree of its own


class PairRanks:
    """Rank of the token that two neighbouring tokens make, for arrays of token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(values, dtype=np.int64)[order], -1)
        self.table = dict(zip(self.keys.tolist(), self.values.tolist(), strict=True))

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where the two make no token, or where one of them is negative (absent)."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        at[at >= len(self.keys)] = len(self.keys) - 1
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.values[at], -1)


def merge_one(tokens: list[int], pairs: PairRanks) -> list[int]:
    """Token ids of one long piece, given the ids of its bytes."""
    n = len(tokens)
    width = 1 << max(0, (n - 1).bit_length())
    none = (1 << 60, 0)
    tokens = list(tokens)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = pairs.table.get

    def leaf(i: int) -> tuple[int, int]:
        j = after[i]
        rank = get(tokens[i] << 32 | tokens[j]) if j < n else None
        return none if rank is None else (rank, i)

    tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: tuple[int, int]) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    alive = [True] * n
    while width > 1 and tree[1] != none:
        rank, i = tree[1]
        j = after[i]
        tokens[i], alive[j] = rank, False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    return [t for t, a in zip(tokens, alive, strict=True) if a]


def merge_many(tokens: np.ndarray, pairs: PairRanks) -> np.ndarray:
    """Rows of token ids padded by -1 to a power of two; returns the rows with merged-away places as -1."""
    n, width = tokens.shape
    tokens = np.concatenate([tokens, np.full((n, 2), -1, dtype=tokens.dtype)], axis=1)  # a place past the end, and one before the start
    after = np.tile(np.arange(1, width + 1), (n, 1))
    before = np.tile(np.arange(-1, width), (n, 1))
    place = np.arange(width, dtype=np.int64)
    tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
    rank = pairs.of(tokens[:, :width], tokens[:, 1 : width + 1])
    tree[:, width:] = np.where(rank >= 0, rank * width + place, _NONE)
    k = width >> 1
    while k:
        tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        k >>= 1

    def put(rows: np.ndarray, at: np.ndarray, value) -> None:
        k = at + width
        tree[rows, k] = value
        for _ in range(width.bit_length() - 1):
            k = k >> 1
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

    def leaf(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank = pairs.of(tokens[rows, at], tokens[rows, after[rows, at]])
        return np.where(rank >= 0, rank * width + at, _NONE)

    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(rows):
        root = tree[rows, 1]
        i = root % width
        j = after[rows, i]
        tokens[rows, i] = root // width
        tokens[rows, j] = -1
        last = after[rows, j]
        after[rows, i] = last
        before[rows, last] = i
        put(rows, j, _NONE)
        put(rows, i, leaf(rows, i))
        left = before[rows, i]
        has = left >= 0
        if has.any():
            put(rows[has], left[has], leaf(rows[has], left[has]))
        rows = rows[tree[rows, 1] < _NONE]
    return tokens[:, :width]


class ByteBpe:
    """A byte-level BPE by ranks: ``ids(segments)`` and ``text(ids)``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pairs = ranks, PairRanks(ranks)
        self.pattern = regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.digits = [str(i) for i in range(len(self.tokens))]

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}, pattern)

    def pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece. A piece that is itself a token is that token, as in rank-file tokenizers."""
        out: list[tuple[int, ...] | None] = []
        sized: dict[int, list[int]] = {}
        for at, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out.append((whole,))
            elif len(p) > _LONG:
                out.append(tuple(merge_one(self.byte[np.frombuffer(p, dtype=np.uint8)].tolist(), self.pairs)))
            else:
                out.append(None if p else ())
                if p:
                    sized.setdefault(1 << (len(p) - 1).bit_length(), []).append(at)
        for width, places in sized.items():
            for some in in_slices(places, 4096):
                some_pieces = [pieces[at] for at in some]
                packed = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in some_pieces]), dtype=np.uint8).reshape(-1, width)
                lengths = np.fromiter(map(len, some_pieces), dtype=np.int64, count=len(some))
                merged = merge_many(np.where(np.arange(width) < lengths[:, None], self.byte[packed], -1), self.pairs)
                left = merged >= 0
                flat, start = tuple(merged[left].tolist()), 0
                for at, end in zip(some, np.cumsum(left.sum(axis=1)).tolist(), strict=True):
                    out[at] = flat[start:end]
                    start = end
        return out  # type: ignore[return-value]

    def ids(self, texts: list[str]) -> list[tuple[int, ...]]:
        """Ids of each text; each distinct match of the pattern is merged once."""
        matches = list(map(self.pattern.findall, texts))
        distinct = list(set().union(*matches))
        known = dict(zip(distinct, self.pieces([m.encode("utf-8") for m in distinct]), strict=True))
        return [known[ms[0]] if len(ms) == 1 else tuple(i for m in ms for i in known[m]) for ms in matches]

    def text(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe.load(path, pattern)


def _table(codec: ByteBpe) -> SegmentTable:
    """A table for one task: what it holds goes with the task, whatever runs in its worker next."""
    return SegmentTable(lambda segments: rows_of(codec.ids(segments)), limit=500_000)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array<int>). A null text has no ids."""

    @arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _table(_codec(path, pattern))
        for batch in batches:
            out = []
            for texts in text_slices(batch):
                out += [ids.tolist() for ids in table.of(texts).texts()]
            yield pa.array(out, pa.list_(pa.int32()))

    return docs.withColumn(into, run(F.col(text_col)))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its ids stand for. Null ids, and ids that are no token, give nothing."""

    @arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path, pattern)
        most = len(codec.tokens)
        for batch in batches:
            yield pa.array([codec.text([i for i in ids or () if i is not None and 0 <= i < most]) for ids in batch.to_pylist()], pa.binary())

    return df.withColumn(into, run(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256.

    ``with_ids`` adds the ids themselves (array<int>).

    A null text counts as empty (no ids). Repeated rows and repeated ids give a row each; other columns,
    whatever their names, are not read. An empty table gives an empty result.

    Encoding, decoding and both digests run in one pass over Arrow batches; no row is shuffled.
    """

    @arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + (",ids:array<int>>" if with_ids else ">"))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path, pattern)
        table = _table(codec)
        digit = codec.digits.__getitem__
        for batch in batches:
            n, sha, back, all_ids = [], [], [], []
            for texts in text_slices(batch):
                for found in table.of(texts).texts():
                    ids = found.tolist()
                    n.append(len(ids))
                    sha.append(hashlib.sha256(",".join(map(digit, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(codec.text(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids, dtype=np.int32))
            columns, names = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.StructArray.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("r")).select("doc_id", "r.*")

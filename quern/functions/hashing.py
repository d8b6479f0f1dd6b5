"""The standard MurmurHash3 (x86, 32 bits, seed 0) over arrays of tokens. Spark's ``hash`` has another tail."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType

#: Buckets of the hashed vocabulary.
BUCKETS = 1 << 20

# Constants of the published function.
_C1, _C2, _N, _F1, _F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3(tokens: list[bytes]) -> np.ndarray:
    """Unsigned hashes, of all tokens side by side."""
    n = len(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=n)
    width = max(4, int(-(-lengths.max(initial=0) // 4) * 4))
    raw = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), dtype="<u4").reshape(n, width // 4)
    h = np.zeros(n, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(width // 4):
            block = _rotl(raw[:, k] * np.uint32(_C1), 15) * np.uint32(_C2)
            whole, tail = lengths >= 4 * k + 4, (lengths > 4 * k) & (lengths < 4 * k + 4)
            h = np.where(whole, _rotl(h ^ block, 13) * np.uint32(5) + np.uint32(_N), np.where(tail, h ^ block, h))
        h ^= lengths.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(_F1)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(_F2)
        return h ^ (h >> np.uint32(16))


@arrow_udf(IntegerType())
def _buckets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        distinct = batch.dictionary_encode()
        hashed = murmur3([(t or "").encode() for t in distinct.dictionary.to_pylist()]) % np.uint32(BUCKETS)
        codes = distinct.indices.to_numpy(zero_copy_only=False)
        yield pa.array(hashed.astype(np.int32)[np.nan_to_num(codes).astype(np.int64)] if len(hashed) else np.zeros(len(codes), np.int32), pa.int32(), mask=np.asarray(batch.is_null()))


def bucket(token: Column) -> Column:
    """The bucket of a token, below ``BUCKETS``; null for null."""
    return _buckets(token)

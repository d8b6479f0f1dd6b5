"""What several corpus operators share: the shared folder, tables cut from their lineage, hosts of words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where it is unset on a local master (tests in one JVM) a fresh temporary folder is made and kept for the
    session. On a cluster no executor would see it, so there an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quern.shared.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.shared.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and each row is made once."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with as many underscores after it as make it a name that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the split of training and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


#: Characters that are hashed at a time; a longer text is cut before a sign that belongs to no word.
HASH_BLOCK = (1 << 19) - 1
_STEP, _BACK = 0x9E3779B97F4A7C55, pow(0x9E3779B97F4A7C55, -1, 1 << 64)


@cache
def _signs() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it belongs to words (``\\w``), and a random 64-bit value."""
    inside = np.array([(c := chr(k)).isalnum() or c == "_" for k in range(0x110000)])
    return inside, mix(np.arange(1, 0x110001, dtype=np.uint64) * _M1)


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, or some more, of an odd number and of its inverse; those of the largest ``n`` are kept."""
    for step in (_STEP, _BACK):
        if len(_POWERS.get(step, ())) < n:
            made = np.full(1 << max(HASH_BLOCK.bit_length(), n.bit_length()), step, dtype=np.uint64)
            made[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[step] = np.cumprod(made)
    return _POWERS[_STEP], _POWERS[_BACK]


class WordHashes:
    """64-bit hashes of the words (``\\w+``, lower case) of texts, in order.

    A word's hash is a polynomial of its signs, taken as a difference of running sums over all signs of many texts.
    """

    def of(self, text: str) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The hashes for each text; a null text has none."""
        out: list[np.ndarray] = []
        some: list[str] = []
        size = 0
        for text in texts:
            low = (text or "").lower()
            if some and size + len(low) >= HASH_BLOCK:
                out += self._block(some)
                some, size = [], 0
            if len(low) > HASH_BLOCK:
                out.append(np.concatenate([h for part in _parts(low) for h in self._block([part])]))
            else:
                some.append(low)
                size += len(low) + 1
        return out + self._block(some) if some else out

    @staticmethod
    def _block(texts: list[str]) -> list[np.ndarray]:
        inside, values = _signs()
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        word = np.concatenate([[False], inside[codes], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        start, end = edges[::2], edges[1::2]
        up, down = powers(len(codes) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values[codes] * up[: len(codes)])])
            hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return np.split(hashes, np.searchsorted(start, ends[:-1]))


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that no word crosses; a word longer than a part stays whole."""
    inside, at = _signs()[0], 0
    while at < len(text):
        end = min(len(text), at + HASH_BLOCK)
        while end < len(text) and inside[ord(text[end])]:
            end += 1
        yield text[at:end]
        at = end


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts`` and have ``lengths``, one after the other."""
    return values[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; a text of fewer words has one run, an empty one none."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        out = words[: len(words) - n + 1] + np.uint64(n)
        for k in range(1, n):
            out = out * _M1 + words[k : len(words) - n + 1 + k]
        return mix(out)


def text_slices(column: pa.Array, most: int = 512, size: int = 4_000_000) -> Iterator[list[str]]:
    """Neighbouring texts, null ones empty: a bounded number and, unless one is longer, of a bounded size in bytes together."""
    start, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if k > start and (k - start >= most or held + n > size):
            yield [t or "" for t in column.slice(start, k - start).to_pylist()]
            start, held = k, 0
        held += n
    if start < len(column):
        yield [t or "" for t in column.slice(start).to_pylist()]


@cache
def _malloc_trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Return freed memory that Arrow's pool and the C library (if it is glibc) keep for this worker to the system, for
    many small objects freed between large arrays leave a worker with twice the memory that it holds."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)

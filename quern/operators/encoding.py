"""Sparse encoding: token counts, saturation, hashed buckets, inverse document frequency; hooks for dense models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.hashing import bucket

K1 = 1.2
#: Characters of a text that a dense model gets.
DENSE_CHARS = 8192
#: Terms of a vocabulary (some ten bytes each) up to which it is broadcast.
SMALL = 200_000


def saturated(count: Column, k1: float = K1) -> Column:
    """Weight of a term that stands ``count`` times in a text; text length plays no part."""
    return count * (k1 + 1) / (count + k1)


def idf(n_docs: Column, n_with: Column) -> Column:
    """BM25's inverse document frequency, never negative."""
    return F.log(1 + (n_docs - n_with + 0.5) / (n_with + 0.5))


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df``, with a hint to broadcast it if it has at most ``most`` rows; else a join of it is left to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def term_counts(rows: DataFrame, *keys: str, text: str = "text", vocabulary: DataFrame | None = None) -> DataFrame:
    """(keys, term, n): how often each token stands in each text. With a ``vocabulary`` (term) only its tokens.

    Counting is combined before the shuffle, where all tokens of a text still are in one task. A vocabulary of at
    most ``SMALL`` terms goes to the tasks, so that no other token is shuffled.
    """
    found = rows.select(*keys, F.explode(T.tokens(F.col(text))).alias("term"))
    if vocabulary is not None:
        found = found.join(small(vocabulary), "term", "left_semi")
    return found.groupBy(*keys, "term").agg(F.count("*").alias("n"))


def sparse_vectors(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, bucket, value): tokens hashed to buckets, counts of tokens that share one added before saturation."""
    found = rows.select(key, F.explode(T.tokens(F.col(text))).alias("term")).select(key, bucket(F.col("term")).alias("bucket"))
    return found.groupBy(key, "bucket").agg(saturated(F.count("*")).alias("value"))


def valid_sparse(indices: Column, values: Column) -> Column:
    """Whether a sparse vector's two lists belong together."""
    return F.coalesce(F.size(indices) == F.size(values), F.lit(False))


def dense(rows: DataFrame, model: Callable[[list[str]], np.ndarray], dimension: int, text: str = "text", into: str = "embedding", prefix: str = "", batch: int = 16) -> DataFrame:
    """``rows`` with unit vectors from ``model``, a function from texts to a matrix of ``dimension`` columns.

    Texts are cut to ``DENSE_CHARS``, as models take no more; a null text has a null vector.
    """

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches:
            texts, out = part.to_pylist(), []
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                found = np.asarray(model([prefix + (t or "")[:DENSE_CHARS] for t in some]), dtype=np.float64)
                if found.shape != (len(some), dimension):
                    raise ValueError(f"the model gave {found.shape}, wanted {(len(some), dimension)}")
                length = np.sqrt((found * found).sum(axis=1, keepdims=True))
                out += [None if t is None else v for t, v in zip(some, (found / np.where(length > 0, length, 1)).astype(np.float32), strict=True)]
            yield pa.array(out, pa.list_(pa.float32()))

    return rows.withColumn(into, run(F.col(text)))

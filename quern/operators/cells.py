"""Top-k by vector with cells that are passed over: a stored index of unit vectors by user and cell.

Each vector belongs to the nearest of some pivots; a cell keeps the least and the greatest angle of its vectors to its
pivot, for each user. By the triangle inequality of angles no vector of a cell is nearer to a query than the query's own
angle to the pivot less these. A query first reads its most promising cells, as many as hold ``k`` vectors; with the k-th
score found there it then reads only those of the other cells that could hold a better one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators.encoding import small
from quern.operators.search import FEW, top
from quern.sources.tables import new_path, stored

#: Pivots at most, and vectors that they are drawn from.
PIVOTS, SAMPLE = 128, 8192
#: What angles may be off by.
SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    """``vectors`` (chunk_id, user_id, v, size, cell) and ``heads`` (user_id, size, cell, pivot, near, far, held): each
    cell of a user with the angles of its nearest and farthest vector."""

    vectors: DataFrame
    heads: DataFrame


def pivots_of(sample: np.ndarray, most: int, seed: int = 5) -> np.ndarray:
    """Unit vectors that are far apart: each next one is the farthest of the sample from those before."""
    if not len(sample):
        return sample
    chosen = [int(np.random.default_rng(seed).integers(len(sample)))]
    best = sample @ sample[chosen[0]]
    while len(chosen) < min(most, len(sample)) and best.min() < 1 - 1e-9:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, sample @ sample[chosen[-1]])
    return sample[chosen]


def build(chunks: DataFrame, pivots: int = PIVOTS) -> Cells:
    """The index of ``chunks`` (chunk_id, user_id, embedding). Vectors that are null or all zeros aren't in it; those of
    another length than the most frequent one are in a cell that is always read. Pivots come from a bounded sample; all vectors are indexed."""
    unit = stored(chunks.select("chunk_id", "user_id", V.unit(F.col("embedding")).alias("v")).where("v is not null").withColumn("size", F.size("v")), "unit")
    shape = unit.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    length, n = (shape[0]["size"], shape[0].n) if shape else (0, 1)
    drawn = unit.where((F.col("size") == length) & (F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) <= F.lit((1 << 20) * SAMPLE / n))).select("v").limit(2 * SAMPLE).toArrow()["v"].to_pylist()
    points = pivots_of(np.array(drawn, dtype=float).reshape(len(drawn), length), min(pivots, max(1, int(n**0.5) // 2)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.full(batch.num_rows, -1, dtype=np.int32), np.zeros(batch.num_rows)
            mine = np.flatnonzero(batch.column(3).to_numpy() == length) if len(points) else []
            for some in range(0, len(mine), 4096):
                at = mine[some : some + 4096]
                x = batch.column(2).take(pa.array(at)).flatten().to_numpy().reshape(len(at), length)
                near = x @ points.T
                cell[at] = near.argmax(axis=1)
                angle[at] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=["chunk_id", "user_id", "v", "size", "cell", "angle"])

    kinds = dict(unit.dtypes)
    placed = unit.select("chunk_id", "user_id", "v", "size").mapInArrow(place, f"chunk_id {kinds['chunk_id']}, user_id {kinds['user_id']}, v array<double>, size int, cell int, angle double")
    # A folder for each cell, so that cells that no query wants aren't opened; a cell of many vectors has several files.
    path, salt = new_path(chunks.sparkSession, "cells"), F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, n // 1_000_000)))
    placed.repartition("cell", salt).write.partitionBy("cell").parquet(path)
    placed = chunks.sparkSession.read.schema(placed.schema).parquet(path)
    heads = placed.groupBy("user_id", "size", "cell").agg(F.min("angle").alias("near"), F.max("angle").alias("far"), F.count("*").alias("held"))
    known = chunks.sparkSession.createDataFrame([(k, [float(y) for y in p]) for k, p in enumerate(points)], "cell int, pivot array<double>")
    return Cells(placed.drop("angle"), stored(heads.join(F.broadcast(known), "cell", "left"), "heads"))


def bounds(cells: Cells, queries: DataFrame) -> DataFrame:
    """(query_id, user_id, size, cell, held, bound): the greatest cosine that a vector of each cell of its user can have
    with a query (query_id, user_id, q)."""
    pairs = cells.heads.join(small(queries, FEW), "user_id").where(F.size("q") == F.col("size"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(F.col("q"), F.col("pivot")))))
    least = F.greatest(F.lit(0.0), F.col("near") - angle - SLACK, angle - F.col("far") - SLACK)
    return pairs.select("query_id", "user_id", "size", "cell", "held", F.when(F.col("pivot").isNull(), F.lit(1.0)).otherwise(F.cos(least)).alias("bound"))


def topk(cells: Cells, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, score, rank) of ``queries`` (query_id, user_id, embedding), the same as a search of all of a
    user's vectors; and for each query (query_id, cells, visited) how many cells its user has and how many were read."""
    asked = stored(queries.select("query_id", "user_id", V.unit(F.col("embedding")).alias("q")).where("q is not null"), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
    ahead = F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = stored(bounds(cells, asked).withColumn("first", ahead < k), "bounds")

    def read(some: DataFrame) -> DataFrame:
        wanted = small(some.join(asked.select("query_id", "q"), "query_id").select("query_id", "q", "user_id", "size", "cell"), FEW)
        found = cells.vectors.join(wanted, ["user_id", "size", "cell"])
        return found.select("query_id", "chunk_id", F.round(V.dot(F.col("q"), F.col("v")), 6).alias("score"))

    near = stored(top(read(pairs.where("first")), k).drop("rank"), "near")
    least = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    rest = stored(pairs.where("not first").join(least, "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(-1.0)) - 2e-6).select("query_id", "user_id", "size", "cell"), "rest")
    visits = pairs.groupBy("query_id").agg(F.count("*").alias("cells"), F.count_if("first").alias("__first")).join(rest.groupBy("query_id").agg(F.count("*").alias("__rest")), "query_id", "left")
    return top(near.unionByName(read(rest)), k), visits.select("query_id", "cells", (F.col("__first") + F.coalesce("__rest", F.lit(0))).alias("visited"))

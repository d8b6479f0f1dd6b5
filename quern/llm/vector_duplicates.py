"""Operator 7: near-duplicate embeddings by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, make a product grid of cells; each vector is stored in one.
A vector visits cells in order of the least distance that a vector stored there can have from it (the multi-sequence
traversal of the two sorted lists of bounds), and stops where that distance exceeds the one that belongs to the wanted
cosine. As the bounds hold for every vector of a cell, the recall is 1, whatever the sample that the codebooks were
fitted on. What is met there is verified in double precision.

Equal vectors of a label are one class, counted, so a vector with very many copies makes no pairs. A cell with many
vectors is cut into blocks, and what visits it into chunks, so that no task gets an unbounded group. Each pair of block
and chunk gives the number of links of each visitor, and for each vector of a group that links join one row, not a row
for each link.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.shared import materialise

#: Vectors that the codebooks are fitted on at most; the index holds every vector.
SAMPLE = 8192
BLOCK, CHUNK = 512, 4096


def codebook_size(n: int) -> int:
    """Centroids for each half: the grid grows with the square root of the vectors."""
    return int(min(256, max(2, round(1.6 * (n / 16) ** 0.25))))


def codebook(half: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids of at most ``k`` clusters by Lloyd's rounds; distinct ones."""
    distinct = np.unique(half, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest(half, centres)[0]
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = half[near == j].mean(axis=0)
    return np.unique(centres, axis=0)


def nearest(half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the squared distances to all."""
    d = ((half[:, None, :] - centres[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d


def cell_bounds(distances: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each row and centroid the least distance to any vector nearer to that centroid than to the others.

    It is the distance to the farthest of the planes halfway between that centroid and another.
    """
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    out = np.zeros_like(distances)
    for j in range(len(centres)):
        out[:, j] = np.maximum(0.0, ((distances[:, j : j + 1] - distances) / (2 * apart[j])).max(axis=1))
    return out


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> list[int]:
    """Cells (i * len(second) + j) in order of first[i] + second[j], as long as that is at most ``limit``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap, out, width = [(x[0] + y[0], 0, 0)], [], len(y)
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > limit:
            break
        out.append(int(a[i]) * width + int(b[j]))
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return out


def _unit(column: pa.Array, size: int) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest that the links (a, b) reach, by passing labels along and jumping."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(classes: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links between classes (cid, label, vec of ``size`` components, n) of one label with a cosine of ``similarity`` or
    more, as rows (a, b, m): with b, that links join a and b; without, that a has m linked vectors in one place."""
    if size == 1:  # a second component of zero leaves the cosine as it is and gives the second half something to hold
        classes, size = classes.withColumn("vec", F.concat("vec", F.array(F.lit(0.0)))), 2
    n = classes.count()
    k, half = codebook_size(n), size // 2
    sample = classes.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) <= F.lit((1 << 20) * SAMPLE / n)).select("vec").limit(2 * SAMPLE).toArrow()
    x = _unit(sample["vec"], size) if sample.num_rows else np.eye(1, size)
    books = (codebook(x[:, :half], k), codebook(x[:, half:], k))
    limit = 2 - 2 * similarity + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column(2), size)
            (i, d1), (j, d2) = nearest(unit[:, :half], books[0]), nearest(unit[:, half:], books[1])
            b1, b2 = cell_bounds(d1, books[0]) ** 2, cell_bounds(d2, books[1]) ** 2
            visits = [multi_sequence(p, q, limit) for p, q in zip(b1, b2, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i * len(books[1]) + j, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=["cid", "label", "vec", "n", "cell", "visits"])

    placed = materialise(classes.select("cid", "label", "vec", "n").mapInArrow(place, "cid binary, label bigint, vec array<double>, n bigint, cell int, visits array<int>"), "cells")
    stored = placed.groupBy("label", "cell").agg(F.count("*").alias("held"))
    visited = placed.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("m"))
    sizes = stored.join(visited, ["label", "cell"]).select("label", "cell", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks"))
    salt = F.xxhash64("cid", F.lit(1))
    held = placed.join(sizes, ["label", "cell"]).select("label", "cell", F.pmod(salt, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("asks"), "cid", "vec", "n")
    asking = placed.select("cid", "label", "vec", "n", F.explode("visits").alias("cell")).join(sizes, ["label", "cell"])
    asking = asking.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(salt, F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("asks"), "cid", "vec", "n")

    def verify(table: pa.Table) -> pa.Table:
        unit, asks, cid, n = _unit(table["vec"], size), table["asks"].to_numpy(), table["cid"].to_pylist(), table["n"].to_numpy()
        number: dict[bytes, int] = {}
        node = np.array([number.setdefault(c, len(number)) for c in cid])
        ask, hold = np.flatnonzero(asks), np.flatnonzero(~asks)
        a, b, m = [], [], np.zeros(len(number), dtype=np.int64)
        for some in range(0, len(ask), 1024):
            p, q = np.nonzero(unit[ask[some : some + 1024]] @ unit[hold].T >= similarity)
            p, q = ask[some : some + 1024][p], hold[q]
            other = node[p] != node[q]
            np.add.at(m, node[p[other]], n[q[other]])
            a.append(node[p[other]])
            b.append(node[q[other]])
        group = joined(np.concatenate([*a, np.zeros(0, dtype=np.int64)]), np.concatenate([*b, np.zeros(0, dtype=np.int64)]), len(number))
        names = list(number)
        has, moved = np.flatnonzero(m), np.flatnonzero(group != np.arange(len(number)))
        return pa.table({"a": pa.array([names[k] for k in [*has, *moved]], pa.binary()), "b": pa.array([*[None] * len(has), *[names[group[k]] for k in moved]], pa.binary()), "m": pa.array([*m[has].tolist(), *[None] * len(moved)], pa.int64())})

    return held.union(asking).groupBy("label", "cell", "block", "chunk").applyInArrow(verify, "a binary, b binary, m bigint")


def vector_classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", similarity: float = 0.98) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are linked where their labels are equal and not null, their lengths are equal and their cosine is
    ``similarity`` or more. A null or empty vector, one of zeros, and one with a null or non-finite component link
    with nothing: 0 links, their own component. Repeated rows are vectors of their own. ``component_id`` is the
    smallest id that links reach (ids that are null are passed over), ``kept`` whether it is the row's own. Vectors of
    one component link where their signs are equal.
    Columns other than the three are not read. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("bigint").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("cid", F.when(good, F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.transform("vec", lambda x: (x + F.lit(0.0)).cast("string")))))))
    classes = materialise(rows.where("cid is not null").groupBy("cid").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("vec_id").alias("least")), "vectors")
    sizes = [r[0] for r in classes.select(F.size("vec")).distinct().orderBy(F.size("vec")).collect()]
    found = vectors.sparkSession.createDataFrame([], "a binary, b binary, m bigint")
    for size in sizes:
        found = found.union(links(classes.where(F.size("vec") == size), size, similarity))
    found = materialise(found, "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("m").alias("m"))
    part = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    known = classes.select("cid", "n", "least").join(counts, "cid", "left").join(part, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    # A table of its own, so that the join with a component of very many vectors can be split.
    smallest = materialise(known.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    known = known.join(smallest, "component").select("cid", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cid").join(known, "cid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("bigint").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

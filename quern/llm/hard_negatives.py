"""Operator 13: hard negatives by a dual-tree search for inner products.

One tree of planes, fitted on a bounded sample, deals anchors and candidates to leaves; a leaf's anchors and its candidates
are a node each, with a centre and a radius that all its members keep. The inner products of two nodes lie in an interval; a pair
of nodes is left out as a whole where the interval holds nothing that an anchor of the first still wants. What is left is
cut into groups of anchors and blocks of candidates; each pair of these is searched in one task, by a tree over either,
from the pair of nodes with the highest possible product down, and pairs of leaves are scored exactly.

Three searches follow each other: positives in each anchor's own leaf, which gives a least score for each anchor; positives
elsewhere above it; negatives between the least and the greatest score that a positive allows. Equal rows of a label are
one class with its smallest ids, so copies are searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import materialise

#: Vectors that the planes are fitted on at most, and leaves of that tree at most; larger leaves are cut into blocks.
SAMPLE, LEAVES = 8192, 256
#: Anchors of a group, candidates of a block, rows of the leaves of the trees within a task.
GROUP, BLOCK, ANCHOR_LEAF, LEAF = 1024, 4096, 16, 64
#: Below any score. Squared lengths are below ``WITHIN``, so that every score is a long.
NONE, WITHIN = -(1 << 62), float(1 << 62)


# ---- within a task -------------------------------------------------------------------------------------------------


@dataclass
class Node:
    """Rows of a tree: what bounds their inner products with others, and the two halves unless it is a leaf."""

    rows: np.ndarray
    centre: np.ndarray
    norm: float
    radius: float
    low: np.ndarray
    high: np.ndarray
    halves: tuple[Node, Node] | None


def tree(x: np.ndarray, size: int, rows: np.ndarray | None = None) -> Node:
    """A tree over rows of ``x``, down to ``size`` rows: each row goes to the nearer of two that are far apart, or to its half
    of the line between these, where one of them would get hardly any."""
    rows = np.arange(len(x)) if rows is None else rows
    own = x[rows].astype(float)
    centre, low, high = own.mean(axis=0), own.min(axis=0), own.max(axis=0)
    halves = None
    if len(rows) > size and (high > low).any():
        one = own[np.argmax(((own - centre) ** 2).sum(axis=1))]
        other = own[np.argmax(((own - one) ** 2).sum(axis=1))]
        along = (own - (one + other) / 2) @ (other - one)
        order = np.argsort(along, kind="stable")
        cut = int((along <= 0).sum())
        cut = cut if len(rows) // 16 < cut < len(rows) - len(rows) // 16 else len(rows) // 2
        halves = tree(x, size, rows[order[:cut]]), tree(x, size, rows[order[cut:]])
    return Node(rows, centre, float(np.linalg.norm(centre)), float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())), low, high, halves)


def interval(a: Node, b: Node) -> tuple[float, float]:
    """Bounds of the inner products of two nodes' rows: by centres and radii, and by their boxes."""
    middle, spread = float(a.centre @ b.centre), a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    ends = np.stack([a.low * b.low, a.low * b.high, a.high * b.low, a.high * b.high])
    slack = 1e-9 * ((a.norm + a.radius) * (b.norm + b.radius) + 1)
    return max(middle - spread, float(ends.min(axis=0).sum())) - slack, min(middle + spread, float(ends.max(axis=0).sum())) + slack


class Search:
    """The best ``k`` candidates of each wish: among those of the anchor's label (``same``) or of others, with scores from
    ``low`` to ``high``; greater scores first, then smaller first ids."""

    def __init__(self, anchors: np.ndarray, labels: np.ndarray, wishes: tuple[np.ndarray, np.ndarray, np.ndarray], candidates: np.ndarray, their_labels: np.ndarray, first_ids: np.ndarray, k: int, same: bool):
        self.owner, self.low, self.high = wishes
        self.labels, self.theirs, self.k, self.same = labels, their_labels, k, same
        order = np.argsort(-first_ids, kind="stable")  # of equal scores, the smaller id has the greater rank
        self.rank, self.by_rank, self.n = np.argsort(order), order, len(candidates)
        longest = [float(np.sqrt((v.astype(float) ** 2).sum(axis=1).max(initial=0))) for v in (anchors, candidates)]
        # In doubles sums below 2 ** 52 are exact; scores with ranks must fit 64 bits, else whole numbers of any size are used.
        most = longest[0] * longest[1]
        self.kind = np.int64 if most < 2**46 else object
        self.a, self.c = (anchors.astype(float), candidates.astype(float)) if most < 2**46 else (anchors.astype(object), candidates.astype(object))
        self.none = NONE if self.kind is np.int64 else NONE * max(1, self.n)
        self.best = np.full((len(self.owner), k), self.none, dtype=self.kind)
        self.floor = self.low.astype(self.kind)
        self.scored = 0
        self.order = np.argsort(self.owner, kind="stable")
        self.starts = np.searchsorted(self.owner[self.order], np.arange(len(anchors) + 1))
        if len(self.owner) and self.n:
            self._run(tree(anchors, ANCHOR_LEAF), tree(candidates, LEAF))

    def _wishes(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.order[self.starts[r] : self.starts[r + 1]] for r in rows])

    def _run(self, a: Node, c: Node) -> None:
        wishes: dict[int, np.ndarray] = {}
        heap, turn = [(-interval(a, c)[1], 0, a, c, interval(a, c)[0])], 0
        while heap:
            top, _, a, c, bottom = heapq.heappop(heap)
            w = wishes.get(id(a))
            if w is None:
                w = wishes[id(a)] = self._wishes(a.rows)
            if not len(w) or -top < self.floor[w].min() or bottom > self.high[w].max():
                continue
            if a.halves is None and c.halves is None:
                self._score(a.rows, c.rows, w)
                continue
            wide = c.halves is not None and (a.halves is None or len(c.rows) >= len(a.rows))
            for half in c.halves if wide else a.halves:
                pair = (a, half) if wide else (half, c)
                least, most = interval(*pair)
                turn += 1
                heapq.heappush(heap, (-most, turn, *pair, least))

    def _score(self, rows: np.ndarray, others: np.ndarray, w: np.ndarray) -> None:
        self.scored += len(rows) * len(others)
        scores = self.a[rows] @ self.c[others].T
        scores = np.rint(scores).astype(np.int64) if self.kind is np.int64 else scores
        fits = (self.labels[rows][:, None] == self.theirs[others][None]) == self.same
        order = np.argsort(rows)
        at = order[np.searchsorted(rows[order], self.owner[w])]
        mine, fits = scores[at], fits[at]
        keys = np.where(fits & (mine >= self.floor[w][:, None]) & (mine <= self.high[w][:, None]), mine * self.n + self.rank[others][None], self.none)
        both = np.sort(np.concatenate([self.best[w], keys], axis=1), axis=1)[:, -self.k :]
        self.best[w] = both
        least = both[:, 0]
        self.floor[w] = np.maximum(self.floor[w], np.where(least > self.none, least // self.n, self.low[w]))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Wish, candidate and score of what was found."""
        wish, slot = np.nonzero(self.best > self.none)
        keys = self.best[wish, slot]
        return wish, self.by_rank[(keys % self.n).astype(np.int64)], (keys // self.n).astype(np.int64)


# ---- over all rows -------------------------------------------------------------------------------------------------


@dataclass
class Planes:
    """A tree of planes as arrays: node k has the halves 2 k + 1 and 2 k + 2; leaves are the nodes of the last level."""

    normals: np.ndarray
    offsets: np.ndarray
    depth: int
    centres: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, depth: int) -> Planes:
        """Each node's plane lies at the median along the line between two of its far rows."""
        normals, offsets = np.zeros((2**depth - 1, x.shape[1])), np.zeros(2**depth - 1)
        node = np.zeros(len(x), dtype=np.int64)
        for k in range(2**depth - 1):
            own = x[node == k]
            if len(own):
                far = own[np.argmax(((own - own[0]) ** 2).sum(axis=1))]
                other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
                normals[k] = other - far
                offsets[k] = np.median(own @ normals[k])
                node[node == k] = 2 * k + 1 + (own @ normals[k] > offsets[k])
        tree_ = cls(normals, offsets, depth, np.zeros((2**depth, x.shape[1])))
        leaf = tree_.leaves(x)
        for k in range(2**depth):
            if (leaf == k).any():
                tree_.centres[k] = x[leaf == k].mean(axis=0)
        return tree_

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((x * self.normals[node]).sum(axis=1) > self.offsets[node])
        return node - (2**self.depth - 1)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Lists of longs as rows; with ``width``, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths[0]) if width is None else width
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def placed(classes: DataFrame, anchors: DataFrame) -> tuple[DataFrame, Planes]:
    """``classes`` with size, leaf, distance from the leaf's centre, and whether an anchor is among them."""
    sizes = classes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    n, width = sizes.n, max(1, sizes.width or 0)
    sample = classes.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) <= F.lit((1 << 20) * SAMPLE / max(1, n))).select("vec").limit(2 * SAMPLE).toArrow()
    x = _matrix(sample["vec"], width).astype(float) if sample.num_rows else np.zeros((1, width))
    planes = Planes.fit(x, min(LEAVES, max(1, n // BLOCK)).bit_length() - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), width).astype(float)
            leaf = planes.leaves(x)
            away = np.sqrt(((x - planes.centres[leaf]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32()), pa.array(away)], names=["cid", "label", "vec", "ids", "asks", "leaf", "away"])

    asking = classes.join(anchors.select("cid").distinct().withColumn("asks", F.lit(True)), "cid", "left").select("cid", "label", "vec", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    return materialise(asking.mapInArrow(place, "cid binary, label bigint, vec array<bigint>, ids array<bigint>, asks boolean, leaf int, away double"), "placed"), planes


def searched(anchors: DataFrame, candidates: DataFrame, pairs: DataFrame, group: Column, k: int, same: bool) -> DataFrame:
    """The best ``k`` of each wish over the pairs (aleaf, cleaf) of leaves: cid, wish, score, id, of (the candidate's cid).

    ``anchors`` have an array ``wishes`` of (wish, low, high). Only rows of equal ``group`` meet. Groups of anchors and
    blocks of candidates are of bounded size.
    """
    a, c = anchors.withColumn("g", group), candidates.withColumn("g", group)
    many = lambda df, most, leaf, name: df.groupBy("g", F.col("leaf").alias(leaf)).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    meet = F.broadcast(pairs).join(many(a, GROUP, "aleaf", "groups"), "aleaf").join(many(c, BLOCK, "cleaf", "blocks"), ["g", "cleaf"])
    salt = lambda parts: F.pmod(F.xxhash64("cid", F.lit(5)), F.col(parts)).cast("int")
    upto = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = a.withColumnRenamed("leaf", "aleaf").join(meet, ["g", "aleaf"]).select("g", "aleaf", "cleaf", salt("groups").alias("agroup"), upto("blocks").alias("cblock"), "cid", "label", "vec", "wishes")
    right = c.withColumnRenamed("leaf", "cleaf").join(meet, ["g", "cleaf"]).select("g", "aleaf", "cleaf", upto("groups").alias("agroup"), salt("blocks").alias("cblock"), "cid", "label", "vec", "ids")
    schema = pa.schema([("cid", pa.binary()), ("wish", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("of", pa.binary())])

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return schema.empty_table()
        lists = asking["wishes"].to_pylist()
        owner = np.repeat(np.arange(len(lists)), [len(w) for w in lists])
        flat = [w for ws in lists for w in ws]
        bounds = (np.array([w[name] for w in flat], dtype=np.int64) for name in ("low", "high"))
        ids = held["ids"].to_pylist()
        s = Search(_matrix(asking["vec"]), asking["label"].to_numpy(), (owner, *bounds), _matrix(held["vec"]), held["label"].to_numpy(), np.array([i[0] for i in ids]), k, same)
        names, theirs, rows = asking["cid"].to_pylist(), held["cid"].to_pylist(), []
        for w, at, score in zip(*(v.tolist() for v in s.found()), strict=True):
            rows += [(names[owner[w]], flat[w]["wish"], score, i, theirs[at]) for i in ids[at][:k]]
        return pa.table([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()

    keys = ["g", "aleaf", "cleaf", "agroup", "cblock"]
    right = right.toDF(*right.columns)  # both sides may come from one table; these are columns of their own
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "cid binary, wish bigint, score bigint, id bigint, of binary")


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of ``found`` for each key, as an array in order."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "of"))).where(F.col("rank") <= k)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", "id", "of"))), lambda x: x.dropFields("rank")).alias("best"))


def node_pairs(planes: Planes, reach: dict[str, dict[int, float]], wanted: dict[int, tuple[float, float]]) -> list[tuple[int, int]]:
    """Pairs of leaves whose inner products can lie within what the first one's anchors want."""
    norm, out = np.linalg.norm(planes.centres, axis=1), []
    for a, (low, high) in wanted.items():
        for c, r in reach["held"].items():
            s, middle = reach["asking"][a], float(planes.centres[a] @ planes.centres[c])
            spread = norm[a] * r + norm[c] * s + r * s
            spread += 1e-9 * (abs(middle) + spread + 1)
            if middle + spread >= low and middle - spread <= high:
                out.append((a, c))
    return out


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor of ``rows`` (id, label, vec of longs) and each of its positives, its hard negatives.

    An anchor's positives are its first ``positives`` other rows of its label by inner product, ties by smaller id; hard
    negatives of a positive are the first ``negatives`` rows of other labels whose product is from ``low`` to ``high``
    hundredths of the positive's. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score; a
    positive without any has no row.

    Rows with a null id, label, vector or component, or whose squared length is not below 2 ** 62, take no part. Rows of equal
    id, label and vector are one; other rows of an equal id are rows of their own. Vectors meet those of their length
    only. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull()), F.lit(False))
    short = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x) < F.lit(WITHIN)
    rows = rows.where(good).where(short).withColumn("anchor", F.coalesce(anchor, F.lit(False))).select("id", "label", "vec", "anchor")
    rows = rows.withColumn("cid", F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.transform("vec", lambda x: x.cast("string"))))))
    first = F.row_number().over(Window.partitionBy("cid").orderBy("id"))
    # Copies of an id are dropped before the smallest ids of a class are taken, both within tasks before rows are dealt.
    ids = rows.select("cid", "id").distinct().withColumn("k", first).where(F.col("k") <= max(positives + 1, negatives))
    classes = rows.groupBy("cid").agg(F.first("label").alias("label"), F.first("vec").alias("vec")).join(ids.groupBy("cid").agg(F.sort_array(F.collect_list("id")).alias("ids")), "cid")
    asking = materialise(rows.where("anchor").select(F.col("id").alias("anchor_id"), "cid").distinct(), "anchors")
    table, planes = placed(classes, asking)
    candidates, anchors = table.select("cid", "label", "vec", "ids", "leaf"), table.where("asks").select("cid", "label", "vec", "leaf")
    reach = {name: {r.leaf: r.away for r in df.groupBy("leaf").agg(F.max("away").alias("away")).collect()} for name, df in (("held", table), ("asking", table.where("asks")))}
    pairs = lambda found: spark.createDataFrame(found, "aleaf int, cleaf int")
    wish = lambda w, least, most: F.struct(w.cast("bigint").alias("wish"), least.cast("bigint").alias("low"), most.cast("bigint").alias("high"))
    label = F.struct("label", F.size("vec").alias("size"))

    # Positives: those of the own leaf, then those of other leaves that may be better than the last of these.
    k = positives + 1  # the anchor itself may be among them
    every = anchors.withColumn("wishes", F.array(wish(F.lit(0), F.lit(NONE + 1), F.lit(-NONE))))
    near = materialise(searched(every, candidates, pairs([(x, x) for x in reach["asking"]]), label, k, True), "near")
    known = _best(near, ["cid"], k).select("cid", F.when(F.size("best") == k, F.element_at("best", -1)["score"]).alias("least"))
    bounded = materialise(anchors.join(known, "cid", "left").withColumn("least", F.coalesce("least", F.lit(NONE + 1))), "bounded")
    wanted = {r.leaf: (float(r.least), float(-NONE)) for r in bounded.groupBy("leaf").agg(F.min("least").alias("least")).collect()}
    others = [p for p in node_pairs(planes, reach, wanted) if p[0] != p[1]]
    far = searched(bounded.withColumn("wishes", F.array(wish(F.lit(0), F.col("least"), F.lit(-NONE)))).drop("least"), candidates, pairs(others), label, k, True) if others else near.limit(0)
    best = materialise(_best(near.union(far), ["cid"], k), "positives")

    # Negatives: one wish for each distinct score of a class's positives.
    asked = F.transform(F.array_distinct(F.transform("best", lambda x: x["score"])), lambda s: wish(s, -hundredths(-s, low), hundredths(s, high)))
    wishing = materialise(anchors.join(best.withColumn("wishes", F.filter(asked, lambda w: w["low"] <= w["high"])).select("cid", "wishes"), "cid").where(F.size("wishes") > 0), "wishes")
    wanted = {r.leaf: (float(r.low), float(r.high)) for r in wishing.groupBy("leaf").agg(F.min(F.array_min("wishes.low")).alias("low"), F.max(F.array_max("wishes.high")).alias("high")).collect()}
    some = searched(wishing, candidates, pairs(node_pairs(planes, reach, wanted)), F.struct(F.size("vec").alias("size")), negatives, False)
    hard = _best(some, ["cid", "wish"], negatives)

    # Per anchor: its positives without itself, and for each the negatives of its score.
    itself = lambda x: (x["id"] == F.col("anchor_id")) & (x["of"] == F.col("cid"))
    mine = asking.join(best, "cid").select("cid", "anchor_id", F.explode(F.slice(F.filter("best", lambda x: ~itself(x)), 1, positives)).alias("p"))
    mine = mine.select("cid", "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("wish"))
    out = mine.join(hard, ["cid", "wish"]).select("anchor_id", "positive_id", "wish", F.posexplode("best").alias("k", "n"))
    return out.select("anchor_id", "positive_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), F.col("wish").alias("positive_score"), F.col("n.score").alias("negative_score"))


def hundredths(score: Column, share: int) -> Column:
    """``share`` hundredths of a score, rounded down, within what scores can be."""
    whole = F.floor(score.cast("decimal(20,0)") * F.lit(share).cast("decimal(6,0)") / F.lit(100).cast("decimal(3,0)"))
    return F.greatest(F.lit(NONE + 1), F.least(F.lit(-NONE), whole)).cast("bigint")


def negative_table(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``hard_negatives`` of ``vectors`` as the query's contract has it: components floor(256 x), labels of ids divisible by
    7 moved on by one (modulo 10), anchors the ids divisible by 100. A non-finite component counts as a null one."""
    vec = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.floor(x * 256)))
    label = F.col(label_col).cast("bigint")
    rows = vectors.select(F.col(id_col).alias("id"), F.when(F.coalesce(F.col(id_col) % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label).alias("label"), vec.alias("vec"))
    return hard_negatives(rows, F.col("id") % 100 == 0)

"""Operator 2: quality classifier by Naive Bayes support vectors.

A document is the set of its features, hashed: character n-grams (case and punctuation kept) and runs of shapes, for
which capitals, other letters and digits are one sign each and repeated signs are one, and how much of a text repeats
the token before. Each indicator is scaled by the log ratio of its smoothed counts in the two
classes, vectors are brought to unit length, and a linear model with hinge loss is fitted by dual coordinate
descent. Its weights are interpolated with their mean magnitude, which all features have in Naive Bayes, and the margin
is turned into a probability by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quern.llm.shared import fold, grams, mix

DIM = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled documents that the model is fitted on at most, taken in order of a hash of their id.
TRAIN_DOCS = 8000
ALPHA, COST, EPOCHS, BLEND = 1.0, 1.0, 12, 0.25
#: Code points that are read at a time, and classes of shape in a run.
BLOCK, SHAPE_RUN = 1 << 18, 6
_CASE = 1 << 16  # code points above count as letters


@cache
def _shapes() -> np.ndarray:
    """For each code point its class: capitals, other letters and digits are one each, every other sign its own."""
    one = lambda c: ord("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c)
    return np.array([one(chr(k)) for k in range(_CASE)], dtype=np.uint64)


class Features:
    """The features of texts: character n-grams and runs of shapes, hashed to ``DIM`` numbers."""

    def __init__(self):
        self.seen = np.zeros(DIM, dtype=bool)

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct features of a whole text, white space taken as one space; none without a word."""
        plain = " ".join(text.split())
        if not plain:
            return np.zeros(0, dtype=np.int64)
        codes = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        for start in range(0, len(codes), BLOCK):
            some = codes[start : start + BLOCK + max(ORDERS) - 1]
            packed = some
            for n in ORDERS:
                if n > 1:
                    packed = packed[:-1] << np.uint64(21) | some[n - 1 :]
                self.seen[(mix(packed * np.uint64(2 * n + 1)) >> np.uint64(48)).astype(np.int64)] = True
            kinds = _shapes()[np.minimum(some, np.uint64(_CASE - 1)).astype(np.int64)]
            kinds = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])]
            self.seen[(grams(kinds, SHAPE_RUN) >> np.uint64(48)).astype(np.int64)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


@dataclass
class QualityModel:
    """``value`` is weight times ratio, ``square`` the ratio squared; the margin is sum(value) / sqrt(sum(square)) + bias."""

    value: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        length = float(np.sqrt(self.square[features].sum())) if len(features) else 0.0
        margin = (float(self.value[features].sum()) / length if length else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    good, bad = np.full(DIM, ALPHA), np.full(DIM, ALPHA)
    for x, y in zip(rows, labels, strict=True):
        (good if y > 0 else bad)[x] += 1
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model: each step solves one dual variable exactly, within [0, cost]."""
    values = []
    for x in rows:
        v = ratios[x]
        values.append(v / max(1e-12, float(np.sqrt((v * v).sum()))))
    weight = {1: len(labels) / max(1, 2 * int((labels > 0).sum())), -1: len(labels) / max(1, 2 * int((labels < 0).sum()))}
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        most = 0.0
        for i in rng.permutation(len(rows)):
            x, v, y = rows[i], values[i], labels[i]
            gradient = y * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1), 0.0), COST * weight[int(y)])
            step = (new - alpha[i]) * y
            if step:
                alpha[i] = new
                w[x] += step * v
                bias += step
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def _logistic(margins: np.ndarray, targets: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margin to probability, by Newton steps on the smoothed likelihood."""
    n1, n0 = targets.sum(), (1 - targets).sum()
    goal = np.where(targets == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = np.array([((p - goal) * margins).sum() + 1e-3 * a, (p - goal).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * margins * margins).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> QualityModel:
    """``labels`` are 1 and 0. Without rows every score is 0.5, with one class it is that class's smoothed share."""
    signs = np.where(labels > 0, 1, -1)
    if not len(rows) or len(set(signs.tolist())) < 2:
        share = (float((signs > 0).sum()) + 1) / (len(rows) + 2)
        return QualityModel(np.zeros(DIM), np.zeros(DIM), 0.0, 0.0, float(np.log(share / (1 - share))))
    ratios = log_count_ratios(rows, signs)
    w, bias = dual_descent(rows, signs, ratios)
    w = BLEND * np.abs(w).mean() + (1 - BLEND) * w
    model = QualityModel(w * ratios, ratios * ratios, bias, 1.0, 0.0)
    margins = np.array([np.log(max(s := model.score(x), 1e-18) / max(1 - s, 1e-18)) for x in rows])
    model.slope, model.offset = _logistic(margins, (signs > 0).astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 1, folds: int = 3, most: int = TRAIN_DOCS) -> QualityModel:
    """Fit on at most ``most`` labelled documents outside the held-out fold.

    Labels are taken in order of a hash of their id; that bounded table is broadcast to the scan of the documents.
    An id that is given several times teaches by one of its texts, that of the smallest hash, so only a text a task
    of each chosen id is shuffled, and the driver gets the features of at most ``most`` documents. A document with
    several labels counts with the largest; null ids and labels teach nothing.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").where(fold(F.col("id"), folds) != held_out)
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)

    @arrow_udf("binary")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = Features()
        for batch in batches:
            yield pa.array([table.of(t or "").astype("<u2").tobytes() for t in batch.to_pylist()], pa.binary())

    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    single = joined.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first")).select("id", "label", "first.text")
    single = single.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # else a few tasks find all features
    rows = single.select("id", "label", features("text").alias("x")).collect()
    rows.sort(key=lambda r: r.id)
    return fit([np.frombuffer(r.x, dtype="<u2").astype(np.int64) for r in rows], np.array([r.label for r in rows], dtype=np.int64))


def with_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with the score of every whole text; a null text scores as an empty one. Nothing is shuffled."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, model = Features(), shipped.value
        for batch in batches:
            yield pa.array([model.score(table.of(t or "")) for t in batch.to_pylist()], pa.float64())

    return docs.withColumn(into, run(F.col(text_col)))


def quality_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train outside fold 1 of 3, score every document: doc_id, held_out, score, predicted.

    Repeated rows give a row each; a null id is not held out. Other columns, whatever their names, are not read. A text
    is read whole, however long, in blocks; a null or empty one has no feature and gets the score of the bias alone. A
    score of exactly 0.5 counts as 1. An empty table gives an empty result; without labels every score is 0.5.
    """
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(F.col(id_col), 3) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return with_quality(rows, model, into="score").select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Operator 1: benchmark decontamination by a BM25 inverted index with block-max WAND.

The index holds the test items. Its terms are runs of two words, its weights BM25 divided by what the item scores
against itself, so that a score says which part of an item a passage has. Postings are in order of item, in blocks
that keep their largest weight. Every passage of every document (overlapping windows of words) is a query: block-max
WAND returns all items above the threshold, and each is then verified by itself: enough runs of the question's words
must stand in the document, and near them enough runs of the answer's own words, however short the answer is. A long
item is found by its parts and verified as a whole. An item of one word has that word as its term.

A passage whose weights cannot add up to the threshold, whatever items they belong to, is passed over by the first
WAND bound, taken for all windows of a document at once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quern.llm.shared import WordHashes, distinct, free_name, grams, text_slices

# Production parameters.
WINDOW, STRIDE = 128, 64  # words of a passage, and between the starts of two; an item part has at most STRIDE words
THRESHOLD = 0.4  # of an item's own score
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.4, 0.4
RUN = 5  # words in a run of the verification at most
NEAR = 64  # words, beside an item's own length, between a run of its question and one of its answer
BLOCK = 16  # postings in a block
K1, B = 1.2, 0.75
#: Items whose words go to every task at once; more items are taken in as many slices, each a pass over the documents.
SLICE_ITEMS, SLICE_CHARS = 20_000, 32_000_000
_FILTER_BITS = 20


@dataclass
class Entry:
    """An item, or a part of a long one, by which it is found."""

    item: int
    words: np.ndarray
    whole: Item


@dataclass
class Item:
    """The runs of the words of an item's question and of its answer, of at most ``RUN`` words each."""

    question: np.ndarray
    question_run: int
    answer: np.ndarray
    answer_run: int
    near: int  # words between a run of the question and one of the answer at most

    @classmethod
    def of(cls, words: np.ndarray, answer_from: int) -> Item:
        question, answer = words[:answer_from], words[answer_from:]
        if not len(question):
            question = answer
        runs = min(RUN, len(question)), min(RUN, len(answer))
        return cls(distinct(grams(question, RUN)), runs[0], distinct(grams(answer, RUN)), runs[1], len(words) + NEAR)

    def overlaps(self, runs: Callable[[int], np.ndarray]) -> tuple[float, float]:
        """Shares of the question's runs that a document has, and of the answer's that it has near one of those.

        ``runs`` gives the document's runs of a number of words, in order.
        """
        doc = runs(self.question_run)
        at = np.flatnonzero(np.isin(doc, self.question))
        if not len(at):
            return 0.0, 0.0
        mine = runs(self.answer_run)
        places = np.flatnonzero(np.isin(mine, self.answer))
        k = np.searchsorted(at, places)
        apart = np.minimum(np.abs(places - at[np.maximum(k - 1, 0)]), np.abs(places - at[np.minimum(k, len(at) - 1)]))
        return len(np.unique(doc[at])) / len(self.question), len(np.unique(mine[places[apart <= self.near]])) / len(self.answer)


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def entries_of(items: list[tuple[int, str | None]], hashes: WordHashes) -> list[Entry]:
    """Index entries: the last sentence with a word is an item's answer, what precedes it the question; of a single
    sentence the last third is the answer. A wordless item has none.

    An item of more than ``STRIDE`` words is cut into parts of about equal size, each an entry of its own.
    """
    out = []
    for item, text in items:
        parts = [h for s in _SENTENCE.split(text or "") if len(h := hashes.of(s))]
        if not parts:
            continue
        words = np.concatenate(parts)
        whole = Item.of(words, len(words) - len(parts[-1]) if len(parts) > 1 else len(words) * 2 // 3)
        bounds = np.linspace(0, len(words), -(-len(words) // STRIDE) + 1).astype(int)
        out += [Entry(item, words[a:b], whole) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


class Statistics:
    """Counts over all entries of all slices: how many, their words, and in how many each term stands (by hashed term)."""

    def __init__(self, bits: int = 20):
        self.entries, self.words, self.frequency = 0, 0, np.zeros(1 << bits, dtype=np.int32)

    def place(self, terms: np.ndarray) -> np.ndarray:
        return (terms % np.uint64(len(self.frequency))).astype(np.int64)

    def add(self, entries: list[Entry]) -> None:
        for e in entries:
            self.entries += 1
            self.words += len(e.words)
            np.add.at(self.frequency, self.place(np.unique(grams(e.words, 2))), 1)


class BlockMaxIndex:
    """Inverted index with block maxima; weights are shares of an entry's own BM25 score."""

    def __init__(self, entries: list[Entry], statistics: Statistics):
        self.entries = entries
        terms = [np.unique(grams(e.words, 2), return_counts=True) for e in entries]
        n, mean = max(1, statistics.entries), statistics.words / max(1, statistics.entries)
        postings: dict[int, list[tuple[int, float]]] = {}
        for k, (t, tf) in enumerate(terms):
            df = np.maximum(1, statistics.frequency[statistics.place(t)]).astype(float)
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
            norm = K1 * (1 - B + B * len(entries[k].words) / mean)
            weight = np.maximum(idf, 1e-6) * tf * (K1 + 1) / (tf + norm)
            weight /= weight.sum()
            for x, w in zip(t.tolist(), weight.tolist(), strict=True):
                postings.setdefault(x, []).append((k, w))
        self.terms = np.array(sorted(postings), dtype=np.uint64)
        self.docs = [np.array([k for k, _ in postings[x]], dtype=np.int64) for x in self.terms.tolist()]
        self.weights = [np.array([w for _, w in postings[x]]) for x in self.terms.tolist()]
        self.upper = np.array([w.max() for w in self.weights])
        starts = [np.arange(0, len(w), BLOCK) for w in self.weights]
        self.block_max = [np.maximum.reduceat(w, s) for w, s in zip(self.weights, starts, strict=True)]
        self.block_last = [d[np.minimum(s + BLOCK, len(d)) - 1] for d, s in zip(self.docs, starts, strict=True)]
        self.single = any(len(e.words) == 1 for e in entries)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[(self.terms & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def hits(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``pairs`` whose term the index has, and the numbers of those terms."""
        at = np.flatnonzero(self.filter[(pairs & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        if not len(at) or not len(self.terms):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.terms, pairs[at]), len(self.terms) - 1)
        known = self.terms[k] == pairs[at]
        return at[known], k[known]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: every entry whose score against the distinct ``terms`` reaches the threshold."""
        out: list[tuple[int, float]] = []
        slack = threshold - 1e-9
        cursors = [[int(self.docs[t][0]), t, 0] for t in terms]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(cursors):
                bound += self.upper[t]
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                return out
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            block_bound, next_doc = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 62
            for _, t, _ in cursors[: pivot + 1]:
                b = int(np.searchsorted(self.block_last[t], target))
                if b < len(self.block_last[t]):
                    block_bound += self.block_max[t][b]
                    next_doc = min(next_doc, int(self.block_last[t][b]) + 1)
            if block_bound < slack:  # no entry before the end of the nearest block can reach the threshold
                self._advance(cursors, pivot, max(next_doc, target + 1))
            elif cursors[0][0] == target:
                score = sum(self.weights[t][p] for d, t, p in cursors[: pivot + 1] if d == target)
                if score >= slack:
                    out.append((target, float(score)))
                self._advance(cursors, pivot, target + 1)
            else:
                self._advance(cursors, pivot, target)
        return out

    def _advance(self, cursors: list[list[int]], pivot: int, target: int) -> None:
        for c in cursors[: pivot + 1]:
            if c[0] < target:
                p = c[2] + int(np.searchsorted(self.docs[c[1]][c[2] :], target))
                c[0], c[2] = (int(self.docs[c[1]][p]), p) if p < len(self.docs[c[1]]) else (-1, p)
        cursors[:] = [c for c in cursors if c[0] >= 0]

    def passages(self, words: np.ndarray) -> Iterator[list[int]]:
        """Distinct known terms of each passage whose weights could reach the threshold."""
        at, terms = self.hits(grams(words, 2)) if len(words) > 1 else (np.zeros(0, dtype=np.int64),) * 2
        if self.single:
            alone, own = self.hits(grams(words, 1))
            at, terms = np.concatenate([at, alone]), np.concatenate([terms, own])
            order = np.argsort(at, kind="stable")
            at, terms = at[order], terms[order]
        if not len(at) or self.upper[terms].sum() < THRESHOLD - 1e-9:
            return
        reach = np.concatenate([[0.0], np.cumsum(self.upper[terms])])
        starts = np.arange(0, max(1, len(words) - WINDOW + STRIDE), STRIDE)
        low, high = np.searchsorted(at, starts), np.searchsorted(at, starts + WINDOW - (0 if self.single else 1))
        for i in np.flatnonzero(reach[high] - reach[low] >= THRESHOLD - 1e-9):
            yield np.unique(terms[low[i] : high[i]]).tolist()

    def leaks(self, words: np.ndarray) -> list[tuple[int, float, float, float]]:
        """(item, best score, question overlap, answer overlap) of the verified items of a document's words.

        The score is that of the item's best part in the best passage. Of items that are given twice under one id with
        different texts the one of the best score is told.
        """
        best: dict[int, tuple[float, Entry]] = {}
        for terms in self.passages(words):
            for k, score in self.search(terms, THRESHOLD):
                whole = self.entries[k].whole
                if score > best.get(id(whole), (0.0,))[0]:
                    best[id(whole)] = (score, self.entries[k])
        runs: dict[int, np.ndarray] = {}

        def of(n: int) -> np.ndarray:
            if n not in runs:
                runs[n] = grams(words, n)
            return runs[n]

        out: dict[int, tuple[int, float, float, float]] = {}
        for score, entry in best.values():
            question, answer = entry.whole.overlaps(of)
            if question >= QUESTION_OVERLAP and answer >= ANSWER_OVERLAP and (score, question, answer) > out.get(entry.item, (0, 0.0))[1:]:
                out[entry.item] = (entry.item, score, question, answer)
        return sorted(out.values())


def _slices(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in slices of a bounded size, in order of id."""
    part: list[tuple[int, str]] = []
    chars = 0
    for r in items.toLocalIterator():
        if part and (len(part) >= SLICE_ITEMS or chars + len(r.text) > SLICE_CHARS):
            yield part
            part, chars = [], 0
        part.append((r.item, r.text))
        chars += len(r.text)
    if part:
        yield part


_LEAKS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


@lru_cache(maxsize=4)
def _built(name: str, shipped: Shipped) -> BlockMaxIndex:
    return BlockMaxIndex(entries_of(shipped.items.value, WordHashes()), shipped.counts.value)


class Shipped:
    """A broadcast slice of items and the counts of all, equal to any other: a worker keeps indexes by their name."""

    def __init__(self, items, counts):
        self.items, self.counts = items, counts

    def __eq__(self, other) -> bool:
        return isinstance(other, Shipped)

    def __hash__(self) -> int:
        return 0


def _finder(items, counts):
    """The function from texts to the leaks of a broadcast slice of items; a worker builds the index once."""
    name, shipped = uuid.uuid4().hex, Shipped(items, counts)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    @arrow_udf(_LEAKS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, index = WordHashes(), _built(name, shipped)
        for batch in batches:
            found = [index.leaks(words) if len(words) else [] for texts in text_slices(batch) for words in hashes.many(texts)]
            yield pa.array([[dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), x, strict=True)) for x in xs] for xs in found], kind)

    return run


def with_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", into: str = "leaks") -> DataFrame:
    """``docs`` with an array of the verified items that each whole text holds: item_id, score and both overlaps.

    A column ``into`` of ``docs`` is replaced, all others stay, whatever their names. A null or empty
    text, and an empty table of items, give an empty array. Items with a null id or text are left out; items with equal texts are each
    reported. Documents are not shuffled and no other column is read. The
    items, in slices of at most ``SLICE_ITEMS`` rows and ``SLICE_CHARS`` characters, go to every task.
    """
    bench = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").distinct().orderBy("item", "text")
    spark = docs.sparkSession
    out, columns = docs, []
    statistics, hashes = Statistics(), WordHashes()
    for part in _slices(bench):
        statistics.add(entries_of(part, hashes))
    counts = spark.sparkContext.broadcast(statistics)
    for number, part in enumerate(_slices(bench)):
        shipped = spark.sparkContext.broadcast(part)

        columns.append(free_name(out.columns, f"__leaks_{number}"))
        out = out.withColumn(columns[-1], _finder(shipped, counts)(F.col(text_col)))
    if not columns:
        return docs.withColumn(into, F.array().cast(_LEAKS))
    return out.withColumn(into, F.concat(*columns)).drop(*columns)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document and verified item: doc_id, item_id, score, question_overlap, answer_overlap.

    Repeated documents give their rows each, a null doc_id too; clean ones give none. Whole texts are searched, however
    long, in windows. Items whose scores tie are all given; other columns are not read.
    """
    found = with_leaks(docs.select(F.col(id_col).alias("doc_id"), F.col("text")), items)
    return found.where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")

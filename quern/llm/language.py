"""Operator 3: language identification, word first, with back-off to character n-grams.

A word that training saw is scored by its log frequency in each language. A word it didn't see falls back to
its character n-grams of the longest order of which any is known, then to shorter ones. A document's scores are
the sums over its words; its language is the best, its score the share of words that favour that language.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quern.llm.shared import fold

LETTERS = regex.compile(r"\p{L}+")
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"

#: Bound of the model: labelled documents read for each language. All their words and n-grams are kept.
TRAIN_DOCS = 1500


def grams_of(word: str, n: int) -> list[str]:
    """The ``n``-grams of a word with its ends marked; the marks by themselves tell nothing of it."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Table:
    """Log frequencies of texts in each language: rows of one matrix, which takes little room beside the texts."""

    __slots__ = ("at", "rows")

    def __init__(self, at: dict[str, int], rows: np.ndarray):
        self.at, self.rows = at, rows

    def __getitem__(self, text: str) -> np.ndarray:
        return self.rows[self.at[text]]

    def __len__(self) -> int:
        return len(self.at)


@dataclass
class LanguageModel:
    languages: list[str]
    words: Table
    grams: dict[int, Table]
    #: The language of most labelled documents, for texts of which nothing is known.
    usual: str = UNKNOWN

    def vector(self, word: str) -> np.ndarray | None:
        """Log frequencies of a word, or of its longest known n-grams; None if nothing of it is known."""
        if (k := self.words.at.get(word)) is not None:
            return self.words.rows[k]
        for n in ORDERS:
            table = self.grams[n]
            at = table.at.get
            found = [table.rows[k] for g in grams_of(word, n) if (k := at(g)) is not None]
            if found:
                return sum(found[1:], found[0]) / len(found)
        return None


class TokenScores(dict):
    """From a lower-case token without white space to a row of ``rows``: scores, then votes, of its words."""

    def __init__(self, model: LanguageModel, limit: int = 300_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.rows = np.zeros((limit + 1, 2 * len(model.languages) + 1), dtype=np.float64)
        self.n = 0

    def __missing__(self, token: str) -> int:
        k = len(self.model.languages)
        row = self.rows[self.n]
        row[:] = 0
        for word in LETTERS.findall(token):
            v = self.model.vector(word)
            row[2 * k] += 1
            if v is not None:
                row[:k] += v
                row[k + int(np.argmax(v))] += 1
        self[token] = at = self.n
        self.n += 1
        return at

    def of(self, text: str) -> np.ndarray:
        """Sums over the tokens of a text, taken in blocks that the table can hold."""
        total, tokens = np.zeros(self.rows.shape[1]), text.lower().split()
        for i in range(0, len(tokens), 20_000):
            if self.n + 20_000 > self.limit:
                self.clear()
                self.n = 0
            total += self.rows[list(map(self.__getitem__, tokens[i : i + 20_000]))].sum(axis=0)
        return total


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, folds: int = 4, per_language: int = TRAIN_DOCS) -> LanguageModel:
    """A model of the documents outside the held-out fold.

    For each language about ``per_language`` documents are read, chosen by a hash of the id, so that the model
    is bounded and no language crowds out another; rows with a null text or language teach nothing. Counts of words and
    n-grams are made in the tasks and summed by Spark; the driver gets those of the documents read, each once. With no
    labelled rows the model has no language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where((F.coalesce(fold(F.col("id"), folds), F.lit(0)) != held_out) & F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel([], Table({}, np.zeros((0, 0))), {n: Table({}, np.zeros((0, 0))) for n in ORDERS})
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        for lang, words in seen.items():
            grams = {n: Counter() for n in ORDERS}
            for word, c in words.items():
                for n in ORDERS:
                    for g in grams_of(word, n):
                        grams[n][g] += c
            for n, table in ((0, words), *grams.items()):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(table)), pa.array([n] * len(table), pa.int32()), pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], names=["lang", "n", "gram", "c"])

    summed = sample.select("text", "lang").mapInArrow(count, "lang string, n int, gram string, c bigint").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    return _fit(sorted(counts), _rows(summed.select("lang", "n", "gram", "c").toArrow()), max(sorted(counts), key=counts.get))


def _rows(table: pa.Table) -> Iterator[tuple]:
    """Rows of a table, some at a time."""
    for batch in table.to_batches(max_chunksize=20_000):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _fit(languages: list[str], kept: Iterable[tuple[str, int, str, int]], usual: str | None = None) -> LanguageModel:
    """The model of counts (language, order or 0 for words, gram, count)."""
    at = {lang: i for i, lang in enumerate(languages)}
    names: dict[int, dict[str, int]] = {n: {} for n in (0, *ORDERS)}
    found = {n: (array("q"), array("q"), array("d")) for n in names}
    for lang, n, gram, c in kept:
        rows, columns, counts = found[n]
        rows.append(names[n].setdefault(gram, len(names[n])))
        columns.append(at[lang])
        counts.append(c)
    tables = {}
    for n, name in names.items():
        matrix = np.zeros((len(name), len(languages)))
        rows, columns, counts = (np.frombuffer(x, dtype=x.typecode) for x in found.pop(n))
        np.add.at(matrix, (rows, columns), counts)
        size = matrix.sum(axis=0) + 0.5 * len(name)
        tables[n] = Table(name, np.log((matrix + 0.5) / size))
    return LanguageModel(languages, tables.pop(0), tables, usual or languages[0])


def predict(model: LanguageModel, totals: np.ndarray) -> tuple[str, float]:
    """Language and score from a document's sums; ``und`` without a word, the usual language and 0.0 where no word or
    n-gram of it is known."""
    k = len(model.languages)
    if not k or not totals[2 * k]:
        return UNKNOWN, 0.0
    if not totals[k : 2 * k].sum():
        return model.usual, 0.0
    best = int(np.argmax(totals[:k]))
    return model.languages[best], float(totals[k + best] / totals[2 * k])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", into: str = "r") -> DataFrame:
    """``docs`` with a struct (lang_pred, score): the language of every whole text.

    ``und`` with score 0 where the text is null or has no letter (or the model no language); ties go to the
    language first in order. Nothing is shuffled, no other column is read; the bounded model is broadcast.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = TokenScores(shipped.value)
        for batch in batches:
            out = [predict(shipped.value, table.of(t or "")) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["lang_pred", "score"])

    return docs.withColumn(into, run(F.col(text_col)))


def language_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train outside fold 2 of 4 and predict every document: doc_id, held_out, lang_pred, score.

    Repeated rows give a row each; a null id is in the training folds and not held out. An empty table gives an empty
    result; with no labelled row every language is ``und``. Only letters count (signs such as ``²`` are none); texts
    are read whole, however long, in blocks of tokens. Other columns, whatever their names, are not read.
    """
    model = train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "r.lang_pred", "r.score")

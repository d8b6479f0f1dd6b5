"""Operator 11: maximal runs of words by masking with repeated k-grams, then Main-Lorentz.

A run of period q has ``least_length(q)`` words or more, so it overlaps itself, moved by q, in at least
``least_length(q) - q`` words. With k the least of these overlaps, each of its words lies in a k-gram that its document
holds twice. Words outside such k-grams are masked; the stretches that remain are short or periodic. In each, runs that
cross the middle are found for every period from the longest common extensions at the middle (Main-Lorentz), then those
within either half. All stretches of many texts go through a level of the recursion together, in arrays.

Extensions are compared by names of blocks of 2, 4, 8, ... words (equal blocks have equal names), so nothing rests on hashes
but the mask, which may let too much through and never hides a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import grams, mix, text_slices

#: Runs repeat at least so often and have so many words.
LEAST_EXPONENT, LEAST_WORDS = 4, 6
#: Blocks of words are named up to this power of two; longer extensions are compared block by block, so that the names
#: take a fixed number of bytes a word.
TOP = 12


def shortest_overlap(exponent: int = LEAST_EXPONENT, words: int = LEAST_WORDS) -> int:
    """The least number of words that a run shares with itself moved by its period: k of the mask."""
    return min(max(words, exponent * q) - q for q in range(1, words + 1))


def survivors(ids: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their own text holds more than once. ``text`` is each word's text, ascending."""
    n = len(ids) - k + 1
    if n < 2:
        return np.zeros(len(ids), dtype=bool)
    with np.errstate(over="ignore"):
        hashes = grams(mix(ids.astype(np.uint64) + np.uint64(1)), k) + mix(text[:n].astype(np.uint64) + np.uint64(1 << 40))
    whole = np.flatnonzero(text[:n] == text[k - 1 :])  # within one text
    order = whole[np.argsort(hashes[whole])]
    same = hashes[order][1:] == hashes[order][:-1]
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    change[twice] += 1
    np.add.at(change, twice + k, -1)
    return np.cumsum(change)[:-1] > 0


class Extensions:
    """Longest common extensions of places in ``ids``, whose first and last value occur nowhere else."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.names = [self._shared(ids.astype(np.int64))]
        while len(self.names) <= TOP and 1 << len(self.names) <= longest:
            before, width = self.names[-1], 1 << (len(self.names) - 1)
            at = np.flatnonzero((before[:-width] >= 0) & (before[width:] >= 0))
            if not len(at):
                break
            pairs = self._shared(before[at].astype(np.int64) * len(ids) + before[at + width], at)
            now = -1 - np.arange(len(ids), dtype=np.int32)
            now[at] = pairs
            self.names.append(now)

    @staticmethod
    def _shared(values: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Names from 0 for equal values; a value that occurs once gets a negative name of its own place."""
        _, name, count = np.unique(values, return_inverse=True, return_counts=True)
        return np.where(count[name] > 1, name, -1 - (np.arange(len(values)) if at is None else at)).astype(np.int32)

    def same(self, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        """Whether blocks of 2 ** ``level`` words beginning at ``a`` and ``b`` are equal."""
        if level >= len(self.names):
            return np.zeros(len(a), dtype=bool)
        names, inside = self.names[level], np.minimum(a, b) >= 0
        return inside & (names[np.maximum(a, 0)] == names[np.minimum(np.maximum(b, 0), len(names) - 1)])

    def of(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on; ``step`` is 1 forward, -1 backward (both included)."""
        got = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            width, active = 1 << level, np.arange(len(a))
            while len(active):
                move = got[active] if step > 0 else -got[active] - width + 1
                active = active[self.same(a[active] + move, b[active] + move, level)]
                got[active] += width
                if level < len(self.names) - 1:  # only the longest blocks can follow each other
                    break
        return got


def runs(ids: np.ndarray, text: np.ndarray, exponent: int = LEAST_EXPONENT, words: int = LEAST_WORDS) -> np.ndarray:
    """All runs as rows (start, end, period), ascending, places in ``ids``; no run crosses from one text to the next."""
    none = np.zeros((0, 3), dtype=np.int64)
    kept = survivors(ids, text, shortest_overlap(exponent, words))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], kept.view(np.int8), [0]])))
    first, last = edge[::2], edge[1::2]
    # A stretch ends with its text.
    cut = np.flatnonzero((text[1:] != text[:-1]) & kept[1:] & kept[:-1]) + 1
    first, last = np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([last, cut]))
    long = last - first >= words
    first, last = first[long], last[long]
    if not len(first):
        return none
    # Stretches one after the other, each between two values that occur once.
    size = last - first
    begin = np.cumsum(size + 1) - size
    total = int(begin[-1] + size[-1] + 1)
    line = np.full(total, -1, dtype=np.int64)
    source = np.repeat(first - begin, size)
    place = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    line[place] = ids[place + source]
    empty = np.flatnonzero(line < 0)
    line[empty] = int(ids.max()) + 1 + np.arange(len(empty))
    shift = np.zeros(total, dtype=np.int64)
    shift[place] = source
    near = Extensions(line, int(size.max()))
    found = []
    left, right = begin, begin + size
    while len(left):
        middle, most = (left + right) // 2, (right - left) // exponent
        m = np.repeat(middle, most)
        q = np.arange(len(m)) - np.repeat(np.cumsum(most) - most, most) + 1
        for anchor in (0, 1):  # places q apart from the middle on, and up to it
            a = m - anchor * q
            # A run has five or more such pairs around ``a``: two next to it on one side at least.
            some = near.same(a, a + q, 1) | near.same(a - 2, a - 2 + q, 1)
            p, x = q[some], a[some]
            start, end = x - near.of(x - 1, x - 1 + p, -1), x + p + near.of(x, x + p, 1)
            whole = end - start >= np.maximum(words, exponent * p)
            found.append(np.stack([start, end, p], axis=1)[whole])
        deeper = right - left >= 2 * words
        left, right = np.concatenate([left[deeper], middle[deeper]]), np.concatenate([middle[deeper], right[deeper]])
        still = right - left >= words
        left, right = left[still], right[still]
    rows = np.concatenate(found)
    if not len(rows):
        return none
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    again = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)  # the same stretch: found again, or with a multiple of its period
    rows = rows[np.concatenate([[True], ~again])]
    moved = shift[rows[:, 0]]
    rows[:, 0] += moved
    rows[:, 1] += moved
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapse(texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[str], list[int]]:
    """For each text its runs (start, length, period), the words that stay joined by one space, and its number of words."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at space and 9 to 13 only
    counts = np.array([len(w) for w in split], dtype=np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in split for w in words), dtype=np.int64, count=int(counts.sum()))
    text = np.repeat(np.arange(len(texts)), counts)
    rows = runs(ids, text) if len(ids) else np.zeros((0, 3), dtype=np.int64)
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 1], -1)
    stays = np.cumsum(change)[:-1] == 0
    begins = np.concatenate([[0], np.cumsum(counts)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (start, end, period) in zip(text[rows[:, 0]].tolist() if len(rows) else [], rows.tolist(), strict=True):
        found[k].append((start - int(begins[k]), end - start, period))
    kept = [b" ".join([w for w, s in zip(words, stays[a : a + len(words)].tolist(), strict=True) if s] if f else words).decode("utf-8", "surrogatepass") for words, f, a in zip(split, found, begins.tolist(), strict=False)]
    return found, kept, counts.tolist()


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def with_runs(docs: DataFrame, text_col: str = "text", into: str = "runs", collapsed: str = "collapsed", n_words: str = "n_words") -> DataFrame:
    """``docs`` with the runs of each whole text in order of start, then period, the text without what runs repeat, and
    its number of words.

    Words are separated by space and the signs 9 to 13. A run is a stretch of the smallest period q, of at least 6
    words and 4 q, that no neighbouring word extends; of it the first q words stay, unless another run takes them.
    A null or empty text has no words, no run and an empty collapsed text. Repeated rows give a row each, an empty table
    an empty result; columns named as the three are replaced. Nothing is shuffled; a task holds a few megabytes of
    texts, or one longer text.
    """
    keep = [c for c in docs.columns if c not in (into, collapsed, n_words)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    at = keep.index(text_col) if text_col in keep else None
    given = docs.select(*keep) if at is not None else docs.select(*keep, F.col(text_col))
    place = len(keep) if at is None else at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in text_slices(batch.column(place)):
                found, kept, counts = collapse(texts)
                part = batch.slice(done, len(texts))
                done += len(texts)
                spans = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in f] for f in found], kind)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], spans, pa.array(kept, pa.string()), pa.array(counts, pa.int64())], names=[*keep, into, collapsed, n_words])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(keep)]), f"`{into}` {RUN}", f"`{collapsed}` string", f"`{n_words}` bigint"])
    return given.mapInArrow(run, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a periodic end, for a tenth of the ids: what the query's contract asks for.

    h = crc32 of the id; where h % 10 = 0, word i from a = g % n on is word a + (i - a) % p of the text, with g = h div 10
    and p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def with_end(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
        return F.concat(F.slice(w, 1, a), F.transform(F.slice(w, a + 1, n - a), lambda x, i: F.get(w, a + i % p)))

    made = F.aggregate(F.array(words), F.lit(""), lambda _, w: F.when(F.size(w) > 0, F.array_join(with_end(w), " ")).otherwise(F.lit("")))
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.coalesce(made, F.lit(""))).otherwise(text)


def run_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of all documents after ``planted``: doc_id, n_runs, the run of the greatest exponent (ties: smallest start,
    then period; nulls without a run), and digests of all runs and of the collapsed text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), planted(F.col(id_col), F.col(text_col)).alias("text"))
    found = with_runs(rows)
    better = lambda x, y: x.isNull() | (y["length"] * x["period"] > x["length"] * y["period"])  # noqa: E731  rows come by start, then period
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda x, y: F.when(better(x, y), y).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.select("doc_id", "runs", "collapsed", "n_words", best.alias("best"))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )

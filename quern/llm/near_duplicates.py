"""Operator 6: near-duplicates by ProbMinHash, banding and verification.

A text is the set of its runs of five words. Each run sends exponential arrivals, at a rate of its weight, to random
registers; a register keeps the run that arrives first, and a run stops as soon as its next arrival is later than
every register's first, which leaves about m log m arrivals of however many runs. Two texts agree in a register with
the probability Jaccard of their weighted sets. All weights are one, so this is the Jaccard similarity of the sets,
by which pairs are verified, however often a text repeats a passage. At 0.8 all bands miss a pair once in 16,000.

Texts with equal sets are one class from the start. Classes that agree in all registers of a band share a bucket.

* Each class is first compared with one other: of the buckets it is in, the member that shares buckets with the most
  classes. The original of many copies is that member for nearly all of them, so copies make a pair each, however many.
* What these links join is one component. Only in buckets that then still hold several components is more compared:
  the members outside the bucket's largest component with all members of other components. They meet in blocks of a
  bounded size, which give links between components and never pairs of texts, and a pair whose components a block has
  joined already is passed over.

Every link is verified exactly by the Jaccard similarity of the sets of runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quern.llm.components import components
from quern.llm.shared import WordHashes, distinct, grams, materialise, mix, text_slices

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Share of registers below which a pair in a mixed bucket isn't verified. Registers agree independently, each with the
#: pair's similarity as probability; by Chernoff's bound fewer than once in 100,000 a pair of ``SIMILARITY`` is below,
#: a sixth of what the bands miss.
AGREEMENT = 0.65
#: Members of a mixed bucket that meet in one block: those that ask and those that are held, and their runs in all.
ASKING, HELD, BLOCK_RUNS = 256, 2048, 4_000_000
#: Parts into which rows that are repeated whole are dealt before one of them is taken.
SALTS = 64
#: Arrivals that are made at a time: a text of ordinary length is done after few rounds.
ARRIVALS = 2048
_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of five words, sorted, and their weights, which are all one as pairs are verified by their sets."""
    runs = distinct(grams(words, WORDS))
    return runs, np.ones(len(runs))


def signature(runs: np.ndarray, weights: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The run that arrives first in each of ``m`` registers.

    Arrivals are made some at a time for each run; a run whose last one is later than all registers is done.
    """
    first, winner = np.full(m, np.inf), np.zeros(m, dtype=np.uint64)
    time, active, done = np.zeros(len(runs)), np.arange(len(runs)), 0
    while len(active):
        some = max(1, ARRIVALS // len(active))
        steps = np.arange(done + 1, done + some + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            draw = mix(runs[active][:, None] + steps * _STEP)
            to = (mix(draw + _STEP) % np.uint64(m)).astype(np.int64)
        gap = -np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
        at = time[active][:, None] + np.cumsum(gap, axis=1) / weights[active][:, None]
        latest = first.max()
        flat, where = at.ravel(), to.ravel()
        early = np.flatnonzero(flat < latest)
        flat_e, where_e = flat[early], where[early]
        np.minimum.at(first, where_e, flat_e)
        won = first[where_e] == flat_e
        winner[where_e[won]] = runs[active][early[won] // some]
        time[active] = at[:, -1]
        active = active[at[:, -1] < first.max()]
        done += some
    return winner


def band_keys(registers: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of each row of registers, of a band's number and registers."""
    rows = registers.reshape(-1, BANDS, ROWS)
    key = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP), (len(rows), 1))
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix(key * _STEP + rows[:, :, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (64 bits of the text), content (128 bits of the set of runs; null without a word), size (runs), band
    keys, and 16 bits of each register."""
    kind = "struct<content:binary,size:int,bands:array<bigint>,registers:binary>"

    def sketched(texts: list[str], hashes: WordHashes) -> pa.StructArray:
        found = [weighted_runs(words) for words in hashes.many(texts)]
        some = [k for k, (runs, _) in enumerate(found) if len(runs)]
        winners = np.array([signature(*found[k]) for k in some], dtype=np.uint64).reshape(-1, REGISTERS)
        low = mix(winners).astype("<u2")
        at = np.full(len(found), -1)
        at[some] = np.arange(len(some))
        pick = pa.array(at, mask=at < 0)
        columns = [
            pa.array([blake2b(found[k][0].tobytes(), digest_size=16).digest() for k in some], pa.binary()),
            pa.array([len(found[k][0]) for k in some], pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(band_keys(winners).ravel())),
            pa.array([row.tobytes() for row in low], pa.binary()),
        ]
        return pa.StructArray.from_arrays([c.take(pick) for c in columns], names=["content", "size", "bands", "registers"])

    @arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for batch in batches:
            yield pa.concat_arrays([sketched(texts, hashes) for texts in text_slices(batch)] or [sketched([], hashes)])

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), run(F.col(text_col)).alias("s")).select("doc_id", "mark", "s.*")


def runs_of(text: Column) -> Column:
    """The sorted set of a text's runs, as the bytes of their hashes."""

    @arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for batch in batches:
            yield pa.array([weighted_runs(words)[0].tobytes() for texts in text_slices(batch) for words in hashes.many(texts)], pa.binary())

    return run(text)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) those whose sets of runs (content, runs) have a similarity of ``SIMILARITY`` or more."""

    @arrow_udf("boolean")
    def close(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            rows = ((np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True))
            yield pa.array([jaccard(x, y) >= SIMILARITY - 1e-12 for x, y in rows], pa.bool_())

    left = texts.select(F.col("content").alias("a"), F.col("runs").alias("runs_a"))
    right = texts.select(F.col("content").alias("b"), F.col("runs").alias("runs_b"))
    return pairs.join(left, "a").join(right, "b").where(close("runs_a", "runs_b")).select("a", "b")


def _across(members: DataFrame) -> DataFrame:
    """Links (a, b) between components within the mixed buckets.

    ``members``: key, band, content, component, minor (outside the bucket's largest component), askers and holders (blocks
    and chunks of the bucket), registers, runs. Each minor member asks all members of other components; a pair that
    shares several bands is compared in the first of them.
    """
    hashed = F.xxhash64("content")
    asking = members.where("minor").withColumn("asks", F.lit(True)).withColumn("i", F.pmod(hashed, F.col("askers")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("holders") - 1)))
    held = members.withColumn("asks", F.lit(False)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("askers") - 1))).withColumn("j", F.pmod(hashed, F.col("holders")).cast("int"))
    columns = ["key", "i", "j", "band", "asks", "minor", "content", "component", "registers", "runs"]

    def compare(table: pa.Table) -> pa.Table:
        band, asks, minor = table["band"][0].as_py(), table["asks"].to_pylist(), np.array(table["minor"].to_pylist())
        content, component = table["content"].to_pylist(), table["component"].to_pylist()
        registers = np.frombuffer(b"".join(table["registers"].to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
        runs = [np.frombuffer(x, dtype="<u8") for x in table["runs"].to_pylist()]
        names = list(dict.fromkeys(component))
        number = {c: k for k, c in enumerate(names)}
        own = np.array([number[c] for c in component])
        label = np.arange(len(names))  # of each component, what the links found here join it to
        hold = np.array([k for k, x in enumerate(asks) if not x])
        a, b = [], []
        for p in (k for k, x in enumerate(asks) if x):
            rest = hold[label[own[hold]] != label[own[p]]]
            if not len(rest):
                continue
            equal = registers[rest] == registers[p]
            agree = equal.mean(axis=1)
            good = np.flatnonzero((agree >= AGREEMENT) & (equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band))
            for q in rest[good[np.argsort(-agree[good], kind="stable")]].tolist():
                if label[own[p]] == label[own[q]] or minor[q] and content[q] < content[p]:
                    continue  # joined already, or compared where the other asks
                if jaccard(runs[p], runs[q]) >= SIMILARITY - 1e-12:
                    a.append(component[p])
                    b.append(component[q])
                    label[label == label[own[q]]] = label[own[p]]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return asking.select(columns).union(held.select(columns)).groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary")


def _linked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketches of ``docs``, and (content, doc_id, mark, component) of each distinct content with a word: its first
    row, and the component that links join it to."""
    sketch = materialise(sketches(docs, id_col, text_col), "sketches")
    first = F.min_by(F.struct("doc_id", "mark", "size", "bands", "registers"), F.struct(F.col("doc_id").isNull(), "doc_id", "mark"))
    classes = materialise(sketch.where("content is not null").groupBy("content").agg(first.alias("s")).select("content", "s.*"), "classes")
    rows = classes.select("content", "size", F.posexplode("bands").alias("band", "key"))
    # Counts and choices for each bucket are tables, so that a join with a bucket of very many members can be split.
    buckets = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    crowded = materialise(rows.join(buckets, "key"), "crowded")
    fame = materialise(crowded.groupBy("content").agg(F.sum("n").alias("fame")), "fame")
    order = F.struct("fame", F.xxhash64("content"), "content")
    leaders = materialise(crowded.select("key", "content").join(fame, "content").groupBy("key").agg(F.max(order).alias("leader")), "leaders")
    star = crowded.select("key", "content").join(leaders, "key").groupBy("content").agg(F.max("leader").alias("leader")).select(F.col("content").alias("a"), F.col("leader.content").alias("b")).where("a <> b")

    # Sets of runs of the classes that share a bucket, by id and mark together, as an id may be given twice.
    wanted = classes.join(fame.select("content"), "content", "left_semi").select("content", F.col("doc_id").alias("wanted_id"), F.col("mark").alias("wanted_mark"))
    named = docs.select(F.col(id_col).alias("named_id"), F.xxhash64(text_col).alias("named_mark"), F.col(text_col).alias("text"))
    texts = named.join(wanted, F.col("named_id").eqNullSafe(F.col("wanted_id")) & (F.col("named_mark") == F.col("wanted_mark"))).select("content", runs_of(F.col("text")).alias("runs"))
    texts = materialise(texts.dropDuplicates(["content"]), "runs")

    part = materialise(components(similar(star, texts)), "stars")
    members = crowded.join(part.withColumnRenamed("node", "content"), "content", "left").withColumn("component", F.coalesce("component", "content"))
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("runs")).groupBy("key")
    sizes = sizes.agg(F.max(F.struct("n", "component")).alias("major"), F.sum("n").alias("all"), F.sum("runs").alias("runs"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n, most: F.ceil(F.greatest(n / most, F.col("runs") * n / F.col("all") / BLOCK_RUNS)).cast("int")
    mixed = materialise(sizes.select("key", F.col("major.component").alias("major"), blocks(F.col("all") - F.col("major.n"), ASKING).alias("askers"), blocks(F.col("all"), HELD).alias("holders")), "mixed")
    members = members.select("key", "band", "content", "component").join(mixed, "key").withColumn("minor", F.col("component") != F.col("major")).drop("major")
    more = _across(members.join(classes.select("content", "registers"), "content").join(texts, "content"))
    joined = materialise(components(more), "across")

    found = classes.select("content", "doc_id", "mark").join(part.withColumnRenamed("node", "content"), "content", "left").withColumn("component", F.coalesce("component", "content"))
    found = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left")
    return sketch, materialise(found.select("content", "doc_id", "mark", F.coalesce("wider", "component").alias("component")), "found")


def _first_of_each(found: DataFrame) -> DataFrame:
    """component, and its first row: doc_id (the smallest; null only where no row has one) and mark."""
    first = F.min_by(F.struct("doc_id", "mark"), F.struct(F.col("doc_id").isNull(), "doc_id", "mark"))
    return found.groupBy("component").agg(first.alias("first")).select("component", "first.*")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (smallest id that links reach), kept (doc_id = class_id).

    Texts are linked at a Jaccard similarity of 0.8 of their sets of runs of five words (``\\w+``, lower case; a
    shorter text is one run). A null text, or one without a word, is linked with nothing. Rows with an equal id
    each have the class of their own text; a null id is the class's only where no other row has an id.
    Columns other than the two are not read. An empty table gives an empty result.
    """
    sketch, found = _linked(docs, id_col, text_col)
    smallest = materialise(_first_of_each(found).select("component", F.col("doc_id").alias("class_id")), "smallest")
    named = materialise(found.select("content", "component").join(smallest, "component").select("content", "class_id"), "named")
    out = sketch.select("doc_id", "content").join(named, "content", "left")
    return out.select("doc_id", F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _key(doc_id, mark):
    return F.concat_ws("|", mark.cast("string"), doc_id.cast("string"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns, but of each class of near-duplicates only one row, that of the smallest id.

    Texts that are linked with nothing stay, those without a word included, however often they are repeated. Where a
    row is given several times one of it stays. Rows are looked up by their id and the mark of their text together; a
    row that is repeated very often is dealt to many tasks, each of which passes on one of it.
    """
    sketch, found = _linked(docs, id_col, text_col)
    kept = _first_of_each(found).select(_key(F.col("doc_id"), F.col("mark")).alias("__key"))
    counts = sketch.where("content is not null").groupBy(_key(F.col("doc_id"), F.col("mark")).alias("__key")).agg(F.count("*").alias("n"))
    kept = materialise(kept.join(counts, "__key"), "kept")
    wordless = sketch.where("content is null").select(_key(F.col("doc_id"), F.col("mark")).alias("__key")).distinct()
    stay = materialise(kept.where("n = 1").select("__key").union(wordless), "stay")
    rows = docs.select(F.struct("*").alias("__row"), _key(F.col(id_col), F.xxhash64(text_col)).alias("__key"))
    out = rows.join(stay, "__key", "left_semi").select("__row")
    repeated = kept.where("n > 1").select("__key")
    if not repeated.isEmpty():
        spread = repeated.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(spread, ["__key", "__salt"])
        out = out.union(dealt.groupBy("__key").agg(F.first("__row").alias("__row")).select("__row"))
    return out.select("__row.*")

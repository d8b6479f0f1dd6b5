"""Operator 12: language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of a word after its predecessor, of the word alone and of any word:

    P(w | v) = a c(v, w) / c(v) + b c(w) / N + c / (V + 1)

The weights (a, b, c) depend on the bucket of c(v), its number of binary digits. They are learned by expectation-
maximisation on held-out counts: training documents are in ``FOLDS`` parts by a hash of the id, and a part's words are predicted from
the counts of the others (the counts of all, less the part's own).

Counts are over all documents and looked up without a row for each word. Documents are gathered in blocks of some megabytes
of one part. A block asks for the words and pairs it holds, each once, as sorted arrays of 64-bit keys that are dealt by key
range with the block's own counts; each range is summed over all blocks, and each block gets its answers back as arrays in the
order of its keys. A frequent word costs a number for each block it is in.

For the weights, words are summed in cells (part, bucket, ratio, count) whose bounds are an eighth of a power of two apart;
their number depends on the size of counts only, so that the driver learns the weights from a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import fold, materialise, mix

#: Parts of the training documents, each predicted from the others.
FOLDS = 3
#: Bytes of text in a block (unless one text is longer), and in a range of keys.
BLOCK, RANGE = 4_000_000, 8_000_000
#: Cells within a power of two; buckets of a context's frequency.
FINE, BUCKETS = 8, 64
#: What a word is followed by at the end of a text, and preceded by at its beginning. No word holds a space.
END = b" "

_FAR = 1 << 12  # more than any cell's number
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ZSTD = pa.Codec("zstd", compression_level=1)


@dataclass
class Block:
    """The words of some texts: each word's place among ``words``, distinct keys, and its pair's place among ``pairs``."""

    word: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    words: np.ndarray
    pairs: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Block:
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() + [END] for t in texts]  # of bytes: A-Z, space and 9 to 13
        lengths = np.array([len(w) for w in split], dtype=np.int64)
        coded = pa.array([END, *(w for words in split for w in words)], pa.large_binary()).dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        keys = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
        rank = np.argsort(np.argsort(keys))
        keys, place = np.sort(keys), rank[place]
        before, word = place[:-1], place[1:]
        codes, pair = np.unique(before * len(keys) + word, return_inverse=True)
        with np.errstate(over="ignore"):
            pairs = mix(keys[codes // len(keys)] * _STEP + keys[codes % len(keys)])
        order = np.argsort(pairs)
        moved = np.empty_like(order)
        moved[order] = np.arange(len(order))
        return cls(word, before, moved[pair], keys, pairs[order], lengths)


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers as eight rows of bytes, compressed, which is short where numbers are small. Their number comes first."""
    rows = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + _ZSTD.compress(rows.tobytes(), asbytes=True)


def unplanes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    rows = _ZSTD.decompress(data[8:], decompressed_size=8 * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(rows, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def packed(rows: pa.RecordBatch) -> bytes:
    """Rows as a compressed stream, so that texts take little room while they are moved."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked(column: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in column])


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the ``2 ** bits`` ranges of ascending keys begins, and the end."""
    starts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]])


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``docs`` (id, part, text) in blocks: texts of one task and part, about ``size`` bytes together.

    A row (block, part, rows) holds the texts of a block that came in one batch. Numbers of blocks follow the order of rows in
    a task, which is the same when the task is run again over a table.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        current: dict[int, list[int]] = {}
        for batch in batches:
            out = []
            for part, n in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if part not in current or current[part][1] + n > size:
                    current[part] = [made, 0]
                    made += 1
                current[part][1] += n + 1
                out.append(task + current[part][0])
            numbers, at = np.array(out, dtype=np.int64), batch.column(1)
            for block in dict.fromkeys(out):
                mine = np.flatnonzero(numbers == block)
                held = pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(mine)) for k in (0, 2)], names=["id", "text"])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), at.slice(int(mine[0]), 1), pa.array([packed(held)], pa.binary())], names=["block", "part", "rows"])

    return docs.select("id", "part", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).mapInArrow(number, "block bigint, part int, rows binary")


def asked(parts: DataFrame, bits: tuple[int, int]) -> DataFrame:
    """For each block, order of words and range of keys: the keys, and how often the block holds each (none if held out)."""

    def ask(table: pa.Table) -> pa.Table:
        block, part = table["block"][0].as_py(), table["part"][0].as_py()
        b = Block.of(unpacked(table["rows"])["text"].to_pylist())
        rows = []
        for n, keys, at in ((1, b.words, b.word), (2, b.pairs, b.pair)):
            counts = np.bincount(at, minlength=len(keys)) if part >= 0 else np.zeros(len(keys), dtype=np.int64)
            cuts = _cuts(keys, bits[n - 1])
            for r, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if j > i:
                    rows.append((block, part, n, r, planes(np.diff(keys[i:j], prepend=np.uint64(0))), planes(counts[i:j]) if part >= 0 else b""))
        return pa.table(dict(zip(("block", "part", "n", "range", "keys", "counts"), map(list, zip(*rows, strict=True)), strict=True)), pa.schema([("block", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return parts.groupBy("block").applyInArrow(ask, "block bigint, part int, n int, range int, keys binary, counts binary")


def answered(asks: DataFrame) -> DataFrame:
    """For each row of ``asks`` the counts of its keys over all training documents and over those of its part.

    ``kinds`` is the number of distinct training words of a range, in one of its rows and 0 in the others.
    """

    def answer(table: pa.Table) -> pa.Table:
        parts = table["part"].to_pylist()
        order = sorted(range(len(parts)), key=lambda k: table["block"][k].as_py())
        found = {k: np.cumsum(unplanes(table["keys"][k].as_py()), dtype=np.uint64) for k in order}
        ends = np.cumsum([len(found[k]) for k in order])
        keys, at = np.unique(np.concatenate([found[k] for k in order]), return_inverse=True)
        own = {p: np.zeros(len(keys), dtype=np.int64) for p in sorted(set(parts)) if p >= 0}
        place = {}
        for k, end in zip(order, ends.tolist(), strict=True):
            place[k] = at[end - len(found[k]) : end]
            if parts[k] >= 0:  # the keys of a row are distinct
                own[parts[k]][place[k]] += unplanes(table["counts"][k].as_py()).astype(np.int64)
        total = sum(own.values()) if own else np.zeros(len(keys), dtype=np.int64)
        kinds = int((total > 0).sum()) if table["n"][0].as_py() == 1 else 0
        rows = [(table["block"][k].as_py(), table["n"][k].as_py(), table["range"][k].as_py(), planes(total[place[k]]), planes(own[parts[k]][place[k]]) if parts[k] >= 0 else b"", kinds if i == 0 else 0) for i, k in enumerate(order)]
        return pa.table(dict(zip(("block", "n", "range", "total", "own", "kinds"), map(list, zip(*rows, strict=True)), strict=True)), pa.schema([("block", pa.int64()), ("n", pa.int32()), ("range", pa.int32()), ("total", pa.binary()), ("own", pa.binary()), ("kinds", pa.int64())]))

    return asks.groupBy("n", "range").applyInArrow(answer, "block bigint, n int, range int, total binary, own binary, kinds bigint")


def bucket(count: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: its number of binary digits, 0 for a context that training didn't see."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def cells(part: int, pair: np.ndarray, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of words with these counts (of the pair, of the word before, of the word), and the words in each."""

    def fine(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, np.rint(FINE * np.log2(np.where(x > 0, x, 1))).astype(np.int64) + _FAR // 2, 0)

    code = ((part * BUCKETS + bucket(before)) * _FAR + fine(pair / np.maximum(before, 1))) * _FAR + fine(word)
    return np.unique(code, return_counts=True)


def of_cell(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Part, bucket, ratio of pair and context, count of the word."""

    def value(k: np.ndarray) -> np.ndarray:
        return np.where(k > 0, 2.0 ** ((k - _FAR // 2) / FINE), 0.0)

    rest, word = np.divmod(code, _FAR)
    rest, pair = np.divmod(rest, _FAR)
    return *np.divmod(rest, BUCKETS), value(pair), value(word)


def learn(part: np.ndarray, bucket_: np.ndarray, pair: np.ndarray, word: np.ndarray, weight: np.ndarray, tokens: np.ndarray, kinds: int, rounds: int = 200) -> np.ndarray:
    """Weights (pair, word, any) of each bucket by expectation-maximisation; ``tokens`` are the words of each part.

    Each component has one more expected word, so no weight is 0 where its estimate can be; a bucket without held-out
    words has the weights of the nearest below it with some, else equal ones. The context of bucket 0 has no pairs.
    """
    left = tokens.sum() - tokens
    out = np.zeros((BUCKETS, 3))
    before = np.full(3, 1 / 3)
    for b in range(BUCKETS):
        some = bucket_ == b
        open_ = np.array([b > 0, tokens.sum() > 0, True], dtype=float)
        if some.any():
            estimates = np.stack([pair[some], word[some] / np.maximum(left[part[some]], 1), np.full(some.sum(), 1 / (kinds + 1))], axis=1)
            w, h = open_ / open_.sum(), weight[some].astype(float)
            for _ in range(rounds):
                share = estimates * w
                share /= share.sum(axis=1, keepdims=True)
                new = (h @ share + 1) * open_
                new /= new.sum()
                done = np.abs(new - w).max() < 1e-10
                w = new
                if done:
                    break
            before = w
        kept = before * open_ if (before * open_).sum() > 0 else open_
        out[b] = kept / kept.sum()
    return out


@dataclass
class Mixture:
    """Weights of each bucket, training words N and distinct ones V."""

    weights: np.ndarray
    tokens: int
    kinds: int

    def log10(self, pair: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        w = self.weights[bucket(before)]
        return np.log10(w[:, 0] * pair / np.maximum(before, 1) + w[:, 1] * word / max(self.tokens, 1) + w[:, 2] / (self.kinds + 1))

    def base(self, word: np.ndarray) -> np.ndarray:
        """Of the word alone, with a tenth added to each count."""
        return np.log10((word + 0.1) / (self.tokens + 0.1 * (self.kinds + 1)))


def counted(docs: DataFrame) -> DataFrame:
    """A stored table: a row for each of ``docs`` (id, part, text) with the counts of its words, and one for each block
    with its cells and its number of training words."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size // RANGE).bit_length())
    parts = blocks(docs)
    answers = answered(asked(parts, (max(0, bits - 2), bits)))
    kind = docs.schema["id"].dataType.simpleString()
    arrow = pa.schema([("id", pa.from_numpy_dtype(np.int64) if kind == "bigint" else pa.string()), ("part", pa.int32()), ("word", pa.binary()), ("pair", pa.binary()), ("cell", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())), ("tokens", pa.int64()), ("kinds", pa.int64())])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, part = unpacked(left["rows"]), left["part"][0].as_py()
        ids, b = texts["id"].to_pylist(), Block.of(texts["text"].to_pylist())
        order = sorted(zip(right["n"].to_pylist(), right["range"].to_pylist(), range(right.num_rows), strict=True))
        total, own = {}, {}
        for n, keys in ((1, b.words), (2, b.pairs)):
            mine = [k for m, _, k in order if m == n]
            total[n] = np.concatenate([unplanes(right["total"][k].as_py()) for k in mine]).astype(np.int64)
            if len(total[n]) != len(keys):
                raise ValueError("a block's texts changed while its counts were looked up: order the input or store it first")
            own[n] = np.concatenate([unplanes(right["own"][k].as_py()) for k in mine]).astype(np.int64) if part >= 0 else np.zeros(len(keys), dtype=np.int64)
        word, pair = total[1][b.word], total[2][b.pair]
        ends = np.cumsum(b.lengths).tolist()
        rows = [(i, part, planes(word[e - n : e]), planes(pair[e - n : e]), None, None, None, None) for i, e, n in zip(ids, ends, b.lengths.tolist(), strict=True)]
        code, held = cells(part, pair - own[2][b.pair], total[1][b.before] - own[1][b.before], word - own[1][b.word]) if part >= 0 else (np.zeros(0, dtype=np.int64),) * 2
        rows.append((None, part, None, None, code.tolist(), held.tolist(), int(b.lengths.sum()) if part >= 0 else 0, sum(right["kinds"].to_pylist())))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return materialise(parts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, f"id {kind}, part int, word binary, pair binary, cell array<bigint>, held array<bigint>, tokens bigint, kinds bigint"), "word-counts")


def mixture(table: DataFrame) -> Mixture:
    """The model that ``counted``'s rows of blocks speak for."""
    blocks_ = table.where("cell is not null")
    sums = blocks_.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).collect()
    tokens, kinds = np.zeros(FOLDS), sum(r.kinds for r in sums)
    for r in sums:
        if r.part >= 0:
            tokens[r.part] = r.tokens
    summed = blocks_.select(F.explode(F.arrays_zip("cell", "held")).alias("x")).groupBy("x.cell").agg(F.sum("x.held").alias("held")).toArrow()
    code, held = summed["cell"].to_numpy(), summed["held"].to_numpy()
    order = np.argsort(code)
    return Mixture(learn(*of_cell(code[order]), held[order], tokens, kinds), int(tokens.sum()), kinds)


def scored(table: DataFrame, model: Mixture) -> DataFrame:
    """For each document's row: n_tokens, n_known, base_score, score."""
    kind = table.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, p in zip(batch.column(2), batch.column(3), strict=True):
                word, pair = unplanes(w.as_py()).astype(np.int64), unplanes(p.as_py()).astype(np.int64)
                # The context of a text's first word is what stands at its end, as often as there are documents.
                before = np.concatenate([word[-1:], word[:-1]])
                out.append((len(word), int((word > 0).sum()), float(model.base(word).sum()), float(model.log10(pair, before, word).sum())))
            n, known, base, score = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=["id", "part", "n_tokens", "n_known", "base_score", "score"])

    return table.where("cell is null").select("id", "part", "word", "pair").mapInArrow(run, f"id {kind}, part int, n_tokens bigint, n_known bigint, base_score double, score double")


def score_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents of fold 0 of ``folds`` by the crc32 of the id are held out; the others, those of a null id among them,
    teach. A null or empty text is its end alone. Repeated rows teach and are scored each. With no training document all
    probabilities are those of one unknown word: 1, scores of 0. An empty table gives an empty result. Other columns are
    not read. Texts are whole; a task holds a block of texts, or one longer text, at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("bigint" if kind in ("int", "smallint", "tinyint", "bigint") else "string").alias("id"), fold(F.col(id_col), folds).alias("f"), F.col(text_col).alias("text"))
    rows = rows.select("id", F.when(F.col("f") == 0, F.lit(-1)).otherwise(F.coalesce((F.col("f") - 1) % FOLDS, F.lit(0))).cast("int").alias("part"), "text")
    table = counted(rows)
    model = mixture(table)
    return scored(table, model).select(F.col("id").alias("doc_id"), (F.col("part") < 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")

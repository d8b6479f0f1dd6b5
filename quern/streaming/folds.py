"""Folds over ordered logs whose busiest key is spread over tasks: state transitions that are composed.

A log is cut into slices of neighbouring rows in order of key and time, so a key with very many rows has several. A
slice is a function from the state before it to the state after it. All slices' functions are found side by side; going through a
key's functions in order (rows of a few numbers, not its log) gives the state before each slice, and with that every
slice is folded by itself.

A state is a count and a time, ``until``. A rule keeps its functions short: from a count that holds, the state after
the slice is looked up; from a lock only the first row at ``until`` or later matters, and neighbouring rows mostly lead to
the same end, so that these are steps of a few times.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import stored

#: Rows of a slice, about.
SLICE = 1_000_000
State = tuple[int, int]  # count, until


@dataclass
class Ends:
    """A slice as a function: the state after it for each count before it, and for a lock by the time when that is over."""

    first: int
    counts: list[State]
    times: list[int]
    resumed: list[State]


class Rule:
    """What a row (time, ok) makes of a state. ``most`` and ``length`` (microseconds) are the limit and a lock's length."""

    #: Whether a count is forgotten at ``until``.
    expires = False
    #: What slices are cut by besides the key: rows that are equal in these stay together.
    cut: tuple[str, ...] = ("t", "i")

    def __init__(self, most: int, length: int = 0):
        self.most, self.length = most, length

    def step(self, state: State, t: int, ok: bool) -> tuple[State, str]:
        """The state after a row, and the row's label."""
        raise NotImplementedError

    def ends(self, t: list[int], ok: list[bool]) -> Ends:
        raise NotImplementedError

    def begin(self) -> None:
        """Called before the rows of a slice and key."""

    def locked(self, state: State) -> bool:
        return state[0] >= self.most

    def after(self, ends: Ends, state: State) -> State:
        """The state after a slice."""
        if not self.locked(state):
            return ends.resumed[0] if self.expires and ends.first >= state[1] else ends.counts[state[0]]
        at = bisect_left(ends.times, state[1])
        return ends.resumed[at] if at < len(ends.times) else state

    @staticmethod
    def steps(t: list[int], resumed: list[State]) -> tuple[list[int], list[State]]:
        """States that follow when a lock is over at each row, as steps: each with the last time for which it holds."""
        last = [p for p in range(len(t)) if p + 1 == len(t) or resumed[p + 1] != resumed[p]]
        return [t[p] for p in last], [resumed[p] for p in last]


class Lockout(Rule):
    """So many failures lock; each one that counts moves ``until``; a success clears; what meets a lock doesn't count."""

    expires = True

    def step(self, state: State, t: int, ok: bool) -> tuple[State, str]:
        count, until = state
        if t >= until:
            count = 0
        if count >= self.most:
            return (count, until), "locked"
        return ((0, 0) if ok else (count + 1, t + self.length)), "counted"

    def ends(self, t: list[int], ok: list[bool]) -> Ends:
        n = len(t)
        clear: list[State] = [(0, 0)] * (n + 1)  # the end, if nothing is counted before row p

        def run(p: int, count: int, until: int) -> State:
            fresh = True
            while p < n:
                if not fresh and (count == 0 or t[p] >= until):
                    return clear[p]
                fresh = False
                if count >= self.most:
                    p = bisect_left(t, until, p)
                    continue
                count, until = (0, 0) if ok[p] else (count + 1, t[p] + self.length)
                p += 1
            return (count, until) if count else (0, 0)

        for p in range(n - 1, -1, -1):
            clear[p] = run(p, 0, 0)
        times, resumed = self.steps(t, clear[:n])
        return Ends(t[0], [run(0, c, t[0] + 1) for c in range(self.most)], times, resumed)


class Breaker(Rule):
    """So many failures in a row open it; after ``length`` one call is a trial, which closes it or opens it anew."""

    def step(self, state: State, t: int, ok: bool) -> tuple[State, str]:
        count, until = state
        if count >= self.most and t < until:
            return state, "open"
        label = "closed" if count < self.most else "half_open"
        return ((0, 0) if ok else (min(count + 1, self.most), t + self.length)), label

    def ends(self, t: list[int], ok: list[bool]) -> Ends:
        n = len(t)
        clear: list[State] = [(0, 0)] * (n + 1)
        trial: list[State] = [(0, 0)] * n

        def shut(until: int, p: int) -> State:
            p = bisect_left(t, until, p)
            return trial[p] if p < n else (self.most, until)

        def run(p: int, count: int) -> State:
            until = 0
            while p < n:
                if ok[p]:
                    return clear[p + 1]
                count, until, p = count + 1, t[p] + self.length, p + 1
                if count >= self.most:
                    return shut(until, p)
            return count, until

        for p in range(n - 1, -1, -1):
            trial[p] = clear[p + 1] if ok[p] else shut(t[p] + self.length, p + 1)
            clear[p] = run(p, 0)
        times, resumed = self.steps(t, trial)
        return Ends(t[0], [run(0, c) for c in range(self.most)], times, resumed)


class MinuteGuard(Rule):
    """So many calls in each clock minute; a call made whose row isn't ok opens the circuit for ``length``, while which
    calls are denied and don't count. Slices hold whole minutes. The state is the time when the circuit closes."""

    cut = ("m",)
    MINUTE = 60_000_000

    def __init__(self, most: int, length: int):
        super().__init__(most, length)
        self.begin()

    def begin(self) -> None:
        self.minute, self.made = None, 0

    def locked(self, state: State) -> bool:
        return True

    def step(self, state: State, t: int, ok: bool) -> tuple[State, str]:
        """Calls of the minute are counted beside the state, as no slice begins within a minute."""
        if t < state[1]:
            return state, "open"
        if t // self.MINUTE != self.minute:
            self.minute, self.made = t // self.MINUTE, 0
        self.made += 1
        if self.made > self.most:
            return state, "over"
        return (state if ok else (0, t + self.length)), "allowed"

    def ends(self, t: list[int], ok: list[bool]) -> Ends:
        n = len(t)
        resumed: list[State] = [(0, 0)] * (n + 1)

        def run(p: int) -> State:
            minute, made = t[p] // self.MINUTE, 0
            while p < n and t[p] // self.MINUTE == minute:
                if made == self.most:
                    p = bisect_left(t, (minute + 1) * self.MINUTE, p)
                    continue
                made += 1
                if ok[p]:
                    p += 1
                    continue
                until = t[p] + self.length
                p = bisect_left(t, until, p + 1)
                if p == n:
                    return 0, until
            return resumed[p]

        for p in range(n - 1, -1, -1):
            resumed[p] = run(p)
        times, steps = self.steps(t, resumed[:n])
        return Ends(t[0], [], times, steps)


class Attempts(Rule):
    """Failures in a row up to ``most``, at which the count starts again: attempts at a batch until it is given up."""

    def locked(self, state: State) -> bool:
        return False

    def step(self, state: State, t: int, ok: bool) -> tuple[State, str]:
        count = 0 if ok else state[0] + 1
        return (count % self.most, 0), str(count)

    def ends(self, t: list[int], ok: list[bool]) -> Ends:
        last = max((p for p in range(len(ok)) if ok[p]), default=None)
        if last is not None:
            return Ends(t[0], [((len(ok) - 1 - last) % self.most, 0)] * self.most, [], [])
        return Ends(t[0], [((c + len(ok)) % self.most, 0) for c in range(self.most)], [], [])


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[int], list[bool]]]:
    """Rows (slice, k, t, i, s) in order as one list of times and outcomes for each slice and key."""
    at, t, ok = None, [], []
    for batch in batches:
        for where, time, good in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if where != at:
                if t:
                    yield at, t, ok
                at, t, ok = where, [], []
            t.append(time)
            ok.append(bool(good))
    if t:
        yield at, t, ok


def folded(log: DataFrame, key: str, micros: Column, tie: str, ok: str, rule: Rule, slice_rows: int = SLICE) -> DataFrame:
    """(key, tie, label) of each row of ``log`` whose key and time aren't null, folded by key in order of time and tie.

    A row whose outcome is null failed. An empty log gives an empty result. Columns of ``log`` other than these aren't read.
    """
    rows = log.select(F.col(key).alias("k"), micros.alias("t"), F.col(tie).alias("i"), F.coalesce(F.col(ok), F.lit(False)).alias("s")).where("k is not null and t is not null")
    rows = rows.withColumn("m", F.floor(F.col("t") / MinuteGuard.MINUTE))
    kinds = dict(rows.dtypes)
    cuts = max(1, -(-rows.count() // slice_rows))
    sliced = stored(rows.repartitionByRange(cuts, "k", *rule.cut).select(F.spark_partition_id().alias("slice"), "k", "t", "i", "s"), "slices")
    in_order = lambda df: df.repartition("slice", "k").sortWithinPartitions("slice", "k", "t", "i")
    state = pa.list_(pa.int64())
    whole = pa.schema([("first", pa.int64()), ("counts", state), ("counts_until", state), ("times", state), ("resumed", state), ("resumed_until", state)])

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, k), t, good in _portions(batches):
            e = rule.ends(t, good)
            values = (e.first, [c for c, _ in e.counts], [u for _, u in e.counts], e.times, [c for c, _ in e.resumed], [u for _, u in e.resumed])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k]), *[pa.array([v], f.type) for v, f in zip(values, whole, strict=True)]], names=["slice", "k", *whole.names])

    def entries(table: pa.Table) -> pa.Table:
        out, now = [], (0, 0)
        for r in sorted(table.to_pylist(), key=lambda r: r["slice"]):
            out.append((r["slice"], r["k"], *now))
            pairs = lambda name: list(zip(r[name], r[f"{name}_until"], strict=True))  # noqa: E731, B023
            now = rule.after(Ends(r["first"], pairs("counts"), r["times"], pairs("resumed")), now)
        return pa.table({"slice": pa.array([x[0] for x in out], pa.int32()), "k": table["k"], "count": pa.array([x[2] for x in out], pa.int64()), "until": pa.array([x[3] for x in out], pa.int64())})

    # Only keys of several slices have states to carry: at most two for each slice and those within.
    wide = sliced.groupBy("k").agg(F.min("slice").alias("a"), F.max("slice").alias("b")).where("a < b").select("k")
    made = in_order(sliced.join(wide, "k", "left_semi").select("slice", "k", "t", "i", "s")).mapInArrow(functions, f"slice int, k {kinds['k']}, first bigint, counts array<bigint>, counts_until array<bigint>, times array<bigint>, resumed array<bigint>, resumed_until array<bigint>")
    before = made.groupBy("k").applyInArrow(entries, f"slice int, k {kinds['k']}, count bigint, until bigint")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, (0, 0)
        for batch in batches:
            part, k, t, i, good, count, until = batch.columns
            out = []
            for where, entry, time, well in zip(zip(part.to_pylist(), k.to_pylist(), strict=True), zip(count.to_pylist(), until.to_pylist(), strict=True), t.to_pylist(), good.to_pylist(), strict=True):
                if where != at:
                    at, now = where, entry
                    rule.begin()
                now, said = rule.step(now, time, well)
                out.append(said)
            yield pa.RecordBatch.from_arrays([k, i, pa.array(out, pa.string())], names=[key, tie, "label"])

    carried = sliced.join(before, ["slice", "k"], "left").select("slice", "k", "t", "i", "s", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("until", F.lit(0)).alias("until"))
    return in_order(carried).mapInArrow(label, f"`{key}` {kinds['k']}, `{tie}` {kinds['i']}, label string")

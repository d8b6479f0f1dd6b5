"""Cutting texts at places that no match of the tokenizers' pattern crosses, so that pieces can be reused."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.shared import gathered, mix, powers

#: White space other than a single space between two characters that are none: any but space and newline, two spaces,
#: a space at a newline or at an end of the text.
_ODD = "[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|  | \\n|\\n |\\A | \\z"
_SAFE = re.compile(r"(?<=\S)(?= \S)")

#: Signs that end words, and the letter below which all versions of Unicode agree on what is a letter.
SIGNS, LETTERS_END = (".", ",", ";", ":", "!", "?"), "\u0250"
#: Longer segments are encoded each time, so that a table of segments stays small.
LONGEST_KEPT = 64
#: Bytes of names that are hashed at a time; a longer name is hashed whole.
HASHED = 1 << 17
#: New segments that are kept apart, before they are merged into the table.
RECENT = 50_000


def segments(text: str) -> list[str]:
    """Parts of ``text`` without their leading space, which all but the first have.

    A single space between two characters that are no white space always begins a match of the pattern
    (`` ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+``) and no match reaches across it; the text is cut only there.
    """
    first, *rest = _SAFE.split(text)
    return [first, *(s[1:] for s in rest)]


def _stem(segment: str) -> tuple[str, str]:
    """A word of letters and the sign at its end, between which the pattern always cuts; else the segment whole."""
    if segment[-1:] in SIGNS and segment[:-1].isalpha() and max(segment[:-1]) < LETTERS_END:
        return segment[:-1], segment[-1]
    return segment, ""


Rows = tuple[np.ndarray, np.ndarray]  # ids of some rows one after the other, and how many each has


@dataclass
class Encoded:
    """What some texts are made of: text k is the ``counts[k]`` next of ``which``, places in the rows of ``ids`` that
    have ``lengths`` and begin at ``starts``."""

    ids: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    which: np.ndarray
    counts: np.ndarray

    def texts(self) -> Iterator[np.ndarray]:
        """The ids of each text."""
        n = self.lengths[self.which]
        ids = gathered(self.ids, self.starts[self.which], n)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(self.counts)])]
        return (ids[a:b] for a, b in pairwise(ends.tolist()))


def names_hashed(names: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string, which together are taken as its name: sums over its bytes, as in ``WordHashes``.

    Sums are taken over blocks of strings, as they need eight bytes several times for each byte; a string's hash doesn't
    depend on what stands beside it.
    """
    offsets = np.frombuffer(names.buffers()[1], dtype=np.int64)[names.offset : names.offset + len(names) + 1]
    if not len(names):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    held = np.frombuffer(names.buffers()[2], dtype=np.uint8) if offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    cuts = np.searchsorted(offsets, np.arange(offsets[0] + HASHED, offsets[-1], HASHED))
    out = np.zeros((2, len(names)), dtype=np.uint64)
    for a, b in pairwise(np.unique([0, *cuts, len(names)]).tolist()):
        first, last = int(offsets[a]), int(offsets[b])
        data, start, end = held[first:last], offsets[a:b] - first, offsets[a + 1 : b + 1] - first
        up, down = powers(len(data) + 1)
        for k in (1, 2):
            with np.errstate(over="ignore"):
                signs = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * k + 1) + np.uint64(k << 40))
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(signs[data] * up[: len(data)])])
                out[k - 1, a:b] = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return out[0], out[1]


class _Level:
    """Encoded names in order of their first hash."""

    def __init__(self):
        none = np.zeros(0, dtype=np.int64)
        self.key, self.check, self.start, self.size, self.ids = none.astype(np.uint64), none.astype(np.uint64), none, none.astype(np.int32), none.astype(np.uint32)

    def add(self, key: np.ndarray, check: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        at = np.searchsorted(self.key, key[order], "right")
        self.check = np.insert(self.check, at, check[order])
        self.start = np.insert(self.start, at, start[order] + len(self.ids))
        self.size = np.insert(self.size, at, size[order].astype(np.int32))
        self.key, self.ids = np.insert(self.key, at, key[order]), np.concatenate([self.ids, ids.astype(np.uint32)])

    def places(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Where each name is; -1 where it isn't."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)


class SegmentTable:
    """A bounded table from segment to the token ids that ``encode`` makes of it.

    ``encode`` takes a list of whole segments and returns their ids one after the other and the number of each;
    ``encode_spaced`` does so for segments that begin with a space and hold no other. A text that holds one of
    ``whole``, tokens that are found before the pattern is applied, is a single segment. Names are kept as two hashes
    and ids in arrays, about 50 bytes a segment. What is new is merged into the newer of two halves; when that is full
    it becomes the older, whose segments return to the newer as they are met again.
    """

    def __init__(self, encode: Callable[[list[str]], Rows], encode_spaced: Callable[[list[str]], Rows] | None = None, limit: int = 2_000_000, whole: tuple[str, ...] = ()):
        self.encode, self.encode_spaced, self.limit, self.whole = encode, encode_spaced or encode, limit, whole
        self.signs = encode(list(SIGNS))
        self.recent, self.newer, self.older = _Level(), _Level(), _Level()

    def _cut(self, texts: list[str]) -> pa.LargeListArray | pa.ListArray:
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, _ODD)
        for token in self.whole:
            odd = pc.or_(odd, pc.match_substring(column, token))
        plain = pc.split_pattern(column, " ")
        if not pc.any(odd).as_py():
            return plain
        some = odd.to_numpy(zero_copy_only=False)
        cut = pa.array([[t] if any(w in t for w in self.whole) else segments(t) for t, o in zip(texts, some, strict=True) if o], plain.type)
        at = np.where(some, len(texts) + np.cumsum(some) - 1, np.arange(len(texts)))
        return pa.concat_arrays([plain, cut]).take(pa.array(at))

    def _found(self, names: pa.LargeStringArray, ids: list, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Add the rows of known names to ``ids`` and put their places into ``starts`` and ``sizes`` (-1 for others); the
        hashes, and what the older half alone had."""
        key, check = names_hashed(names)
        order = np.argsort(key)  # neighbouring look-ups then touch neighbouring memory
        left = order
        for level in (self.recent, self.newer, self.older):
            at = level.places(key[left], check[left])
            hit, left, at = left[at >= 0], left[at < 0], at[at >= 0]
            n = level.size[at].astype(np.int64)
            starts[hit], sizes[hit] = sum(map(len, ids)) + np.cumsum(n) - n, n
            ids.append(gathered(level.ids, level.start[at], n))  # not the level's ids, which are megabytes for each call
        return key, check, hit

    def of(self, texts: list[str]) -> Encoded:
        """New segments of all texts are encoded in one call, the first ones of texts apart, as they have no space."""
        cut = self._cut(texts)
        bounds = cut.offsets.to_numpy()
        flat = cut.flatten()
        rest = np.ones(len(flat), dtype=bool)
        rest[bounds[:-1] - bounds[0]] = False
        coded = flat.filter(pa.array(rest)).dictionary_encode()
        names = coded.dictionary
        ids: list[np.ndarray] = []
        starts, sizes = np.full(len(names), -1), np.full(len(names), -1)
        key, check, again = self._found(names, ids, starts, sizes)
        missing = np.flatnonzero(starts < 0)
        if len(missing):
            self._encode_missing(names.take(pa.array(missing)).to_numpy(zero_copy_only=False).tolist(), missing, ids, starts, sizes)
        kept = np.concatenate([missing, again])
        kept = kept[pc.utf8_length(names.take(pa.array(kept))).to_numpy() <= LONGEST_KEPT]
        first_ids, first_sizes = self.encode(flat.filter(pa.array(~rest)).to_pylist())
        pool = np.concatenate([*ids, first_ids.astype(np.uint32)])
        if len(kept):
            n = sizes[kept]
            self.recent.add(key[kept], check[kept], np.cumsum(n) - n, n, gathered(pool, starts[kept], n))
            self._roll()
        which = np.empty(len(flat), dtype=np.int64)
        which[rest] = coded.indices.to_numpy()
        which[~rest] = len(names) + np.arange(len(texts))
        starts = np.concatenate([starts, len(pool) - len(first_ids) + np.cumsum(first_sizes) - first_sizes])
        return Encoded(pool, starts, np.concatenate([sizes, first_sizes]), which, np.diff(bounds))

    def _encode_missing(self, names: list[str], places: np.ndarray, ids: list, starts: np.ndarray, sizes: np.ndarray) -> None:
        split = [_stem(name) for name in names]
        stems = list(dict.fromkeys(stem for stem, _ in split))
        number = {stem: k for k, stem in enumerate(stems)}
        own_starts, own_sizes, own = np.full(len(stems), -1), np.full(len(stems), -1), []
        self._found(pa.array(stems, pa.large_string()), own, own_starts, own_sizes)
        for encode, spaced in ((self.encode_spaced, True), (self.encode, False)):
            some = [k for k in np.flatnonzero(own_starts < 0).tolist() if (" " not in stems[k]) == spaced]
            if some:
                made, n = encode([" " + stems[k] for k in some])
                own_starts[some], own_sizes[some] = sum(map(len, own)) + np.cumsum(n) - n, n
                own.append(made.astype(np.uint32))
        sign_ids, sign_sizes = self.signs
        # Each name is its stem's row and its sign's, or an empty one.
        at = np.concatenate([own_starts, sum(map(len, own)) + np.cumsum(sign_sizes) - sign_sizes, [0]])
        n = np.concatenate([own_sizes, sign_sizes, [0]])
        signs = {sign: len(stems) + k for k, sign in enumerate((*SIGNS, ""))}
        rows = np.array([(number[stem], signs[sign]) for stem, sign in split]).ravel()
        base = sum(map(len, ids))
        ids.append(gathered(np.concatenate([*own, sign_ids.astype(np.uint32)]), at[rows], n[rows]))
        both = n[rows].reshape(-1, 2).sum(axis=1)
        starts[places], sizes[places] = base + np.cumsum(both) - both, both

    def _roll(self) -> None:
        if len(self.recent.key) > RECENT:
            self.newer.add(self.recent.key, self.recent.check, self.recent.start, self.recent.size, self.recent.ids)
            self.recent = _Level()
        if len(self.newer.key) > self.limit // 2:
            self.newer, self.older = _Level(), self.newer


def rows_of(values: list) -> Rows:
    """Lists of ids as rows."""
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    return np.fromiter(chain.from_iterable(values), dtype=np.uint32, count=int(lengths.sum())), lengths


def in_slices(values: list, size: int = 256) -> list[list]:
    return [values[i : i + size] for i in range(0, len(values), size)]

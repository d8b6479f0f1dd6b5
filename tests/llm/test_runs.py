"""Operator 11: runs against brute force, the query's contract, odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

from quern.llm import periodic_runs
from quern.llm.queries import op11_periodic_runs


def brute(words):
    """Every period by itself: stretches of words that equal those a period later."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def dropped(words, runs):
    out = set()
    for start, length, period in runs:
        out |= set(range(start + period, start + length))
    return [w for i, w in enumerate(words) if i not in out]


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_runs_of_random_words():
    rng, texts = random.Random(11), []
    for _ in range(1500):
        n, kinds = rng.randrange(90), rng.choice([1, 2, 3, 40])
        words = [str(rng.randrange(kinds)) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randrange(1, 12)
            words = words[: a + p] + [words[a + (i - a) % p] for i in range(a + p, n)]
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    found, kept, counts = periodic_runs.collapse(texts)
    assert sum(map(len, found)) > 500
    for text, runs, left, n in zip(texts, found, kept, counts, strict=True):
        words = text.split()
        assert runs == brute(words) and left == " ".join(dropped(words, runs)) and n == len(words)


def test_long_runs_and_lone_blocks():
    period = [f"w{k}" for k in range(5000)]
    texts = [" ".join(period * 4 + period[:17]), "a " * 30_000, " ".join(period) + " b b b b b b", "b " * 5, "b " * 6]
    found, _, _ = periodic_runs.collapse(texts)
    assert found == [[(0, 20_017, 5000)], [(0, 30_000, 1)], [(5000, 6, 1)], [], [(0, 6, 1)]]


def test_mask_hides_no_run_and_covers_only_repeats():
    assert periodic_runs.shortest_overlap() == 5 and periodic_runs.shortest_overlap(2, 2) == 1
    assert periodic_runs.collapse(["a b c a b c a b c a b c", "a b c", "a b c"])[0] == [[(0, 12, 3)], [], []]  # none across texts


def expected(doc_id, text):
    words = split(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{p}\n" for s, m, p in runs)), digest(" ".join(dropped(words, runs))), n)


def check(rows, texts):
    assert len(rows) == len(texts)
    want = sorted(((i, *expected(i, t)) for i, t in texts), key=str)
    got = sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256, r.n_words) for r in rows), key=str)
    assert got == want


def test_query_against_brute_force(spark, sf_dir, sample):
    rows = op11_periodic_runs(spark, sf_dir).collect()
    check(rows, list(zip(sample.doc_id.tolist(), sample.text.tolist(), strict=True)))
    assert sum(r.n_runs for r in rows) >= 10


def test_odd_rows(spark, docs_of):
    texts = [(1, None), (2, ""), (3, " \n "), (5, "x y x y x y x y"), (5, "x y x y x y x y"), (None, "no no no no no no"), (None, None), (6, "é ü " * 40), (7, "\x1c \x85 \x1c \x85 " * 4), (8, "a\x0bb\x0ca\rb a b a b")]
    planted = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:6]
    texts += [(k, t) for k, t in zip(planted, ["one", "a b c d e f g", "", None, " lead and trail ", "w " * 50], strict=True)]
    docs = docs_of(texts).withColumnsRenamed({"ids": "runs", "words": "collapsed", "key": "n_words"})
    check(periodic_runs.run_table(docs).collect(), texts)
    kept = periodic_runs.with_runs(docs)
    assert set(kept.columns) == set(docs.columns) and kept.count() == len(texts)
    assert periodic_runs.run_table(docs.limit(0)).count() == 0

"""Operators 1, 6 and 7 against brute force on small tables."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import components as comp
from quern.llm import decontaminate, near_duplicates, vector_duplicates
from quern.llm.queries import op1_decontamination, op6_near_duplicates, op7_vector_duplicates
from quern.llm.shared import WordHashes, grams


def runs(text, n=5):
    words = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def classes(rows):
    """Smallest id of each row's class, by comparing all pairs."""
    sets = [runs(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    return sorted((i, min(groups[find(k)])) for k, (i, _) in enumerate(rows))


def variants(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(12):
        words = rng.choices(vocabulary, k=120 + 10 * g)
        for _ in range(rng.randint(1, 9)):
            own = list(words)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    return rows


def test_near_duplicates_equal_brute_force(spark, sf_dir, sample, docs_of):
    rows = variants()
    got = near_duplicates.near_duplicate_classes(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == classes(rows) and all(r.kept == (r.doc_id == r.class_id) for r in got)
    found = sorted((r.doc_id, r.class_id) for r in op6_near_duplicates(spark, sf_dir).collect())
    assert found == classes(list(zip(sample.doc_id.tolist(), sample.text, strict=True)))


def test_near_duplicates_odd_rows(odd):
    got = near_duplicates.near_duplicate_classes(odd).collect()
    assert len(got) == 10
    by = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert by == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    kept = near_duplicates.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 9
    assert near_duplicates.near_duplicate_classes(odd.limit(0)).count() == 0 == near_duplicates.one_of_each(odd.limit(0)).count()


def test_one_of_each(docs_of):
    rows = variants(5)
    want = sorted({c for _, c in classes(rows)})
    assert sorted(r.doc_id for r in near_duplicates.one_of_each(docs_of(rows)).collect()) == want


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    one = lambda x: np.ones(len(x))
    agree = (near_duplicates.signature(a, one(a), 2048) == near_duplicates.signature(b, one(b), 2048)).mean()
    assert abs(agree - 300 / 500) < 0.05
    assert (near_duplicates.signature(a, one(a)) == near_duplicates.signature(a[::-1].copy(), one(a))).all()


def test_copies_that_repeat_a_passage_more_often(docs_of):
    rng = random.Random(8)
    story = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for _ in range(12):
        passage, rest = story(100), story(100)
        rows += [(len(rows), f"{passage} " * 300 + f"{rest} {story(3)}"), (len(rows) + 1, f"{passage} {rest} {story(3)}")]
    registers = {r.doc_id: np.frombuffer(r.registers, dtype="<u2") for r in near_duplicates.sketches(docs_of(rows)).collect()}
    assert all((registers[k] == registers[k + 1]).mean() > 0.85 for k in range(0, len(rows), 2))
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates.near_duplicate_classes(docs_of(rows)).collect()) == classes(rows) == [(k, k - k % 2) for k in range(len(rows))]


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (None, 3), (200, 100)]
    got = {r.node: r.component for r in comp.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 200: 100}
    assert comp.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_vectors(rows, least=0.98):
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)
    unit = []
    for _, v, label in rows:
        good = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if good else None)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a], links[b] = links[a] + 1, links[b] + 1
                parent[find(a)] = find(b)
    least_id = defaultdict(list)
    for k in range(n):
        least_id[find(k)].append(rows[k][0])
    return sorted((rows[k][0], links[k], min(least_id[find(k)])) for k in range(n))


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(40):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 8)):
            rows.append((len(rows), (centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15])).tolist(), int(g % 3)))
    rows += [(900, [0.0] * 16, 1), (901, None, 1), (902, [1.0] * 15 + [None], 1), (903, [1.0] * 15 + [float("nan")], 1), (904, [float("inf")] + [1.0] * 15, 1), (905, rows[0][1], None), (906, rows[0][1], 0), (907, [1.0, 2.0], 0), (908, [1.0, 2.0], 0), (909, [], 1), (920, [1.0], 1), (921, [2.5], 1), (922, [-1.0], 1), (910, [1e200] * 16, 1), (911, [1e-200] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("cell", F.lit(1)).withColumn("n", F.lit("x"))
    want = brute_vectors([r for r in rows if r[0] not in (910, 911)])
    got = vector_duplicates.vector_classes(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id not in (910, 911)) == want
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id in (910, 911)} == {910: (1, 910), 911: (1, 910)}
    assert vector_duplicates.vector_classes(df.limit(0)).count() == 0


def test_vector_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in op7_vector_duplicates(spark, sf_dir).collect()) == brute_vectors(rows)


def test_visited_cells_miss_no_neighbour():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    centres = vector_duplicates.codebook(x, 9)
    near, d = vector_duplicates.nearest(x, centres)
    bounds = vector_duplicates.cell_bounds(d, centres)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert (bounds[:, near] <= apart + 1e-9).all()
    cells = vector_duplicates.multi_sequence(bounds[0] ** 2, bounds[1] ** 2, 1.0)
    sums = (bounds[0][:, None] ** 2 + bounds[1][None] ** 2).ravel()
    assert sorted(cells) == np.flatnonzero(sums <= 1.0).tolist() and (np.diff(sums[cells]) >= 0).all()


ITEMS = [(1, "Which gas do plants take from the air in daylight to make sugar? They take carbon dioxide from the open air."), (2, "How many sides has a regular hexagon drawn on paper with a ruler? It has exactly six sides of equal length."), (3, None), (4, "word"), (5, "")]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_decontamination(spark, docs_of):
    filler = lambda n, seed: " ".join(random.Random(seed).choices([f"f{k}" for k in range(900)], k=n))
    one, two = ITEMS[0][1], ITEMS[1][1]
    question = one.split("?")[0]
    rows = [(1, one), (2, f"{filler(900, 1)} {one.upper()} {filler(70, 2)}"), (3, filler(500, 3)), (4, f"{one} {filler(300, 4)} {two}"), (5, question), (6, None), (7, ""), (8, " ".join(random.Random(9).sample(one.split(), len(one.split())))), (9, "word"), (9, two), (10, "the air is open and plants make sugar in daylight")]
    got = decontaminate.contamination(docs_of(rows), items(spark)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1), (4, 1), (4, 2), (9, 2), (9, 4)]
    plain = spark.createDataFrame([(1, one, "kept", "own")], "doc_id bigint, text string, items string, __leaks_0 string")
    assert decontaminate.contamination(plain, items(spark)).count() == 1
    assert all(0.4 <= r.score <= 1.000001 for r in got)
    assert decontaminate.contamination(docs_of(rows), items(spark).limit(0)).count() == 0 == decontaminate.contamination(docs_of([]), items(spark)).count()
    flagged = decontaminate.with_leaks(docs_of(rows).drop("leaks"), items(spark))
    assert flagged.count() == len(rows) and flagged.columns[-1] == "leaks"


def test_answers_are_verified_by_their_own_words(spark, docs_of):
    filler = lambda n, seed: " ".join(random.Random(seed).choices([f"f{k}" for k in range(900)], k=n))
    short = "What is the name of the capital of the country that lies west of the Rhine today? Paris."
    long = " ".join(f"q{k}" for k in range(300)) + "? " + " ".join(f"a{k}" for k in range(40)) + "."
    bench = spark.createDataFrame([(1, short), (2, long), (3, "solitary"), (4, "two words")], "item_id bigint, text string")
    question = short.split("?")[0]
    rows = [
        (1, f"{filler(50, 1)} {question}? {filler(50, 2)}"),
        (2, f"{filler(50, 1)} {question}? Paris, {filler(50, 2)}"),
        (3, f"{filler(50, 1)} {question}? {filler(900, 2)} paris"),
        (4, " ".join(long.split()[:70])),
        (5, f"{filler(90, 3)} {long} {filler(90, 4)}"),
        (6, " ".join(long.split()[:150] + long.split()[-40:])),
        (7, f"{filler(300, 5)} Solitary! {filler(20, 6)}"),
        (8, "solitary"),
        (9, "these two words"),
        (10, "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9"),
    ]
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contamination(docs_of(rows), bench).collect())
    assert got == [(2, 1), (5, 2), (6, 2), (7, 3), (8, 3), (9, 4)]


def test_items_in_slices_give_the_same(spark, docs_of, monkeypatch):
    rows = [(1, ITEMS[0][1]), (2, ITEMS[1][1])]
    want = sorted(map(tuple, decontaminate.contamination(docs_of(rows), items(spark)).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 1)
    assert sorted(map(tuple, decontaminate.contamination(docs_of(rows), items(spark)).collect())) == want


def test_wand_finds_what_scoring_all_entries_finds():
    rng = random.Random(10)
    vocabulary = [f"v{k}" for k in range(60)]
    entries = decontaminate.entries_of([(k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 50)))) for k in range(200)], hashes := WordHashes())
    statistics = decontaminate.Statistics()
    statistics.add(entries)
    index = decontaminate.BlockMaxIndex(entries, statistics)
    for _ in range(40):
        passage = " ".join(rng.choices(vocabulary, k=100))
        _, terms = index.hits(grams(hashes.of(passage), 2))
        terms = sorted(set(terms.tolist()))
        scores = defaultdict(float)
        for t in terms:
            for d, w in zip(index.docs[t].tolist(), index.weights[t].tolist(), strict=True):
                scores[d] += w
        for threshold in (0.1, 0.25):
            want = {d: s for d, s in scores.items() if s >= threshold}
            assert dict(index.search(terms, threshold)) == pytest.approx(want)


def test_decontamination_query(spark, sf_dir, sample):
    """Documents that hold an item's words in a row are found, and no others of those that share no run of eight."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in op1_decontamination(spark, sf_dir).collect()}
    for i, text in zip(sample.doc_id.tolist(), sample.text, strict=True):
        line = f" {' '.join(re.findall(r'\w+', (text or '').lower()))} "
        eights = runs(text, 8)
        for b in bench:
            if f" {' '.join(re.findall(r'\w+', b.text.lower()))} " in line:
                assert (i, b.item_id) in got
            elif (i, b.item_id) in got:
                assert eights & runs(b.text, 8)


def test_vector_sql(spark, tmp_path):
    import duckdb

    from quern.llm.oracles import vector_classes

    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + rng.normal(size=8) * 0.06).tolist(), k % 2) for k in range(60)] + [(100, None, 1), (101, [0.0] * 8, 1), (102, rows_of := centres[0].tolist(), None), (103, rows_of, 0), (104, rows_of, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    ours = sorted(map(tuple, vector_duplicates.vector_classes(df).collect()))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert sorted(con.sql(vector_classes()).fetchall()) == ours

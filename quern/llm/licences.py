"""Operator 10: licence scan by a positional index of rare tokens, in DataFrame expressions only.

The index is made of a table of licence templates. For the words of each template that the fewest templates have (the
highest IDF) a posting holds template, offset and IDF. The licence words of a file look up their postings, position minus offset
says where the template would begin, and the IDF of the postings that agree on one beginning is summed. A template is
reported where enough of its IDF agrees and its mandatory key phrases stand in the file. All of it happens within the
row of a file: nothing is shuffled, however many files or licence words there are.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Public licence notices: label, notice, phrases that must stand in the file.
TEMPLATES = (
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty", ("gnu general public license",)),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("gpl-reference", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "licensed under")),
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("apache license", "in compliance with the license")),
    ("apache-reference", "licensed under the apache license version 2 0", ("apache license", "licensed under")),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted", "without restriction")),
    ("mit-reference", "released under the mit license", ("mit license", "released under")),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistribution and use", "following conditions are met")),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("unlicense-notice", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("unencumbered software", "public domain")),
    ("cc-by-nc-reference", "licensed under cc by nc 4 0", ("cc by nc", "licensed under")),
    ("cc-by-sa-reference", "licensed under cc by sa 4 0", ("cc by sa", "licensed under")),
    ("cc-by-nd-reference", "licensed under cc by nd 4 0", ("cc by nd", "licensed under")),
)

#: Words of a template that have postings: those of the highest IDF among its first ``OPENING`` words, which a file that
#: quotes only the beginning of a notice has too. Words in more than a share of ``COMMON`` of the templates are left out,
#: but for a template's two rarest.
POSTED, OPENING, COMMON = 8, 28, 0.25
#: Share of the IDF of a template's postings that must agree on one beginning.
SHARE = 0.6
#: Templates at most: their postings are part of the plan.
MOST_TEMPLATES = 1000

Template = tuple[str, str, tuple[str, ...]]


def frequency(templates: Sequence[Template]) -> Counter:
    """In how many templates each word stands."""
    return Counter(w for _, notice, _ in templates for w in set(notice.split()))


def positional_index(templates: Sequence[Template] = TEMPLATES) -> tuple[dict[str, list[tuple[int, int, float]]], list[float]]:
    """Postings (template, offset, IDF) of each posted word, and the IDF of all postings of each template."""
    seen = frequency(templates)
    postings: dict[str, list[tuple[int, int, float]]] = defaultdict(list)
    whole = []
    for k, (_, notice, _) in enumerate(templates):
        words = notice.split()[:OPENING]
        ranked = sorted(set(words), key=lambda w: (seen[w], -len(w), w))[:POSTED]
        rare = [w for n, w in enumerate(ranked) if n < 2 or seen[w] <= max(1, COMMON * len(templates))]
        idf = {w: math.log(1 + len(templates) / seen[w]) for w in rare}
        whole.append(sum(idf[w] for w in words if w in idf))
        for offset, w in enumerate(words):
            if w in idf:
                postings[w].append((k, offset, idf[w]))
    return dict(postings), whole


def anchors(templates: Sequence[Template] = TEMPLATES) -> list[str]:
    """A word of each base phrase, and of the first mandatory phrase of each template: where none of them stands, nothing
    can be found."""
    seen = frequency(templates)
    return sorted({min(p.split(), key=lambda w: (seen[w], w)) for p in (*(p for p, _ in BASE), *(phrases[0] for _, _, phrases in templates))})


def templates_of(table: DataFrame) -> list[Template]:
    """Templates from a table with label, notice and phrases (array of strings): a row that has a label, a notice with a
    word and a phrase with a word. At most ``MOST_TEMPLATES``; more raise an error."""
    split = lambda text: F.array_join(words_of(text), " ")
    phrases = F.filter(F.transform("phrases", split), lambda p: p != "")
    rows = table.select("label", split(F.col("notice")).alias("notice"), phrases.alias("phrases")).where("label is not null and notice <> '' and size(phrases) > 0").distinct().limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} licence templates")
    return sorted((r.label, r.notice, tuple(r.phrases)) for r in rows)


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z; a null text has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, SEPARATORS), "")


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase's words in order."""
    first, *rest = phrase.split()

    def stands(i: Column) -> Column:
        hit = F.get(words, i) == first
        for k, w in enumerate(rest, 1):
            hit = hit & (F.get(words, i + k) == w)
        return hit

    return F.when(F.array_contains(words, first), F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)).otherwise(F.array().cast("array<int>"))


def _template_scores(words: Column, templates: Sequence[Template]) -> Column:
    """array<struct<t,s>>: templates with enough IDF agreeing on one beginning, and its share; the best first."""
    postings, whole = positional_index(templates)
    if not postings:
        return F.array().cast("array<struct<t:int,s:double>>")
    vocabulary = F.array(*map(F.lit, sorted(postings)))
    table = F.create_map(*[x for w, ps in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("t"), F.lit(o).alias("o"), F.lit(round(i / whole[k], 9)).alias("s")) for k, o, i in ps]))])
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: F.array_contains(vocabulary, h["w"]))
    begins = F.array_sort(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(table, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["o"]).alias("b"), p["s"].alias("s"))))))
    kind = "struct<t:int,b:int,s:double,done:array<struct<t:int,s:double>>>"
    start = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("b"), F.lit(0.0).alias("s"), F.array().cast("array<struct<t:int,s:double>>").alias("done")).cast(kind)

    def closed(acc: Column) -> Column:
        return F.when((acc["t"] >= 0) & (acc["s"] >= SHARE), F.concat(acc["done"], F.array(F.struct(acc["t"].alias("t"), acc["s"].alias("s"))))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        same = (acc["t"] == x["t"]) & (acc["b"] == x["b"])
        return F.struct(x["t"].alias("t"), x["b"].alias("b"), F.when(same, acc["s"]).otherwise(F.lit(0.0)) + x["s"], F.when(same, acc["done"]).otherwise(closed(acc)).alias("done")).cast(kind)

    return F.aggregate(begins, start, step, closed)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] | DataFrame = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a base phrase stands, else the best share of a reported template's IDF, else 0.
    A null or empty text has no words; repeated rows give a row each; other columns are not read. An empty table
    gives an empty result. ``templates`` may be a table (``templates_of``). Texts are scanned whole, however long, in time
    linear in their words but for a sort of their postings.
    """
    if isinstance(templates, DataFrame):
        templates = templates_of(templates)
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    none = F.array().cast("array<int>")
    anchored = F.arrays_overlap("words", F.array(*map(F.lit, anchors(templates))))
    rows = rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.when(anchored, F.col("words")).alias("words"))
    words = F.col("words")
    places = F.struct(*[F.when(words.isNull(), none).otherwise(_places(words, p)).alias(f"p{k}") for k, (p, _) in enumerate(BASE)])
    phrase = lambda p: F.instr(F.col("joined"), f" {p} ") > 0
    rows = rows.select("doc_id", "n_words", places.alias("at"), F.when(words.isNotNull(), _template_scores(words, templates)).alias("found"), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("joined"))
    verified = F.array_compact(F.array(*[F.when(F.forall(F.array(*[phrase(p) for p in needed]), lambda x: x), F.lit(k)) for k, (_, _, needed) in enumerate(templates)]).cast("array<int>"))
    rows = rows.select("doc_id", "n_words", "at", F.when(F.size("found") > 0, F.filter("found", lambda f: F.array_contains(verified, f["t"]))).otherwise(F.array().cast("array<struct<t:int,s:double>>")).alias("found"))
    starts = F.concat(*[F.col(f"at.p{k}") for k in range(len(BASE))])
    base = F.array_compact(F.array(*[F.when(F.size(f"at.p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    names = F.array(*[F.lit(label) for label, _, _ in templates]).cast("array<string>")
    more = F.transform("found", lambda f: F.get(names, f["t"]))
    in_text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        in_text(base).alias("base_labels"),
        in_text(F.concat(base, more)).alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("found", lambda f: f["s"])), F.lit(0.0))), 6)).alias("score"),
    )

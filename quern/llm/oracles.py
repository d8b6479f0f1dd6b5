"""DuckDB SQL for the operators whose results SQL can express on whole tables."""

from __future__ import annotations

from quern.llm.licences import BASE, SHARE, TEMPLATES, positional_index

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def vector_classes() -> str:
    """Operator 7: all pairs of a label, and what each vector reaches by links."""
    norm = "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))"
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / {norm}) AS u FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND {norm} > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.u) = len(b.u) WHERE list_dot_product(a.u, b.u) >= 0.98),
    r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
    SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""


def hard_negatives() -> str:
    """Operator 13: every anchor against all rows of its length."""
    return """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CASE WHEN len(a.v) = 0 THEN 0 ELSE list_dot_product(a.v, b.v)::BIGINT END AS score FROM v a JOIN v b ON len(a.v) = len(b.v) AND a IS DISTINCT FROM b WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY rank <= 5"""


def licence_scan() -> str:
    """Operator 10: base phrases, and templates by the places where their rare words agree on one beginning."""
    postings, whole = positional_index()
    values = ", ".join(f"('{w}', {t}, {o}, {round(i / whole[t], 9)!r}::DOUBLE)" for w, ps in sorted(postings.items()) for t, o, i in ps)
    needed = ", ".join(f"({t}, '{label}', [{', '.join(repr(p) for p in phrases)}])" for t, (label, _, phrases) in enumerate(TEMPLATES))
    places = []
    for phrase, label in BASE:
        words = phrase.split()
        same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(words))
        places.append(f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d WHERE list_contains(words, '{words[0]}')) WHERE {same}")
    return f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SEPARATOR}'), lambda w: w <> '') AS words FROM documents),
    p(w, t, o, s) AS (VALUES {values}), k(t, label, phrases) AS (VALUES {needed}), base AS ({' UNION ALL '.join(places)}),
    b AS (SELECT doc_id, count(*) AS n_base, min(place)::BIGINT AS first_word, max(place)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
    w AS (SELECT doc_id, unnest(words) AS w, unnest(range(0, len(words))) AS i FROM d),
    h AS (SELECT doc_id, t, i - o AS start, sum(s) AS s FROM w JOIN p USING (w) GROUP BY ALL HAVING sum(s) >= {SHARE}),
    f AS (SELECT doc_id, k.label, max(s) AS s FROM h JOIN k USING (t) JOIN d USING (doc_id) WHERE len(list_filter(phrases, lambda x: NOT contains(' ' || array_to_string(words, ' ') || ' ', ' ' || x || ' '))) = 0 GROUP BY ALL),
    m AS (SELECT doc_id, max(s) AS s FROM f GROUP BY doc_id),
    n AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM f) GROUP BY doc_id)
    SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, coalesce(m.s, 0.0::DOUBLE)), 6) END AS score
    FROM d LEFT JOIN b USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

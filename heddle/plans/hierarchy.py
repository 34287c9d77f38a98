"""Queries of the text hierarchy: features of sentences, paragraphs and documents, clause classes, heuristic arcs."""

from __future__ import annotations

from heddle.operators import hierarchy as H
from heddle.plans.fragments import TOK, sql_list
from heddle.plans.registry import query
from heddle.tables import load

_M = H.Markers()
_S = f"""p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS paragraph FROM documents),
l AS (SELECT doc_id, paragraph, list_filter(list_transform(string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM p),
s AS (SELECT doc_id, paragraph, pos, s, {TOK.format('s')} AS t FROM (SELECT doc_id, paragraph, unnest(l) AS s, unnest(range(len(l))) AS pos FROM l))"""


def _has(words) -> str:
    return f"list_has_any(t, {list(words)})"


_ASKS = f"(ends_with(s, '?') OR {_has(_M.question)})"
_CLAUSE = f"CASE WHEN {_ASKS} THEN 'question' WHEN {_has(_M.negative)} THEN 'negative' WHEN {_has(_M.condition)} THEN 'conditional' WHEN {_has(_M.relative)} THEN 'relative' WHEN {_has(_M.time)} THEN 'temporal' WHEN {_has(_M.joined)} THEN 'compound' ELSE 'statement' END"
_F = f"""{_S}, c AS (SELECT *, {_CLAUSE} AS clause FROM s),
f AS (SELECT doc_id, paragraph, pos, len(t) AS n_tokens, clause, CASE WHEN len(t) < 3 THEN 'fragment' WHEN clause IN ('conditional', 'relative', 'temporal') THEN 'complex' WHEN clause = 'compound' THEN 'compound' ELSE 'simple' END AS structure, coalesce(t[1], '') AS first, coalesce(t[-1], '') AS last,
len(list_filter(t, lambda x: contains(x, '-'))) AS hyphenated, len(list_filter(t, lambda x: starts_with(x, 'un') OR starts_with(x, 're'))) > 0 AS prefixed, len(s) AS chars FROM c)"""


def docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text")


@query(f"WITH {_F} SELECT * EXCLUDE (pos), pos AS at FROM f")
def line_features(spark, sf):
    return H.line_features(docs(spark, sf))


_P = f"{_F}, g AS (SELECT doc_id, paragraph, count(*) AS lines, sum(n_tokens)::BIGINT AS tokens, round(avg(n_tokens), 4) AS mean_tokens, count(*) FILTER (WHERE clause = 'question') AS questions, count(*) FILTER (WHERE clause = 'negative') AS negations, arg_min(first, pos) AS first, arg_max(last, pos) AS last FROM f GROUP BY 1, 2)"


@query(f"WITH {_P} SELECT * FROM g")
def paragraph_features(spark, sf):
    return H.paragraph_features(docs(spark, sf))


@query(f"""WITH {_P}, d AS (SELECT doc_id, count(*) AS paragraphs, sum(lines)::BIGINT AS lines, sum(tokens)::BIGINT AS tokens FROM g GROUP BY 1), w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(t) AS w FROM s) GROUP BY 1, 2),
k AS (SELECT doc_id, count(*) AS distinct_tokens FROM w GROUP BY 1), r AS (SELECT doc_id, w AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM w) WHERE r = 1)
SELECT doc_id, paragraphs, lines, tokens, coalesce(distinct_tokens, 0) AS distinct_tokens, coalesce(top, '') AS top FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)""")
def document_features(spark, sf):
    return H.document_features(docs(spark, sf))


@query(f"WITH {_F} SELECT clause, structure, count(*) AS n, round(avg(n_tokens), 4) AS mean_tokens FROM f GROUP BY 1, 2")
def clause_structures(spark, sf):
    from pyspark.sql import functions as F

    return H.line_features(docs(spark, sf)).groupBy("clause", "structure").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_tokens"), 4).alias("mean_tokens"))


@query(f"WITH {_S} SELECT doc_id, paragraph, pos AS at, len(t) AS n_tokens, {_has(_M.negative)} AS negated, {_ASKS} AS asks, CASE WHEN {_has(_M.future)} THEN 'future' WHEN {_has(_M.past)} THEN 'past' ELSE 'present' END AS tense FROM s")
def sentence_analysis(spark, sf):
    return H.sentence_analysis(docs(spark, sf))


@query(f"""WITH {_S}, b AS (SELECT *, lag(t) OVER (PARTITION BY doc_id, paragraph ORDER BY pos) AS u FROM s),
o AS (SELECT doc_id, paragraph, count(*) AS n, sum(len(t)) AS total, list_distinct(flatten(list(t))) AS kinds, sum(CASE WHEN u IS NULL OR greatest(len(list_distinct(t)), len(list_distinct(u))) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(t), list_distinct(u))) / greatest(len(list_distinct(t)), len(list_distinct(u))) END) AS near FROM b GROUP BY 1, 2)
SELECT doc_id, paragraph, CASE WHEN total / n > 12 THEN 'long' WHEN total / n > 6 THEN 'plain' ELSE 'short' END AS style, round(CASE WHEN total > 0 THEN len(kinds) / total ELSE 0 END, 4) AS variety, round(CASE WHEN n > 1 THEN near / (n - 1) ELSE 0 END, 4) AS cohesion FROM o""")
def paragraph_analysis(spark, sf):
    return H.paragraph_analysis(docs(spark, sf))


_VERBS, _OBJECTS = ("is", "was", "are", "est", "ist"), ("it", "them", "les", "das")


@query(f"""WITH {_S}, r AS (SELECT doc_id, paragraph, pos AS sentence, t, coalesce(list_max(list_filter(range(1, len(t) + 1), lambda i: t[i] IN {sql_list(list(_VERBS))})), len(t)) AS root FROM s WHERE len(t) > 0),
e AS (SELECT doc_id, paragraph, sentence, root, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS k FROM r), v AS (SELECT *, CASE WHEN k = root THEN 'root' WHEN k > root THEN 'mark' WHEN token IN {sql_list(list(_OBJECTS))} THEN 'obj' WHEN k = 1 THEN 'nsubj' ELSE 'mod' END AS relation FROM e)
SELECT doc_id, paragraph, sentence, k AS at, token, CASE relation WHEN 'root' THEN 0 WHEN 'mod' THEN k + 1 ELSE root END AS head, relation FROM v""")
def dependency_arcs(spark, sf):
    return H.arcs(docs(spark, sf), _VERBS, _OBJECTS)

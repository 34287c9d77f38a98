"""Queries of corpus discovery."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heddle.operators import corpus as C
from heddle.operators import discovery as V
from heddle.operators import discovery_run as R
from heddle.operators import hierarchy as H
from heddle.plans.folders import checkpoints
from heddle.plans.fragments import D, sql_list
from heddle.plans.hierarchy import _F, _S, docs
from heddle.plans.registry import query
from heddle.sources.versions import Versions
from heddle.tables import load

_CLOSED = {"the": "DET", "of": "ADP", "in": "ADP", "and": "CCONJ", "la": "DET", "der": "DET"}
_SUFFIX = {"ing": "VERB", "ed": "VERB", "ly": "ADV", "ment": "NOUN", "keit": "NOUN", "er": "VERB"}
_DICT = [("der", "PRON"), ("other", "ADJ"), ("was", "AUX"), ("that", "SCONJ"), ("the", "DET")]


def words(spark, sf):
    return C.tokenized(load(spark, sf, "documents")).select(F.explode("tokens").alias("word"))


_TAG = "CASE " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in _CLOSED.items()) + " " + " ".join(f"WHEN ends_with(w, '{s}') THEN '{t}'" for s, t in sorted(_SUFFIX.items(), key=lambda x: (-len(x[0]), x[0]))) + " ELSE 'NOUN' END"
_TAGGED = f"d AS ({D}), u AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM d) GROUP BY 1), g AS (SELECT w AS word, {_TAG} AS tag, n FROM u)"


@query(f"WITH {_TAGGED} SELECT word, tag, n FROM g")
def tagger_distribution(spark, sf):
    return V.tag_counts(words(spark, sf), _CLOSED, _SUFFIX)


_DICT_SQL = "(VALUES " + ", ".join(f"('{w}', '{t}')" for w, t in _DICT) + ") AS x(word, tag)"


@query(f"""WITH {_TAGGED}, v AS (SELECT word, tag, n AS votes FROM g UNION ALL SELECT word, tag, 10 FROM {_DICT_SQL} WHERE word IN (SELECT word FROM g)), s AS (SELECT word, tag, sum(votes)::BIGINT AS votes FROM v GROUP BY 1, 2)
SELECT word, tag, votes, round(votes / every, 4) AS confidence FROM (SELECT *, sum(votes) OVER (PARTITION BY word) AS every, row_number() OVER (PARTITION BY word ORDER BY votes DESC, tag) AS r FROM s) WHERE r = 1""")
def pos_hypotheses(spark, sf):
    return V.pos_hypotheses(V.tag_counts(words(spark, sf), _CLOSED, _SUFFIX), spark.createDataFrame(_DICT, "word string, tag string"))


_PRE, _SUF = ["re", "un", "de"], ["s", "er", "ing"]


def _cut_sql(a: str, prefix: bool) -> str:
    root = f"substring(word, {len(a) + 1})" if prefix else f"left(word, len(word) - {len(a)})"
    return f"SELECT word, '{'prefix' if prefix else 'suffix'}' AS relation, '{a}' AS part, {root} AS root FROM g WHERE {'starts' if prefix else 'ends'}_with(word, '{a}')"


@query(f"WITH {_TAGGED}, e AS ({' UNION ALL '.join([_cut_sql(a, True) for a in _PRE] + [_cut_sql(a, False) for a in _SUF])}) SELECT * FROM e WHERE len(root) >= 3 AND root IN (SELECT word FROM g)")
def morphology_hypotheses(spark, sf):
    return V.morphology(words(spark, sf), _PRE, _SUF)


@query(f"""WITH {_F}, g AS (SELECT clause, structure || '/' || CASE WHEN n_tokens < 5 THEN 'short' WHEN n_tokens < 12 THEN 'middle' ELSE 'long' END || '/' || CASE WHEN prefixed THEN 'prefixed' ELSE 'plain' END AS pattern, count(*) AS n FROM f GROUP BY 1, 2)
SELECT clause, pattern, n FROM (SELECT *, row_number() OVER (PARTITION BY clause ORDER BY n DESC, pattern) AS r FROM g) WHERE r <= 50""")
def sentence_patterns(spark, sf):
    return V.sentence_patterns(H.line_features(docs(spark, sf)))


_MARKERS = {"negation": ["not", "nicht", "pas"], "condition": ["if", "wenn", "si"], "plural": ["les", "los", "die"]}
_MARKERS_SQL = "(VALUES " + ", ".join(f"('{k}', '{m}')" for k, ms in _MARKERS.items() for m in ms) + ") AS m(kind, marker)"


@query(f"WITH {_S} SELECT kind, marker, count(*) AS n, count(DISTINCT doc_id) AS docs FROM s, {_MARKERS_SQL} WHERE list_contains(t, marker) GROUP BY 1, 2")
def grammar_phenomena(spark, sf):
    return V.phenomena(H.sentences(docs(spark, sf)), _MARKERS)


@query(f"""WITH {_S}, ph AS (SELECT kind, marker, count(*) AS n, count(DISTINCT doc_id) AS docs FROM s, {_MARKERS_SQL} WHERE list_contains(t, marker) GROUP BY 1, 2)
SELECT kind || '_' || left(sha1(marker), 10) AS id, kind, marker, n, docs, round(least(1.0, docs / 10), 4)::DOUBLE AS confidence FROM ph WHERE n >= 3""")
def grammar_hypotheses(spark, sf):
    """Phenomena with three sentences or more as patterns with an id and a confidence by documents."""
    from heddle.functions.cleaning import pattern_id

    p = V.phenomena(H.sentences(docs(spark, sf)), _MARKERS, 3)
    return p.select(pattern_id(F.col("kind"), F.col("marker")).alias("id"), "kind", "marker", "n", "docs", F.round(F.least(F.lit(1.0), F.col("docs") / 10), 4).alias("confidence"))


@query(f"""WITH d AS ({D}), b AS (SELECT first, second, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i])) AS first, unnest(list_transform(range(1, len(t)), lambda i: t[i + 1])) AS second FROM d) GROUP BY 1, 2),
u AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM d) GROUP BY 1), z AS (SELECT sum(n) AS z FROM u), p AS (SELECT first, second, b.n, round(log2(b.n * z / (x.n * y.n)), 4) AS pmi FROM b JOIN u x ON x.w = first JOIN u y ON y.w = second, z)
SELECT least(first, second) AS a, greatest(first, second) AS b, sum(n)::BIGINT AS n, max(pmi) AS pmi FROM p GROUP BY 1, 2 HAVING sum(n) >= 5 AND max(pmi) >= 1.0 ORDER BY pmi DESC, n DESC, a, b LIMIT 2000""")
def merged_collocations(spark, sf):
    d = C.tokenized(load(spark, sf, "documents"))
    one = C.ngram_counts(d, 1)
    two = C.ngram_counts(d, 2).select(F.split("gram", " ")[0].alias("first"), F.split("gram", " ")[1].alias("second"), F.col("count").alias("n"))
    z = one.agg(F.sum("count").alias("z"))
    count = lambda c: one.select(F.col("gram").alias(c), F.col("count").alias(f"n_{c}"))
    p = two.join(count("first"), "first").join(count("second"), "second").join(F.broadcast(z))  # one row
    return V.merged_collocations(p.select("first", "second", "n", F.round(F.log2(F.col("n") * F.col("z") / (F.col("n_first") * F.col("n_second"))), 4).alias("pmi")), 5, 1.0)


@query(f"""WITH d AS ({D}), e AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS p FROM d), n AS (SELECT w, lead(w) OVER (ORDER BY doc_id, p) AS x FROM e)
SELECT w || ' ' || x AS gram, count(*) AS n FROM n WHERE x IS NOT NULL GROUP BY 1""")
def bigrams_across_records(spark, sf):
    return V.across_records(C.tokenized(load(spark, sf, "documents")), "doc_id")


@query(f"""WITH {_TAGGED} SELECT word, n, shared FROM (SELECT word, n, CASE WHEN starts_with(word, 'there') THEN 5 WHEN starts_with(word, 'ther') THEN 4 WHEN starts_with(word, 'the') THEN 3 ELSE 2 END AS shared FROM g WHERE starts_with(word, 'th') AND word <> 'there' AND tag = (SELECT tag FROM g WHERE word = 'there')) ORDER BY shared DESC, n DESC, word LIMIT 10""")
def related_words(spark, sf):
    n = V.tag_counts(words(spark, sf), _CLOSED, _SUFFIX)
    return V.related_words(n, "there", n)


@query(f"""WITH {_TAGGED} SELECT tag, left(word, 2) AS prefix, count(*) AS words, sum(n)::BIGINT AS n FROM g WHERE len(word) >= 2 AND tag = (SELECT tag FROM g WHERE word = 'the') GROUP BY 1, 2""")
def same_tag_words(spark, sf):
    """Words whose tag equals that of the query word, by their first two letters."""
    n = V.tag_counts(words(spark, sf), _CLOSED, _SUFFIX)
    tag = n.where("word = 'the'").select("tag")
    return n.where("length(word) >= 2").join(F.broadcast(tag), "tag").groupBy("tag", F.substring("word", 1, 2).alias("prefix")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))


@query(f"""WITH d AS ({D}), e AS (SELECT doc_id, t FROM d WHERE len(t) > 0) SELECT 'starts with ' || t[1] AS pattern, count(*) AS n FROM e WHERE t[1] IN {sql_list(list(_CLOSED))} GROUP BY 1 UNION ALL SELECT 'ends with ' || t[-1], count(*) FROM e WHERE t[-1] IN {sql_list(list(_CLOSED))} GROUP BY 1""")
def pattern_mining(spark, sf):
    d = C.tokenized(load(spark, sf, "documents")).where(F.size("tokens") > 0)
    one = lambda name, at: d.select(F.element_at("tokens", at).alias("w")).where(F.col("w").isin(*_CLOSED)).groupBy(F.concat(F.lit(f"{name} with "), "w").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return one("starts", 1).unionByName(one("ends", -1))


_RULES = R.Rules(_CLOSED, _SUFFIX, tuple(_DICT), (tuple(_PRE), tuple(_SUF)), _MARKERS)


def _hypotheses_sql(where: str = "true") -> str:
    return f"""WITH {_F.replace("FROM documents", f"FROM (SELECT * FROM documents WHERE {where})")}, u AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM s) GROUP BY 1), g AS (SELECT w AS word, {_TAG} AS tag, n FROM u),
votes AS (SELECT word, tag, sum(n)::BIGINT AS n FROM (SELECT * FROM g UNION ALL SELECT word, tag, 10 FROM {_DICT_SQL} WHERE word IN (SELECT word FROM g)) GROUP BY 1, 2),
cut AS ({" UNION ALL ".join([_cut_sql(a, True) for a in _PRE] + [_cut_sql(a, False) for a in _SUF])}),
pair AS (SELECT x, y, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i])) AS x, unnest(list_transform(range(1, len(t)), lambda i: t[i + 1])) AS y FROM s) GROUP BY 1, 2),
pmi AS (SELECT least(x, y) AS a, greatest(x, y) AS b, sum(pair.n)::BIGINT AS n, max(log2(pair.n * (SELECT sum(n) FROM u) / (i.n * j.n))) AS pmi FROM pair JOIN u i ON i.w = x JOIN u j ON j.w = y GROUP BY 1, 2),
pattern AS (SELECT clause, structure || '/' || CASE WHEN n_tokens < 5 THEN 'short' WHEN n_tokens < 12 THEN 'middle' ELSE 'long' END || '/' || CASE WHEN prefixed THEN 'prefixed' ELSE 'plain' END AS pattern, count(*) AS n FROM f GROUP BY 1, 2),
mark AS (SELECT kind, marker, count(*) AS n FROM s, {_MARKERS_SQL} WHERE list_contains(t, marker) GROUP BY 1, 2),
h AS (SELECT 'pos' AS kind, 'word:' || word AS subject, 'pos:' || tag AS predicate, NULL::VARCHAR AS object, n, round(n / every, 4) AS confidence FROM (SELECT *, sum(n) OVER (PARTITION BY word) AS every, row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) AS r FROM votes) WHERE r = 1
UNION ALL SELECT 'morph_relation', 'word:' || word, 'morph:' || relation || ':' || part, 'root:' || root, n, round(least(1.0, n / 10), 4) FROM cut JOIN g USING (word) WHERE len(root) >= 3 AND root IN (SELECT word FROM g)
UNION ALL SELECT 'collocation', 'word:' || a, 'collocates', 'word:' || b, n, round(least(1.0, pmi / 10), 4) FROM pmi WHERE n >= 5 AND round(pmi, 4) >= 1.0
UNION ALL SELECT 'sentence_pattern', clause, 'pattern', pattern, n, round(n / every, 4) FROM (SELECT *, sum(n) OVER (PARTITION BY clause) AS every, row_number() OVER (PARTITION BY clause ORDER BY n DESC, pattern) AS r FROM pattern) WHERE r <= 50
UNION ALL SELECT 'grammar', kind, 'marker', marker, n, round(least(1.0, n / 10), 4) FROM mark WHERE n >= 3)
SELECT sha1(concat_ws('|', kind, subject, predicate, coalesce(object, ''))) AS id, kind, subject, predicate, object, n, confidence::DOUBLE AS confidence FROM h"""


def _store(spark) -> Versions:
    return Versions(spark, f"{checkpoints(spark)}/discovery-{uuid.uuid4().hex}")


@query(_hypotheses_sql())
def discovery_build(spark, sf):
    """The hypotheses of all five capabilities, from one scan, as stored."""
    store = _store(spark)
    R.run(store, docs(spark, sf), _RULES)
    return store.read("hypotheses")


@query(f"""WITH a AS ({_hypotheses_sql("lang = 'en'")}), b AS ({_hypotheses_sql()}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE id NOT IN (SELECT id FROM b)""")
def discovery_rerun(spark, sf):
    """A corpus that grows: a run over the English texts, then one over all; what only the first found stays."""
    store = _store(spark)
    R.run(store, load(spark, sf, "documents").where("lang = 'en'").select("doc_id", "text"), _RULES)
    R.run(store, docs(spark, sf), _RULES)
    return store.read("hypotheses")


@query(f"""SELECT id, CASE kind WHEN 'morph_relation' THEN 'morphology' ELSE 'lexicon' END AS type, subject, predicate, object FROM ({_hypotheses_sql()}) WHERE kind IN ('pos', 'morph_relation', 'collocation')""")
def claim_expression(spark, sf):
    """All hypotheses as claims; every second one names its predicate and root in its extras alone."""
    store = _store(spark)
    R.run(store, docs(spark, sf), _RULES)
    odd = (F.col("n") % 2 == 1) & (F.col("kind") != "collocation")
    h = store.read("hypotheses").withColumn("extras", F.when(F.col("kind") == "pos", F.create_map(F.lit("upos"), F.expr("substring(predicate, 5)"))).when(F.col("kind") == "morph_relation", F.create_map(F.lit("type"), F.expr("substring(predicate, 7)"), F.lit("root"), F.expr("substring(object, 6)"))))
    h = h.select("id", "kind", F.concat(F.lit("word:"), "subject").alias("subject"), F.when(~odd, F.col("predicate")).alias("predicate"), F.when(~odd, F.col("object")).alias("object"), "extras")
    return R.claims(h)

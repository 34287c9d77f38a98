"""Queries of retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heddle.operators import corpus as C
from heddle.operators import search as S
from heddle.operators import vector_index as VI
from heddle.plans.fragments import D
from heddle.plans.folders import checkpoints
from heddle.plans.registry import query
from heddle.sources.versions import Versions
from heddle.tables import load

_TERMS = [(1, "idiot"), (1, "the"), (2, "les"), (2, "dans"), (3, "license"), (3, "public")]
_Q = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _TERMS) + ") AS q(query_id, term)"


@query(f"""WITH d AS ({D}), tot AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d), tf AS (SELECT term, doc_id, length, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM {_Q}) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 4) AS score FROM tf JOIN df USING (term) JOIN {_Q} USING (term), tot GROUP BY 1, 2)
SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 10""")
def bm25_search(spark, sf):
    return S.bm25(C.tokenized(load(spark, sf, "documents")), spark.createDataFrame(_TERMS, "query_id int, term string"))


@query(f"""WITH d AS ({D}) SELECT term, count(*) AS docs, sum(tf)::BIGINT AS occurrences FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1, 2) GROUP BY 1""")
def inverted_index(spark, sf):
    p = S.postings(C.tokenized(load(spark, sf, "documents")))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"))


@query("""SELECT id, score::DOUBLE AS score, pass FROM (SELECT p_partkey AS id, CASE WHEN n = 'small ring' THEN 1.0 WHEN starts_with(n, 'small ring') THEN 0.9 WHEN contains(n, 'small ring') THEN 0.7 WHEN contains(n, 'small') OR contains(n, 'ring') THEN 0.6 END AS score,
CASE WHEN n = 'small ring' THEN 1 WHEN starts_with(n, 'small ring') THEN 2 WHEN contains(n, 'small ring') THEN 3 WHEN contains(n, 'small') OR contains(n, 'ring') THEN 4 END AS pass FROM (SELECT p_partkey, lower(p_name) AS n FROM part)) WHERE score IS NOT NULL ORDER BY score DESC, pass, id LIMIT 200""")
def lexical_passes(spark, sf):
    return S.lexical(load(spark, sf, "part"), "small ring", "p_name", "p_partkey", 200)


_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


_NEAREST = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id, round({_COS.format(a='q.v', b='e.v')}, 4) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, neighbour_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS r FROM s WHERE score >= 0.35) WHERE r <= 10"""


@query(_NEAREST)
def vector_top_k(spark, sf):
    e = load(spark, sf, "embeddings")
    return S.nearest(e, e.where("vec_id % 20 = 0"), 10, 0.35)


@query(_NEAREST)
def vector_index_top_k(spark, sf):
    """The same through a stored index that is built first."""
    e = load(spark, sf, "embeddings")
    store = Versions(spark, f"{checkpoints(spark)}/vectors-{uuid.uuid4().hex}")
    VI.build(store, e)
    return VI.searched(store, e.where("vec_id % 20 = 0"), 10, 0.35)[0]



@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), g AS (SELECT list_transform(range(1, 65), lambda i: (b.v[i] - a.v[i]) + c.v[i]) AS goal FROM e a, e b, e c WHERE a.vec_id = 1 AND b.vec_id = 2 AND c.vec_id = 3)
SELECT vec_id AS neighbour_id, round({_COS.format(a='v', b='goal')}, 4) AS score FROM e, g WHERE vec_id NOT IN (1, 2, 3) ORDER BY score DESC, neighbour_id LIMIT 5""")
def vector_analogy(spark, sf):
    return S.analogy(load(spark, sf, "embeddings"), 1, 2, 3)


@query("""SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS first FROM embeddings GROUP BY 1""")
def vector_centroids(spark, sf):
    return load(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("first"))

"""Queries of the observation build and of tables with versions: each builds its store in the shared folder and reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heddle.operators import observation as O
from heddle.plans.folders import checkpoints
from heddle.plans.fragments import TOK
from heddle.plans.registry import query
from heddle.sources.versions import Versions
from heddle.tables import load

#: Spelling variants of the fixture languages.
VARIANTS = (("tion", "tions"), ("thes", "these"))
_CASE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in VARIANTS)
_BASE = rf"""WITH p AS (SELECT doc_id, coalesce(source, '') AS source, regexp_split_to_array(text, '[.!?\n]+') AS a FROM documents),
s AS (SELECT doc_id, source, unnest(range(len(a))) AS pos, unnest(a) AS x FROM p),
o AS (SELECT *, list_transform(raw, lambda t: CASE t {_CASE} ELSE t END) AS t FROM (SELECT doc_id, source, pos, trim(x) AS x, {TOK.format("trim(x)")} AS raw FROM s) WHERE len(raw) > 0),
e AS (SELECT doc_id, source, pos, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS w, unnest(raw) AS f, t FROM o),
n AS (SELECT w, count(*) AS frequency FROM e GROUP BY 1)"""
_SIDES = r""", side AS (SELECT w, 'left' AS kind, unnest(t[greatest(i - 2, 1) : i - 1]) AS x FROM e UNION ALL SELECT w, 'right', unnest(t[i + 1 : i + 2]) FROM e),
pair AS (SELECT w, x, count(*) AS n FROM side WHERE w <> x GROUP BY ALL)"""


def _built(spark, sf) -> Versions:
    store = Versions(spark, f"{checkpoints(spark)}/observations-{uuid.uuid4().hex}")
    O.build(store, O.sentences(load(spark, sf, "documents")), O.Settings(variants=VARIANTS), "run-1")
    return store


@query(_BASE + r""" SELECT doc_id::VARCHAR AS document_id, source AS source_id, pos AS sentence_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens, t <> raw AS corrected FROM o""")
def observation_rows(spark, sf):
    return _built(spark, sf).read("observations").select("document_id", "source_id", F.col("sentence_id").cast("long").alias("sentence_id"), F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"), "corrected")


@query(_BASE + r""", g AS (SELECT w AS word, count(*) AS frequency, count(DISTINCT doc_id) AS doc_freq, count(DISTINCT (doc_id, source, pos)) AS sent_freq, count(DISTINCT source) AS source_count FROM e GROUP BY 1)
SELECT *, round(doc_freq / (SELECT count(DISTINCT (source, doc_id)) FROM o), 4) AS diversity FROM g""")
def observation_word_stats(spark, sf):
    return _built(spark, sf).read("word_stats").select("word", "frequency", "doc_freq", "sent_freq", "source_count", "diversity")


@query(_BASE + _SIDES + r""" SELECT w AS word, kind, row_number() OVER (PARTITION BY w, kind ORDER BY n DESC, x) AS place, x AS token, n FROM (SELECT w, kind, x, count(*) AS n FROM side GROUP BY ALL) QUALIFY place <= 10""")
def observation_contexts(spark, sf):
    words = _built(spark, sf).read("word_stats")
    each = [words.select("word", F.lit(k).alias("kind"), F.posexplode(k).alias("place", "x")) for k in ("left", "right")]
    return each[0].unionByName(each[1]).select("word", "kind", (F.col("place") + 1).cast("long").alias("place"), F.col("x.key").alias("token"), F.col("x.n").alias("n"))


@query(_BASE + _SIDES + r""", c AS (SELECT pair.w, pair.x, pair.n, log2(pair.n::DOUBLE * (SELECT count(*) FROM e) / (a.frequency::DOUBLE * b.frequency)) AS pmi FROM pair JOIN n AS a ON a.w = pair.w JOIN n AS b ON b.w = pair.x WHERE pair.n >= 5 AND a.frequency >= 5 AND b.frequency >= 5)
SELECT w AS word, row_number() OVER (PARTITION BY w ORDER BY round(pmi, 4) DESC, x) AS place, x AS token, round(pmi, 4) AS pmi, n FROM c WHERE pmi > 0 QUALIFY place <= 10""")
def observation_collocations(spark, sf):
    c = _built(spark, sf).read("word_stats").select("word", F.posexplode("collocations").alias("place", "x"))
    return c.select("word", (F.col("place") + 1).cast("long").alias("place"), F.col("x.key").alias("token"), "x.pmi", "x.n")


@query(_BASE + r""" SELECT w AS word, arg_min(CASE WHEN length(x) > 200 THEN x[1:199] || '…' ELSE x END, (source, doc_id::VARCHAR, pos)) AS snippet FROM e JOIN o USING (doc_id, source, pos) GROUP BY 1""")
def observation_snippets(spark, sf):
    return _built(spark, sf).read("word_stats").select("word", "snippet")


@query(_BASE + r""", d AS (SELECT e.*, doc_id % 2 AS half FROM e) SELECT w AS word, count(*) FILTER (WHERE half = 1) = 0 AS first_only, CASE WHEN count(*) FILTER (WHERE half = 0) > 0 THEN 'run-1' ELSE 'run-2' END AS first_run, CASE WHEN count(*) FILTER (WHERE half = 1) > 0 THEN 'run-2' ELSE 'run-1' END AS last_run,
CASE WHEN count(*) FILTER (WHERE half = 1) > 0 THEN count(*) FILTER (WHERE half = 1) ELSE count(*) END AS frequency FROM d GROUP BY 1""")
def observation_second_run(spark, sf):
    """Two runs over the even and the odd documents, and a third over the odd ones that changes nothing."""
    store = Versions(spark, f"{checkpoints(spark)}/observations-{uuid.uuid4().hex}")
    s = O.sentences(load(spark, sf, "documents"))
    odd = F.col("document_id").cast("long") % 2 == 1
    for run, part in (("run-1", s.where(~odd)), ("run-2", s.where(odd)), ("run-3", s.where(odd))):
        O.build(store, part, O.Settings(variants=VARIANTS), run)
    return store.read("word_stats").select("word", (F.col("last_run") == "run-1").alias("first_only"), "first_run", "last_run", "frequency")

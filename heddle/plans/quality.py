"""Queries of consensus, data quality and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import consensus as K
from heddle.operators import evaluation as E
from heddle.plans.registry import query
from heddle.tables import load

_EV = "SELECT l_orderkey AS key, l_returnflag AS value, l_linestatus AS tier, l_suppkey AS source, 1 - l_discount AS confidence FROM lineitem"
_W = "CASE WHEN tier = 'F' THEN 1.0 ELSE 0.5 END"


def _evidence(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("value"), F.col("l_linestatus").alias("tier"), F.col("l_suppkey").alias("source"), (1 - F.col("l_discount")).alias("confidence"))


def _weight():
    return F.when(F.col("tier") == "F", 1.0).otherwise(0.5)


@query(f"""WITH n AS (SELECT key, value, count(*) AS votes FROM ({_EV}) GROUP BY 1, 2), t AS (SELECT *, sum(votes) OVER (PARTITION BY key) AS total, row_number() OVER (PARTITION BY key ORDER BY votes DESC, value) AS r FROM n)
SELECT key, value, votes, round(votes / total, 4) AS agreement, round(votes / total, 4) >= 0.5 AS accepted FROM t WHERE r = 1""")
def majority_vote(spark, sf):
    return K.majority(_evidence(spark, sf), 0.5)


@query(f"""WITH n AS (SELECT key, value, sum({_W} * confidence) AS score, sum({_W}) AS weight FROM ({_EV}) GROUP BY 1, 2), t AS (SELECT *, sum(score) OVER (PARTITION BY key) AS total, row_number() OVER (PARTITION BY key ORDER BY round(score, 6) DESC, value) AS r FROM n)
SELECT key, value, round(score / total, 4) AS share, round(score / total, 6) >= 0.5 AND round(score / weight, 6) >= 0.95 AS accepted FROM t WHERE r = 1""")
def weighted_consensus(spark, sf):
    return K.weighted(_evidence(spark, sf), _weight(), 0.95)


@query(f"""SELECT key, count(DISTINCT tier) AS tiers, round(sum({_W} * confidence) / sum({_W}), 6) AS confidence, count(DISTINCT tier) >= 2 AND round(sum({_W} * confidence) / sum({_W}), 6) >= 0.95 AS accepted,
CASE WHEN round(sum({_W} * confidence) / sum({_W}), 6) >= 0.97 THEN 'auto' WHEN round(sum({_W} * confidence) / sum({_W}), 6) >= 0.95 THEN 'verifier' ELSE 'review' END AS route FROM ({_EV}) GROUP BY 1""")
def evidence_gate_and_routing(spark, sf):
    return K.routed(K.tier_gate(_evidence(spark, sf), _weight(), 2, 0.95), "confidence", 0.97, 0.95)


@query(f"""SELECT value, count(DISTINCT source) AS sources, (CASE WHEN count(DISTINCT source) >= 4 THEN 0.95 WHEN count(DISTINCT source) = 3 THEN 0.85 WHEN count(DISTINCT source) = 2 THEN 0.7 ELSE 0.5 END)::DOUBLE AS confidence FROM ({_EV}) GROUP BY 1""")
def source_count_confidence(spark, sf):
    g = _evidence(spark, sf).groupBy("value").agg(F.count_distinct("source").alias("sources"))
    return g.withColumn("confidence", T.source_confidence(F.col("sources")))


@query("""SELECT round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 2) AS percent, CASE WHEN 100.0 * count(*) FILTER (WHERE quality = 1) / count(*) > 90 THEN 'healthy' WHEN 100.0 * count(*) FILTER (WHERE quality = 1) / count(*) > 70 THEN 'fair' ELSE 'poor' END AS band FROM labels""")
def health_score(spark, sf):
    p = F.count_if(F.col("quality") == 1) * 100.0 / F.count(F.lit(1))
    return load(spark, sf, "labels").agg(F.round(p, 2).alias("percent"), K.health_band(p).alias("band"))


_GP = "SELECT toxic::VARCHAR AS gold, (regexp_matches(text, 'idiot|stupid|trash'))::INTEGER::VARCHAR AS pred FROM documents JOIN labels USING (doc_id)"


def _pairs(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text").join(load(spark, sf, "labels"), "doc_id")
    return d.select(F.col("toxic").cast("string").alias("gold"), F.col("text").rlike("idiot|stupid|trash").cast("int").cast("string").alias("pred"))


@query(f"SELECT gold, pred, count(*) AS n FROM ({_GP}) GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return E.confusion(_pairs(spark, sf))


@query(f"""WITH p AS ({_GP}), t AS (SELECT DISTINCT unnest([gold, pred]) AS tag FROM p), c AS (SELECT tag, count(*) FILTER (WHERE gold = tag AND pred = tag) AS hit, count(*) FILTER (WHERE gold = tag) AS g, count(*) FILTER (WHERE pred = tag) AS q FROM t, p GROUP BY 1),
r AS (SELECT tag, CASE WHEN q > 0 THEN hit / q ELSE 0 END AS a, CASE WHEN g > 0 THEN hit / g ELSE 0 END AS b FROM c) SELECT tag, round(a, 4) AS precision, round(b, 4) AS recall, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END, 4) AS f1 FROM r""")
def per_tag_scores(spark, sf):
    return E.per_tag(_pairs(spark, sf))


_ENDS = "SELECT DISTINCT id, sum(len(x)) OVER (PARTITION BY id ORDER BY pos) AS e FROM (SELECT id, unnest({0}) AS x, unnest(range(len({0}))) AS pos FROM s)"


@query(f"""WITH s AS (SELECT doc_id AS id, string_split(text, ' ') AS g, string_split(text, 'e ') AS p FROM documents), g AS ({_ENDS.format('g')}), p AS ({_ENDS.format('p')}),
n AS (SELECT id, count(g.e) AS ng, count(p.e) AS np, count(CASE WHEN g.e IS NOT NULL AND p.e IS NOT NULL THEN 1 END) AS met FROM g FULL JOIN p USING (id, e) GROUP BY 1)
SELECT id, round(met / np, 4) AS precision, round(met / ng, 4) AS recall, g = p AS exact FROM s JOIN n USING (id)""")
def boundary_scores(spark, sf):
    return boundary_scores_whole(spark, sf)


@query()
def boundary_scores_whole(spark, sf):
    s = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.split("text", " ").alias("gold"), F.split("text", "e ").alias("pred"))
    return E.boundary_scores(s)


@query("""SELECT b, c, round(greatest(abs(b - c) - 1, 0) ** 2 / (b + c), 4) AS chi2 FROM (SELECT count(*) FILTER (WHERE f AND NOT s) AS b, count(*) FILTER (WHERE s AND NOT f) AS c FROM (SELECT l_quantity > 25 AS f, l_discount > 0.05 AS s FROM lineitem))""")
def mcnemar_test(spark, sf):
    return E.mcnemar(load(spark, sf, "lineitem").select((F.col("l_quantity") > 25).alias("first"), (F.col("l_discount") > 0.05).alias("second")))


_GRAMS = {
    "word": "SELECT conv_id, turn, k, list_transform(range(1, len({0}) - k + 2), lambda i: array_to_string({0}[i : i + k - 1], chr(1))) AS l FROM w, (SELECT unnest(range(1, 5)) AS k)",
    "char": "SELECT conv_id, turn, k, list_transform(range(1, len({0}) - k + 2), lambda i: substring({0}, i, k)) AS l FROM t, (SELECT unnest(range(1, 7)) AS k)",
}


def _met(kind: str, h: str, r: str) -> str:
    """SQL: n-grams of hypothesis and reference and how many are met, for each pair and order."""
    one = lambda c: f"SELECT conv_id, turn, k, x, count(*) AS n FROM (SELECT conv_id, turn, k, unnest(l) AS x FROM ({_GRAMS[kind].format(c)})) GROUP BY ALL"
    return f"SELECT conv_id, turn, k, coalesce(sum(a.n), 0) AS nh, coalesce(sum(b.n), 0) AS nr, coalesce(sum(least(a.n, b.n)) FILTER (WHERE a.n IS NOT NULL AND b.n IS NOT NULL), 0) AS met FROM ({one(h)}) AS a FULL JOIN ({one(r)}) AS b USING (conv_id, turn, k, x) GROUP BY ALL"


_PAIRS = """SELECT conv_id, turn, lower(output) AS h, lower(instruction) AS r FROM (SELECT conv_id, turn, text AS instruction, role, lead(text) OVER w AS output, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant' AND len(output) >= 5"""


@query(f"""WITH t AS ({_PAIRS}), w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(h, '\\s+'), lambda x: x <> '') AS h, list_filter(regexp_split_to_array(r, '\\s+'), lambda x: x <> '') AS r FROM t),
b AS (SELECT conv_id, turn, exp(sum(CASE WHEN nh > 0 THEN ln((met + 1) / (nh + 1)) ELSE 0 END) / 4) AS p FROM ({_met('word', 'h', 'r')}) GROUP BY 1, 2),
c AS (SELECT conv_id, turn, sum(CASE WHEN nh > 0 THEN met / nh ELSE 0 END) / 6 AS p, sum(CASE WHEN nh > 0 AND nr > 0 THEN met / nr ELSE 0 END) / 6 AS q FROM ({_met('char', 'h', 'r')}) GROUP BY 1, 2)
SELECT conv_id, turn, round(CASE WHEN len(w.h) = 0 THEN 0.0 ELSE coalesce(b.p, 1.0) * least(1.0, exp(1 - len(w.r) / len(w.h))) END, 4) AS bleu, round(CASE WHEN coalesce(c.p + c.q, 0) = 0 THEN 0.0 ELSE 10 * c.p * c.q / (9 * c.p + c.q) END, 4) AS chrf FROM t JOIN w USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn) LEFT JOIN c USING (conv_id, turn)""")
def translation_metrics(spark, sf):
    from heddle.functions.arrow import chrf, pair_metric, sentence_bleu
    from heddle.operators.datasets import instruction_pairs

    p = instruction_pairs(load(spark, sf, "conversations"))
    return p.select("conv_id", "turn", pair_metric(sentence_bleu)("output", "instruction").alias("bleu"), pair_metric(chrf)("output", "instruction").alias("chrf"))


@query("""SELECT source, count(*) FILTER (WHERE contains(text, chr(65533))) AS broken, count(*) FILTER (WHERE regexp_matches(text, '<[a-z]+>')) AS markup, count(*) FILTER (WHERE regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) AS controls, count(*) AS n FROM documents GROUP BY 1""")
def encoding_audit(spark, sf):
    c = F.col("text")
    return load(spark, sf, "documents").groupBy("source").agg(F.count_if(c.contains("�")).alias("broken"), F.count_if(c.rlike("<[a-z]+>")).alias("markup"), F.count_if(c.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")).alias("controls"), F.count(F.lit(1)).alias("n"))

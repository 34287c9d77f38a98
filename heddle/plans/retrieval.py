"""Queries of hybrid search, evidence, contexts, vectors, graphs, and evaluation of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import corpus as C
from heddle.operators import search as S
from heddle.plans.fragments import D, TOK, sql_list
from heddle.plans.registry import query
from heddle.tables import load

_ASKED = ("small ring", "small", "ring")
_WAYS = "SELECT '{t}' AS table_name, id, CASE " + " ".join(f"WHEN {how} THEN {k}" for k, how in enumerate([f"a = '{t}'" for t in _ASKED] + [f"b = '{t}'" for t in _ASKED] + [f"starts_with(a, '{t}')" for t in _ASKED] + [f"contains(a, '{t}')" for t in _ASKED] + [" OR ".join(f"contains(a, '{t}') OR contains(b, '{t}')" for t in _ASKED[1:])])) + " END AS rank FROM ({q})"
_NEAR = "list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v)))"


@query(rf"""WITH d AS ({D}), tot AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d), tf AS (SELECT term, doc_id, length, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d) WHERE term IN ('public', 'license') GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), bm AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 4) AS score FROM tf JOIN df USING (term), tot GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20),
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), vec AS (SELECT e.vec_id, round({_NEAR}, 4) AS score FROM e JOIN e AS q ON q.vec_id = 20 AND e.vec_id <> 20 ORDER BY score DESC, vec_id LIMIT 40),
h AS ({_WAYS.format(t='part', q="SELECT p_partkey AS id, lower(p_name) AS a, lower(p_type) AS b FROM part")} UNION ALL {_WAYS.format(t='supplier', q="SELECT s_suppkey AS id, lower(s_name) AS a, lower(s_name) AS b FROM supplier")}),
x AS (SELECT table_name, id, [1.0, .95, .95, 1.0, .95, .95, .9, .855, .855, .7, .665, .665, .6][rank + 1]::DOUBLE AS score, ['exact', 'exact', 'exact', 'second', 'second', 'second', 'prefix', 'prefix', 'prefix', 'contains', 'contains', 'contains', 'any'][rank + 1] AS way FROM h WHERE rank IS NOT NULL
UNION ALL SELECT 'document', doc_id, round(0.75 + 0.2 * score / (SELECT max(score) FROM bm), 4), 'text' FROM bm UNION ALL SELECT 'vector', vec_id, score, 'vector' FROM vec)
SELECT * FROM x ORDER BY score DESC, table_name, id LIMIT 300""")
def hybrid_search(spark, sf):
    """Parts and suppliers by name, documents by BM25 over all of them, vectors by cosine to one of them."""
    tables = {"part": (load(spark, sf, "part"), "p_partkey", "p_name", "p_type"), "supplier": (load(spark, sf, "supplier"), "s_suppkey", "s_name", "s_name")}
    terms = spark.createDataFrame([(1, "public"), (1, "license")], "query_id int, term string")
    text = S.bm25(C.tokenized(load(spark, sf, "documents")), terms, 20).select(F.lit("document").alias("table_name"), F.col("doc_id").alias("id"), "score")
    e = load(spark, sf, "embeddings")
    dense = S.nearest(e, e.where("vec_id = 20"), 40, -1.0).select(F.lit("vector").alias("table_name"), F.col("neighbour_id").alias("id"), "score")
    return S.hybrid(tables, "small ring", 300, [], text, dense)


@query(rf"""WITH q AS (SELECT item_id AS query_id, list_distinct({TOK.format("text")}) AS words FROM benchmark), o AS (SELECT query_id, unnest(words) AS word FROM q), d AS ({D}),
n AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(t) AS word FROM d) GROUP BY 1),
t1 AS (SELECT DISTINCT p_partkey AS item, p_name AS evidence, unnest({TOK.format("p_name")}) AS word FROM part), t2 AS (SELECT 0::BIGINT AS item, n::VARCHAR || ' in ' || docs::VARCHAR AS evidence, word FROM n WHERE n < 40),
t3 AS (SELECT DISTINCT doc_id AS item, coalesce(source, '') AS evidence, unnest(t) AS word FROM d),
top AS (SELECT *, row_number() OVER (PARTITION BY tier, word ORDER BY item, evidence) AS r FROM (SELECT 1 AS tier, * FROM t1 UNION ALL SELECT 2, * FROM t2 UNION ALL SELECT 3, * FROM t3) QUALIFY r <= 3),
a AS (SELECT query_id, tier, o.word, item, evidence FROM o JOIN top USING (word)), s AS (SELECT query_id, tier, count(*) AS n FROM a GROUP BY ALL)
SELECT query_id, ['name', 'count', 'document'][tier] AS tier, word, item, evidence, [0.95, 0.85, 0.75][tier]::DOUBLE AS confidence FROM a WHERE (SELECT coalesce(sum(n), 0) FROM s WHERE s.query_id = a.query_id AND s.tier < a.tier) < 8""")
def tiered_evidence(spark, sf):
    """Evidence for the words of each benchmark item: names of parts, then counts of rare words, then documents, until eight rows are found."""
    d = C.tokenized(load(spark, sf, "documents"), "source")
    n = d.select("doc_id", F.explode("tokens").alias("word")).groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    names = load(spark, sf, "part").select(F.explode(F.array_distinct(T.tokens(F.col("p_name")))).alias("word"), F.col("p_partkey").alias("item"), F.col("p_name").alias("evidence"))
    counts = n.where("n < 40").select("word", F.lit(0).cast("long").alias("item"), F.concat(F.col("n").cast("string"), F.lit(" in "), F.col("docs").cast("string")).alias("evidence"))
    texts = d.select(F.explode(F.array_distinct("tokens")).alias("word"), F.col("doc_id").alias("item"), F.coalesce("source", F.lit("")).alias("evidence"))
    asked = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("words"))
    return S.tiered(asked, [("name", names, 0.95), ("count", counts, 0.85), ("document", texts, 0.75)], 8)


@query(f"""WITH RECURSIVE d AS ({D}), b AS (SELECT word, next, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i])) AS word, unnest(list_transform(range(1, len(t)), lambda i: t[i + 1])) AS next FROM d) GROUP BY 1, 2),
m AS (SELECT word, next FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, next) AS r FROM b) WHERE r = 1), c AS (SELECT 'the' AS word, ['the'] AS chain, 0 AS i UNION ALL SELECT next, list_append(chain, next), i + 1 FROM c JOIN m USING (word) WHERE i < 19 AND NOT list_contains(chain, next))
SELECT i AS at, word FROM c""")
def completion_chain(spark, sf):
    b = C.ngram_counts(C.tokenized(load(spark, sf, "documents")), 2).select(F.split("gram", " ")[0].alias("word"), F.split("gram", " ")[1].alias("next"), F.col("count").alias("n")).cache()
    chain = S.completion_chain(b, "the")
    b.unpersist()
    return spark.createDataFrame(list(enumerate(chain)), "at int, word string")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, n, string_agg('[' || k || '] ' || l_linenumber || ' ' || l_returnflag, chr(10) ORDER BY k) AS context FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS k FROM r WHERE r <= 3) JOIN n USING (l_orderkey) GROUP BY 1, 2""")
def evidence_context(spark, sf):
    """The three dearest lines of each order as numbered blocks, in the order of their numbers."""
    li = load(spark, sf, "lineitem")
    item = F.struct("l_linenumber", F.concat_ws(" ", F.col("l_linenumber").cast("string"), "l_returnflag").alias("text"))
    pack = S.evidence_pack(li, "l_orderkey", [F.desc("l_extendedprice"), F.asc("l_linenumber")], item, 3)
    return pack.select("l_orderkey", "n").join(S.context_blocks(pack, "l_orderkey"), "l_orderkey")


_DIMS = ", ".join(f"round(len(list_filter(w, lambda x: (ascii(x) * 31 + len(x)) % 8 = {j})) / greatest(len(w), 1), 4) AS e{j}" for j in range(8))


def _hashed_words(c):
    """Shares of a chunk's words by hash: a stated embedding without a model."""
    return F.expr("transform(sequence(0, 7), j -> size(filter(w, x -> (ascii(x) * 31 + length(x)) % 8 = j)) / greatest(size(w), 1))".replace("w,", "regexp_extract_all(lower(chunk), '[a-z]+', 0),").replace("size(w)", "size(regexp_extract_all(lower(chunk), '[a-z]+', 0))"))


@query(f"""WITH c AS (SELECT doc_id, unnest(range(0, (len(t) - 1) // 400 + 1)) AS i, t FROM (SELECT doc_id, lang || ': ' || text AS t FROM documents)), x AS (SELECT doc_id, i, substring(t, i * 400 + 1, 400) AS chunk FROM c), v AS (SELECT *, left(sha256('m:' || doc_id || ':' || i || ':' || chunk), 32) AS vector_id FROM x)
SELECT vector_id, doc_id, i::INTEGER AS at, {_DIMS} FROM (SELECT *, regexp_extract_all(lower(chunk), '[a-z]+') AS w FROM v) WHERE doc_id % 4 <> 0""")
def vector_build(spark, sf):
    """Template, chunks, ids, embeddings of chunks; what is stored already is left out. The embedding is a parameter."""
    d = load(spark, sf, "documents")
    chunk = F.expr("transform(sequence(0, cast((length(__text) - 1) div 400 as int)), i -> substring(__text, i * 400 + 1, 400))")
    build = lambda rows, stored: S.vector_rows(rows, stored, F.concat("lang", F.lit(": "), "text"), chunk, "m", _hashed_words)
    none = spark.createDataFrame([], "vector_id string")
    have = build(d.where("doc_id % 4 = 0"), none).select("vector_id")
    return build(d, have).select("vector_id", "doc_id", "at", *[F.round(F.col("embedding")[j], 4).alias(f"e{j}") for j in range(8)])


@query("""SELECT DISTINCT 'nation' AS type, n_name AS label, '' AS source, n_nationkey::VARCHAR AS source_id, CASE WHEN n_nationkey % 2 = 0 THEN 2 WHEN n_nationkey % 3 = 0 THEN 1 ELSE 1 END AS version FROM nation""")
def graph_node_upsert(spark, sf):
    n = load(spark, sf, "nation").select(F.lit("nation").alias("type"), F.col("n_name").alias("label"), F.lit(None).cast("string").alias("source"), F.col("n_nationkey").alias("source_id"))
    first = S.node_upsert(n.where("source_id % 2 = 0 or source_id % 3 = 0").withColumn("version", F.lit(1)), n.where("source_id % 2 = 0"))
    return S.node_upsert(first, n.where("source_id % 2 <> 0 and source_id % 3 <> 0"))


@query(f"""WITH d AS ({D}), e AS (SELECT doc_id, t, unnest(list_filter(range(2, len(t)), lambda i: t[i] IN ('is', 'was', 'est'))) AS i FROM d WHERE len(t) >= 3) SELECT DISTINCT doc_id, t[i - 1] AS subject, t[i] AS predicate, t[i + 1] AS object FROM e""")
def triple_extraction(spark, sf):
    return S.triples(C.tokenized(load(spark, sf, "documents")), ["is", "was", "est"])


@query("""SELECT l_orderkey AS claim, l_returnflag || ':' || l_linestatus AS fact, count(DISTINCT l_linenumber) AS evidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (3, 5) GROUP BY ALL""")
def affected_claims(spark, sf):
    """Claims, links and evidence of the subjects that changed."""
    c = load(spark, sf, "customer").where(F.col("c_nationkey").isin(3, 5)).select("c_custkey")
    o = load(spark, sf, "orders").join(c, F.expr("o_custkey = c_custkey"), "left_semi").select("o_orderkey")
    li = load(spark, sf, "lineitem").join(o, F.expr("l_orderkey = o_orderkey"))
    return li.groupBy(F.col("l_orderkey").alias("claim"), F.concat_ws(":", "l_returnflag", "l_linestatus").alias("fact")).agg(F.count_distinct("l_linenumber").alias("evidence"))


@query("""SELECT event_id, o_orderkey FROM events JOIN orders ON o_orderkey = event_id WHERE event_type <> 'view' ORDER BY value DESC, ts, event_id LIMIT 40""")
def queue_with_signal(spark, sf):
    e = load(spark, sf, "events").where("event_type <> 'view'")
    return e.join(load(spark, sf, "orders"), F.expr("o_orderkey = event_id")).orderBy(F.desc("value"), "ts", "event_id").limit(40).select("event_id", "o_orderkey")


@query("""SELECT doc_id, promoted, confidence FROM (SELECT l_orderkey AS doc_id, min(w) >= 1 AS promoted, round(avg((w >= 2)::INTEGER), 4) AS confidence FROM (SELECT l_orderkey, l_linenumber, sum((l_quantity > 10)::INTEGER + (l_discount > 0.02)::INTEGER) AS w FROM lineitem GROUP BY 1, 2) GROUP BY 1)""")
def paragraph_witnesses(spark, sf):
    """A group is promoted if each of its lines has a witness; its confidence is the share of lines with two."""
    w = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum((F.col("l_quantity") > 10).cast("int") + (F.col("l_discount") > 0.02).cast("int")).alias("w"))
    return w.groupBy(F.col("l_orderkey").alias("doc_id")).agg((F.min("w") >= 1).alias("promoted"), F.round(F.avg((F.col("w") >= 2).cast("int")), 4).alias("confidence"))


@query("""SELECT 'part' AS word, 'orders' AS source, count(*) AS n FROM orders WHERE contains(o_orderpriority, 'HIGH') UNION ALL SELECT 'part', 'types', count(*) FROM part WHERE contains(p_type, 'BRASS') UNION ALL SELECT 'part', 'by reference', count(*) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 7""")
def multi_source_evidence(spark, sf):
    n = F.count(F.lit(1)).alias("n")
    one = lambda df, s: df.agg(n).select(F.lit("part").alias("word"), F.lit(s).alias("source"), "n")
    part = load(spark, sf, "part")
    j = load(spark, sf, "lineitem").join(part.where("p_size = 7").select("p_partkey"), F.expr("l_partkey = p_partkey"))
    return one(load(spark, sf, "orders").where(F.col("o_orderpriority").contains("HIGH")), "orders").unionByName(one(part.where(F.col("p_type").contains("BRASS")), "types")).unionByName(one(j, "by reference"))


_W = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> '')"


@query(f"""WITH p AS (SELECT conv_id, turn, text AS q, output AS a FROM (SELECT *, lead(text) OVER w AS output, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant' AND len(output) >= 5),
e AS (SELECT conv_id, turn, unnest({_W.format('a')}) AS w, q FROM p) SELECT conv_id, turn, round(avg(list_contains({_W.format('q')}, w)::INTEGER), 4) AS recall FROM e GROUP BY 1, 2""")
def answer_term_recall(spark, sf):
    """Share of the answer's terms that the question holds; repeated terms count each time."""
    from heddle.operators.datasets import instruction_pairs

    p = instruction_pairs(load(spark, sf, "conversations"))
    a, q = T.words(F.col("output")), T.words(F.col("instruction"))
    return p.select("conv_id", "turn", F.round(F.size(F.filter(a, lambda x: F.array_contains(q, x))) / F.size(a), 4).alias("recall")).where("recall is not null")


@query("""WITH s AS (SELECT (l_discount > 0.05) AS gold, (l_tax > 0.04) AS pred FROM lineitem), c AS (SELECT count(*) FILTER (WHERE gold AND pred) AS tp, count(*) FILTER (WHERE gold) AS g, count(*) FILTER (WHERE pred) AS p, count(*) FILTER (WHERE gold = pred) AS same, count(*) AS n FROM s)
SELECT round(tp / p, 4) AS precision, round(tp / g, 4) AS recall, round(2 * tp / (p + g), 4) AS f1, round(same / n, 4) AS accuracy FROM c""")
def error_detection_scores(spark, sf):
    """Precision, recall and F1 of flagged sentences, and accuracy against gold."""
    g, p = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    c = load(spark, sf, "lineitem").agg(F.count_if(g & p).alias("tp"), F.count_if(g).alias("g"), F.count_if(p).alias("p"), F.count_if(g == p).alias("same"), F.count(F.lit(1)).alias("n"))
    return c.select(F.round(F.col("tp") / F.col("p"), 4).alias("precision"), F.round(F.col("tp") / F.col("g"), 4).alias("recall"), F.round(2 * F.col("tp") / (F.col("p") + F.col("g")), 4).alias("f1"), F.round(F.col("same") / F.col("n"), 4).alias("accuracy"))


_STOP = ["with", "that", "this", "from", "dans", "pour"]


@query(f"""WITH e AS (SELECT conv_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}'))) AS term FROM conversations), n AS (SELECT conv_id, term, count(*) AS n FROM e WHERE term NOT IN {sql_list(_STOP)} GROUP BY 1, 2),
k AS (SELECT conv_id, list(term ORDER BY term) AS t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, term) AS r FROM n) WHERE r <= 20 GROUP BY 1),
a AS (SELECT conv_id, p, coalesce(t, []) AS t FROM (SELECT conv_id, list(DISTINCT role) AS p FROM conversations GROUP BY 1) LEFT JOIN k USING (conv_id)), o AS (SELECT p AS q, t AS u FROM a WHERE conv_id = 0)
SELECT conv_id AS id, coalesce(round(len(list_intersect(t, u)) / nullif(len(list_distinct(t || u)), 0), 4), 0)::DOUBLE AS topic_similarity, coalesce(round(len(list_intersect(p, q)) / nullif(len(list_distinct(p || q)), 0), 4), 0)::DOUBLE AS participant_overlap, array_to_string(list_sort(list_intersect(t, u)), ' ') AS shared FROM a, o WHERE conv_id <> 0""")
def discussion_similarity(spark, sf):
    """All discussions against the first one."""
    return S.like_discussion(load(spark, sf, "conversations"), 0, _STOP)


_RELEVANCE = """(CASE WHEN coalesce({c}, '') = '' THEN 0.0 WHEN {c} = '{q}' THEN 1.0 WHEN starts_with({c}, '{q}') THEN 0.85 WHEN share > 0 THEN round(least(1.0, share * 0.7 + least(1.0, 0.5 + 0.5 * {k}.0 / len(t)) * 0.3), 4) WHEN contains({c}, '{q}') THEN 0.5 ELSE 0.0 END)::DOUBLE"""


@query(f"""WITH d AS (SELECT p_partkey AS id, p_name AS source_term, p_type AS target_term, lower(p_name) AS n, list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda x: x <> '') AS t FROM part), s AS (SELECT *, list_contains(t, 'ring')::INTEGER / 1 AS share FROM d WHERE contains(n, 'ring'))
SELECT id, source_term, target_term, {_RELEVANCE.format(c="n", q="ring", k=1)} AS relevance FROM s ORDER BY relevance DESC, id LIMIT 10""")
def cross_lingual_search(spark, sf):
    """The dictionary of the source language answers; here names to types, and back."""
    p = load(spark, sf, "part")
    books = {"name": p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("headword"), F.col("p_type").alias("meaning")), "type": p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("headword"), F.col("p_name").alias("meaning"))}
    return S.cross_lingual(books, "Ring", "name")


@query(f"""WITH d AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type || ' ' || p_brand) AS n FROM part), s AS (SELECT *, (list_contains(t, 'small')::INTEGER + list_contains(t, 'widget')::INTEGER) / 2 AS share FROM (SELECT *, list_filter(regexp_split_to_array(n, '\\s+'), lambda x: x <> '') AS t FROM d) WHERE contains(n, 'small') OR contains(n, 'widget'))
SELECT id, {_RELEVANCE.format(c="n", q="small widget", k=2)} AS relevance FROM s ORDER BY relevance DESC, id LIMIT 25""")
def topical_search(spark, sf):
    return S.topical(load(spark, sf, "part"), "small widget", "p_partkey", ["p_name", "p_type", "p_brand"], 25)

"""Queries of training records and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import exports as X
from heddle.operators.datasets import instruction_pairs
from heddle.plans.discovery import words
from heddle.plans.fragments import D
from heddle.plans.registry import query
from heddle.tables import load

_PAIRS = "p AS (SELECT conv_id, turn, text AS q, output AS a FROM (SELECT *, lead(text) OVER w AS output, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant' AND len(output) >= 5)"


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, '### Instruction:' || chr(10) || q || chr(10) || chr(10) || CASE WHEN turn % 2 = 0 THEN '' ELSE '### Input:' || chr(10) || 'turn ' || turn || chr(10) || chr(10) END || '### Response:' || chr(10) || a AS text FROM p""")
def prompt_template(spark, sf):
    p = instruction_pairs(load(spark, sf, "conversations"))
    context = F.when(F.col("turn") % 2 != 0, F.concat(F.lit("turn "), F.col("turn").cast("string")))
    return p.select("conv_id", "turn", X.prompt(F.col("instruction"), context, F.col("output")).alias("text"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'translate' ELSE 'complete' END AS kind, CASE WHEN doc_id % 3 = 0 THEN source ELSE left(text, 100) END AS question, text AS answer FROM documents""")
def question_answer(spark, sf):
    d = load(spark, sf, "documents")
    qa = X.question_answer(F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.col("text"))
    return d.select("doc_id", qa.alias("x")).select("doc_id", "x.*")


@query("SELECT trim(text) AS text FROM documents WHERE len(trim(text)) > 10")
def plain_texts(spark, sf):
    return X.plain_texts(load(spark, sf, "documents"), "text")


@query(f"""WITH d AS ({D}), u AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(t) AS w FROM d) GROUP BY 1) SELECT word, row_number() OVER (ORDER BY word) - 1 AS at, n, round(n / sum(n) OVER (), 8) AS share FROM u""")
def vocabulary_export(spark, sf):
    return X.vocabulary(words(spark, sf))


@query("""SELECT o_orderkey AS ref, max(o_orderstatus) AS a, max(l_returnflag) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def parallel_alignment(spark, sf):
    a = load(spark, sf, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_orderstatus").alias("text"))
    b = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_returnflag").alias("text"))
    return X.aligned(a, b, "ref", "text")


@query("""WITH p AS (SELECT o_orderstatus AS a, l_returnflag AS b, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 4) AS share FROM p""")
def aligned_pair_counts(spark, sf):
    p = load(spark, sf, "orders").join(load(spark, sf, "lineitem"), F.expr("l_orderkey = o_orderkey")).groupBy(F.col("o_orderstatus").alias("a"), F.col("l_returnflag").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = p.groupBy("a").agg(F.sum("n").alias("all"))
    return p.join(every, "a").select("a", "b", "n", F.round(F.col("n") / F.col("all"), 4).alias("share"))


@query("""SELECT count(*) AS pairs, count(DISTINCT o_orderstatus) AS left_kinds, count(DISTINCT l_returnflag) AS right_kinds, round(avg(l_quantity), 4) AS mean FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def alignment_stats(spark, sf):
    j = load(spark, sf, "orders").join(load(spark, sf, "lineitem"), F.expr("l_orderkey = o_orderkey"))
    kinds = j.groupBy("o_orderstatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return kinds.agg(F.sum("n").alias("pairs"), F.count_distinct("o_orderstatus").alias("left_kinds"), F.count_distinct("l_returnflag").alias("right_kinds"), F.round(F.sum("q") / F.sum("n"), 4).alias("mean"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE text END AS k FROM documents""")
def group_keys(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", X.group_key(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit(""), text=F.col("text")).alias("k"))


@query(f"""WITH {_PAIRS} SELECT q AS prompt, CASE WHEN turn % 3 = 0 THEN a ELSE q END AS chosen, CASE WHEN turn % 3 = 0 THEN q ELSE a END AS rejected FROM p WHERE turn % 3 < 2 AND a <> q""")
def preference_pairs(spark, sf):
    p = instruction_pairs(load(spark, sf, "conversations")).withColumn("choice", F.expr("element_at(array(' A', 'b', 'none'), cast(turn % 3 + 1 as int))"))
    return X.preferences(p, "instruction", "output", "instruction", "choice")


@query("""SELECT event_id AS id, '{"id":' || event_id || ',"text":"' || event_type || '"}' AS line FROM events WHERE user_id % 2 = 0 AND value >= 0.5""")
def feedback_export(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr("if(user_id % 2 = 0, 'approved', 'open')").alias("status"), F.col("value").alias("confidence"), F.col("event_type").alias("text"))
    return X.feedback(e, 0.5)


_HEX = "('0x' || substring(md5(doc_id::VARCHAR), {}, 8))::BIGINT"


@query(f"""WITH s AS (SELECT doc_id, CASE WHEN {_HEX.format(1)} % 1000 < 900 THEN 'train' ELSE 'validation' END AS split FROM documents WHERE len(text) > 100), n AS (SELECT split, ceil(count(*) / 32)::BIGINT AS batches FROM s GROUP BY 1)
SELECT doc_id, split, {_HEX.format(9)} % batches AS batch FROM s JOIN n USING (split)""")
def training_stream(spark, sf):
    return X.training_batches(load(spark, sf, "documents").where(F.length("text") > 100).select("doc_id"), "doc_id", 32, 0.9)


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents WHERE len(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 8 AND NOT regexp_matches(lower(text), 'idiot|moron')""")
def monolingual_builder(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", T.collapse(F.col("text")).alias("text"))
    return d.where((F.length("text") >= 8) & ~F.lower("text").rlike("idiot|moron"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), ' not ') THEN 'negation' WHEN contains(lower(text), ' if ') THEN 'condition' WHEN contains(lower(text), ' with ') THEN 'company' END AS label FROM documents WHERE contains(lower(text), ' not ') OR contains(lower(text), ' if ') OR contains(lower(text), ' with ')""")
def grammar_subset(spark, sf):
    low = F.lower("text")
    label = F.when(low.contains(" not "), "negation").when(low.contains(" if "), "condition").when(low.contains(" with "), "company")
    return load(spark, sf, "documents").select("doc_id", label.alias("label")).where("label is not null")


@query("""SELECT lang, source, text FROM (SELECT lang, source, text, row_number() OVER (PARTITION BY md5(text || '|' || lang) ORDER BY doc_id) AS r FROM documents WHERE lang = 'en') WHERE r = 1""")
def filtered_table_export(spark, sf):
    """One batch without its metadata columns, once for each content."""
    d = load(spark, sf, "documents").where("lang = 'en'").withColumn("h", F.md5(F.concat("text", F.lit("|"), "lang")))
    first = d.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    return d.join(first, ["h", "doc_id"], "left_semi").select("lang", "source", "text")


@query("""SELECT user_id, count(*) AS reviews, round(avg((event_id % 6 >= 3)::INTEGER), 4) AS success, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15') AS due FROM events GROUP BY 1""")
def learner_statistics(spark, sf):
    e = load(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg((F.col("event_id") % 6 >= 3).cast("int")), 4).alias("success"), F.count_if(F.col("ts") <= F.lit("2024-01-15").cast("timestamp")).alias("due"))

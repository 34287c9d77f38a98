"""Queries of lexical mining, incremental work and scalar conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions.arrow import chunker, markdown_blocks
from heddle.functions.linguistic import over_texts, rule_matches
from heddle.operators import corpus as C
from heddle.operators import lexical as X
from heddle.operators import rows
from heddle.plans.fragments import DE, EN, FR, TOK, TOKENS, D, sql_list
from heddle.plans.registry import query
from heddle.tables import load


def tokenized(spark, sf, *also):
    return C.tokenized(load(spark, sf, "documents"), *also)


_KNOWN = f"SELECT unnest({EN}) AS word, 1.0 AS weight UNION ALL SELECT unnest({FR}), 0.5"


def known_words(spark):  # a short fixed list
    return spark.createDataFrame([(w, 1.0) for w in EN] + [(w, 0.5) for w in FR], "word string, weight double")


@query(f"""WITH d AS ({D}), e AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(t) AS word FROM d) WHERE len(word) >= 2), k AS (SELECT word, max(weight)::DOUBLE AS weight FROM ({_KNOWN}) GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n, count(weight) AS attested, round(sum(coalesce(weight, 0.0)) / count(*), 4) AS score FROM e LEFT JOIN k USING (word) GROUP BY 1)
SELECT *, CASE WHEN score >= 0.8 THEN 'PASS' WHEN score >= 0.5 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM g""")
def sentence_attestation(spark, sf):
    return X.attestation(tokenized(spark, sf), known_words(spark))


@query(f"""WITH d AS ({D}) SELECT DISTINCT word, lang AS source FROM (SELECT lang, unnest(t) AS word FROM d) WHERE lang IN ('en', 'fr')""")
def attestation_index(spark, sf):
    d = tokenized(spark, sf, "lang").select("lang", F.explode("tokens").alias("word"))
    return X.attestation_index({k: d.where(F.col("lang") == k) for k in ("en", "fr")})


def _share(words):
    return f"len(list_intersect(t, {words})) / {len(words)}"


@query(f"""WITH d AS ({D}), s AS (SELECT doc_id, {_share(EN)} AS a, {_share(FR)} AS b, {_share(DE)} AS c FROM d) SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'none' WHEN a = greatest(a, b, c) THEN 'en' WHEN b = greatest(a, b, c) THEN 'fr' ELSE 'de' END AS topic FROM s""")
def topic_classifier(spark, sf):
    return tokenized(spark, sf).select("doc_id", X.topic(F.col("tokens"), {"en": EN, "fr": FR, "de": DE}).alias("topic"))


@query(f"""WITH d AS ({D}), m AS (SELECT doc_id, len(t) AS n, list_sum(list_transform(t, lambda x: len(x))) / len(t) AS mean, len(list_distinct(t)) / len(t) AS variety FROM d), s AS (SELECT *, CASE WHEN mean > 6 THEN 2 WHEN mean > 5 THEN 1 ELSE 0 END + CASE WHEN variety > 0.8 THEN 1 ELSE 0 END AS score FROM m)
SELECT doc_id, CASE WHEN n = 0 THEN 'none' WHEN score >= 3 THEN 'literary' WHEN score >= 2 THEN 'formal' ELSE 'common' END AS register FROM s""")
def register_detector(spark, sf):
    return tokenized(spark, sf).select("doc_id", X.register(F.col("tokens")).alias("register"))


@query("""WITH q AS (SELECT unnest(['a', 'b', 'c', 'zz']) AS word) SELECT word, target, tier FROM q LEFT JOIN (SELECT word, target, tier FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY tier, target) AS r FROM (SELECT left(p_name, 1) AS word, p_name AS target, 1 AS tier FROM part WHERE p_size < 5 UNION ALL SELECT chr(97 + (c_custkey % 3)::INTEGER), c_name, 2 FROM customer)) WHERE r = 1) USING (word)""")
def tiered_translation(spark, sf):
    first = load(spark, sf, "part").where("p_size < 5").select(F.substring("p_name", 1, 1).alias("word"), F.col("p_name").alias("target"))
    second = load(spark, sf, "customer").select(F.char(F.lit(97) + F.col("c_custkey") % 3).alias("word"), F.col("c_name").alias("target"))
    return X.tiered_lookup(spark.createDataFrame([("a",), ("b",), ("c",), ("zz",)], "word string"), [first, second])


@query(f"""WITH l AS (SELECT doc_id, k AS position, {TOK.format('line')} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents)),
s AS (SELECT doc_id, position, round(CASE WHEN lag(t) OVER w IS NULL OR greatest(len(list_distinct(t)), len(list_distinct(lag(t) OVER w))) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(t), list_distinct(lag(t) OVER w))) / greatest(len(list_distinct(t)), len(list_distinct(lag(t) OVER w))) END, 4) AS similarity FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY position))
SELECT doc_id, position, similarity, round(coalesce((lag(similarity) OVER w + lead(similarity) OVER w) / 2 - similarity, 0.0), 6) AS depth FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY position)""")
def segment_depths(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    out = X.segment_depths(d.select("doc_id", "at", T.tokens(F.col("line")).alias("tokens")))
    return out.select("doc_id", F.col("at").alias("position"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("depth"))


@query("""SELECT l_orderkey, md5(l_orderkey::VARCHAR || '|' || l_partkey::VARCHAR || '|' || l_returnflag) AS k FROM lineitem""")
def composite_key_hash(spark, sf):
    return _line_keys(load(spark, sf, "lineitem"))


@query()
def composite_key_hash_whole(spark, sf):
    return _line_keys(load(spark, sf, "lineitem"))


def _line_keys(li):
    return li.select("l_orderkey", F.md5(F.concat(F.col("l_orderkey").cast("string"), F.lit("|"), F.col("l_partkey").cast("string"), F.lit("|"), "l_returnflag")).alias("k"))


@query("""SELECT doc_id, left(sha256('m:documents:' || doc_id || ':' || coalesce(text, '')), 32) AS vector_id FROM documents""")
def vector_ids(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.substring(F.sha2(F.concat(F.lit("m:documents:"), F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), 256), 1, 32).alias("vector_id"))


@query()
def vector_ids_whole(spark, sf):
    """The id covers the whole text, so any edit changes it."""
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.substring(F.sha2(F.concat(F.lit("m:documents:"), F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), 256), 1, 32).alias("vector_id"))


@query("""SELECT user_id, max(ts) AS watermark, greatest(max(ts), TIMESTAMP '2024-01-30') AS effective FROM events GROUP BY 1""")
def watermarks(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("watermark")).withColumn("effective", F.greatest("watermark", F.lit("2024-01-30").cast("timestamp")))


@query("""SELECT event_id FROM events WHERE (props->>'$.k')::BIGINT NOT IN (SELECT p_size FROM part WHERE p_size IS NOT NULL)""")
def prune_stale(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("p_size"))
    return rows.missing_from(e, load(spark, sf, "part"), ["p_size"]).select("event_id")


@query("""SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100""")
def deterministic_sample(spark, sf):
    return load(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(100)


@query("""SELECT l_orderkey AS topic, round(sum(CASE WHEN l_returnflag = 'A' THEN w ELSE 0 END) / sum(w), 6) AS ratio, CASE WHEN round(sum(CASE WHEN l_returnflag = 'A' THEN w ELSE 0 END) / sum(w), 6) >= 0.66 THEN 'majority' ELSE 'split' END AS outcome FROM (SELECT l_orderkey, l_returnflag, l_linenumber * 1.0::DOUBLE AS w FROM lineitem) GROUP BY 1""")
def weighted_agent_vote(spark, sf):
    w = F.col("l_linenumber") * 1.0
    ratio = F.round(F.sum(F.when(F.col("l_returnflag") == "A", w).otherwise(0.0)) / F.sum(w), 6)
    return load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("topic")).agg(ratio.alias("ratio")).withColumn("outcome", F.when(F.col("ratio") >= 0.66, "majority").otherwise("split"))


@query("""SELECT ta AS table_a, round(abs(nb - na) / na, 4) AS drift, abs(nb - na) / na > 0.05 AS failed FROM (SELECT 'orders' AS ta, count(*) FILTER (WHERE o_orderkey % 10 > 0) AS na, count(*) AS nb FROM orders)""")
def regression_check(spark, sf):
    o = load(spark, sf, "orders").agg(F.count_if(F.col("o_orderkey") % 10 > 0).alias("na"), F.count(F.lit(1)).alias("nb"))
    drift = F.abs(F.col("nb") - F.col("na")) / F.col("na")
    return o.select(F.lit("orders").alias("table_a"), F.round(drift, 4).alias("drift"), (drift > 0.05).alias("failed"))


@query(f"""WITH u AS (SELECT w, count(*) AS n FROM (SELECT unnest({TOKENS}) AS w FROM documents) GROUP BY 1) SELECT CASE WHEN n >= 100 THEN 'high' WHEN n >= 10 THEN 'mid' ELSE 'low' END AS band, count(*) AS words, sum(n)::BIGINT AS occurrences FROM u GROUP BY 1""")
def frequency_bands(spark, sf):
    u = C.ngram_counts(tokenized(spark, sf), 1)
    return u.groupBy(F.when(F.col("count") >= 100, "high").when(F.col("count") >= 10, "mid").otherwise("low").alias("band")).agg(F.count(F.lit(1)).alias("words"), F.sum("count").alias("occurrences"))


@query(f"""SELECT term, count(*) AS lines FROM (SELECT unnest(string_split(lower(text), chr(10))) AS line FROM documents), (SELECT unnest(['idiot', 'license', 'les ']) AS term) WHERE contains(line, term) GROUP BY 1""")
def key_term_lines(spark, sf):
    line = load(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), "\n")).alias("line"))
    hit = F.filter(F.array(*map(F.lit, ("idiot", "license", "les "))), lambda t: F.col("line").contains(t))
    return line.select(F.explode(hit).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("lines"))


@query(f"""SELECT doc_id, CASE WHEN n <= 40 THEN 'A1' WHEN n <= 120 THEN 'A2' WHEN n <= 400 THEN 'B1' ELSE 'B2' END AS level FROM (SELECT doc_id, len({TOKENS}) AS n FROM documents)""")
def level_tagger(spark, sf):
    n = F.size("tokens")
    d = tokenized(spark, sf)
    return d.select("doc_id", F.when(n <= 40, "A1").when(n <= 120, "A2").when(n <= 400, "B1").otherwise("B2").alias("level"))


@query()
def chunks(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.posexplode(chunker(1200)("text")).alias("at", "chunk"))


@query()
def markdown_paragraphs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.posexplode(over_texts(markdown_blocks, "array<string>")("text")).alias("at", "block"))


@query()
def rule_audit(spark, sf):
    found = over_texts(lambda t: rule_matches(t, {"doubled": r"\b(\w+) \1\b", "shout": r"!{2,}"}), "array<struct<rule:string,start:int,end:int,context:string>>")
    return load(spark, sf, "documents").select("doc_id", F.explode(found("text")).alias("m")).select("doc_id", "m.*")

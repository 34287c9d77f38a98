"""Queries of corpus statistics over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import corpus as C
from heddle.plans.fragments import D, TOK
from heddle.plans.registry import query
from heddle.tables import load


def docs(spark, sf):
    return C.tokenized(load(spark, sf, "documents"), "text", "source", "lang")


_PAIRS = f"""d AS ({D}), f AS (SELECT w, count(*) AS f FROM (SELECT unnest(t) AS w FROM d) GROUP BY 1), tot AS (SELECT sum(f) AS total FROM f),
p AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM (SELECT unnest(list_zip(t[1:len(t)-1], t[2:])) AS z FROM d WHERE len(t) > 1 UNION ALL SELECT unnest(list_zip(t[1:len(t)-2], t[3:])) FROM d WHERE len(t) > 2) q, LATERAL (SELECT z[1] AS x, z[2] AS y) v WHERE x <> y GROUP BY 1, 2)"""


@query(f"""WITH {_PAIRS}, m AS (SELECT a, b, n, round(log2(n * total / (fa.f * fb.f)), 4) AS pmi FROM p JOIN f fa ON fa.w = a JOIN f fb ON fb.w = b, tot WHERE n >= 5 AND fa.f >= 5 AND fb.f >= 5),
s AS (SELECT a AS word, b AS partner, n, pmi FROM m WHERE pmi > 0 UNION ALL SELECT b, a, n, pmi FROM m WHERE pmi > 0)
SELECT word, partner, n, pmi FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY pmi DESC, partner) AS r FROM s) WHERE r <= 10""")
def collocations_pmi(spark, sf):
    return C.collocations(docs(spark, sf))


@query(f"""WITH {_PAIRS}, s AS (SELECT a AS word, b AS partner, n FROM p UNION ALL SELECT b, a, n FROM p)
SELECT word, partner, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, partner) AS r FROM s) WHERE r <= 5""")
def neighbours_top_k(spark, sf):
    return C.neighbours(docs(spark, sf))


@query(f"""WITH d AS ({D}), e AS (SELECT doc_id, source, unnest(t) AS word FROM d)
SELECT word, count(*) AS frequency, count(DISTINCT doc_id) AS doc_freq, count(DISTINCT source) AS source_count, round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 4) AS diversity FROM e GROUP BY 1""")
def word_stats(spark, sf):
    return C.word_stats(docs(spark, sf))


@query("""WITH e AS (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ɏ]+')) AS form FROM documents), n AS (SELECT lower(form) AS word, form, count(*) AS n FROM e GROUP BY 1, 2)
SELECT word, form, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, form) AS r FROM n) WHERE r <= 10""")
def surface_forms(spark, sf):
    return C.surface_forms(load(spark, sf, "documents"))


@query(f"""WITH d AS ({D}) SELECT gram, count(*) AS count FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM d WHERE len(t) >= 2) GROUP BY 1""")
def bigram_counts(spark, sf):
    return C.ngram_counts(docs(spark, sf), 2)


@query(f"""WITH d AS ({D}) SELECT word, count(*) AS df, round(ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1, 6) AS idf FROM (SELECT doc_id, unnest(list_distinct(t)) AS word FROM d) GROUP BY 1""")
def inverse_document_frequency(spark, sf):
    return C.idf(docs(spark, sf))


@query(f"""WITH d AS ({D}), i AS (SELECT word, round(ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1, 6) AS idf FROM (SELECT doc_id, unnest(list_distinct(t)) AS word FROM d) GROUP BY 1),
tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS word FROM d) WHERE len(word) >= 2 GROUP BY 1, 2), s AS (SELECT doc_id, word, round(tf * idf, 3) AS score FROM tf JOIN i USING (word))
SELECT doc_id, word, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS r FROM s) WHERE r <= 5""")
def top_terms(spark, sf):
    return C.top_terms(docs(spark, sf))


@query(f"""WITH d AS ({D}), s AS (SELECT len(t) AS n, row_number() OVER (ORDER BY len(t)) AS r, count(*) OVER () AS c FROM d)
SELECT count(*) AS records, sum(len(text))::BIGINT AS chars, sum(len(t))::BIGINT AS words, min(len(t)) AS shortest, max(len(t)) AS longest, (SELECT count(DISTINCT w) FROM (SELECT unnest(t) AS w FROM d)) AS distinct_words,
(SELECT n FROM s WHERE r = c // 2 + 1) AS upper_median FROM d""")
def corpus_summary(spark, sf):
    return C.summary(docs(spark, sf))


@query(f"""WITH d AS ({D}) SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(t) AS word FROM d) GROUP BY 1) ORDER BY n DESC, word LIMIT 50""")
def top_words(spark, sf):
    return C.ngram_counts(docs(spark, sf), 1).select(F.col("gram").alias("word"), F.col("count").alias("n")).orderBy(F.desc("n"), F.asc("word")).limit(50)


_PARA = f"SELECT doc_id, {TOK.format('line')} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''"


@query(f"""WITH p AS ({_PARA}), s AS (SELECT doc_id, t[1] AS marker FROM p WHERE len(t) > 0), w AS (SELECT marker, count(*) AS everywhere FROM (SELECT unnest(t) AS marker FROM p) GROUP BY 1),
g AS (SELECT marker, count(*) AS n, count(DISTINCT doc_id) AS docs FROM s GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3), j AS (SELECT marker, n, docs, round((n / (SELECT count(*) FROM s)) / (everywhere / (SELECT sum(everywhere) FROM w)), 4) AS lift FROM g JOIN w USING (marker) WHERE n >= greatest(5, ceil(0.001 * (SELECT count(*) FROM s))))
SELECT marker, n, docs, lift, round(least(1.0, lift / 10), 4) AS confidence FROM j WHERE lift >= 2""")
def paragraph_openers(spark, sf):
    lines = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text")).where(F.trim("text") != "")
    return C.openers(C.tokenized(lines))


@query(f"""WITH d AS ({D}), e AS (SELECT len(t) AS size, unnest(t) AS word, unnest(range(len(t))) AS i FROM d)
SELECT word, count(*) FILTER (WHERE i = 0) AS first, count(*) FILTER (WHERE i > 0 AND i < size - 1) AS middle, count(*) FILTER (WHERE i > 0 AND i = size - 1) AS last FROM e GROUP BY 1""")
def position_histogram(spark, sf):
    return C.position_histogram(docs(spark, sf))


@query(f"""WITH d AS ({D}), e AS (SELECT doc_id, left(text, 200) AS snippet, unnest(list_distinct(t)) AS word FROM d)
SELECT word, doc_id, snippet FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS r FROM e WHERE word IN ('idiot', 'the', 'les', 'und')) WHERE r <= 3""")
def word_contexts(spark, sf):
    return C.contexts(docs(spark, sf), spark.createDataFrame([(w,) for w in ("idiot", "the", "les", "und")], "word string"))


@query(f"""WITH l AS ({_PARA}) SELECT 'line' AS level, count(*) AS n, sum(len(t))::BIGINT AS tokens FROM l UNION ALL SELECT 'document', count(DISTINCT doc_id), sum(len(t))::BIGINT FROM l UNION ALL SELECT 'corpus', 1, sum(len(t))::BIGINT FROM l""")
def hierarchy_layers(spark, sf):
    return C.layers(load(spark, sf, "documents"))


@query(f"""WITH d AS ({D}), b AS (SELECT word, next, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i])) AS word, unnest(list_transform(range(1, len(t)), lambda i: t[i + 1])) AS next FROM d) GROUP BY 1, 2),
u AS (SELECT w AS next, count(*) AS n FROM (SELECT unnest(t) AS w FROM d) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3), q AS (SELECT unnest(['the', 'les', 'zzzz']) AS word),
h AS (SELECT word, next, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, next) AS r FROM b JOIN q USING (word))
SELECT word, next, n FROM h WHERE r <= 3 UNION ALL SELECT word, next, n FROM q, u WHERE word NOT IN (SELECT word FROM h)""")
def next_word_prediction(spark, sf):
    d = docs(spark, sf)
    return C.predict_next(C.ngram_counts(d, 2), C.ngram_counts(d, 1), spark.createDataFrame([("the",), ("les",), ("zzzz",)], "word string"))


@query(f"""WITH d AS ({D}), u AS (SELECT w AS suggestion, count(*) AS n FROM (SELECT unnest(t) AS w FROM d) GROUP BY 1), q AS (SELECT unnest(['idoit', 'thier', 'schien', 'pourr']) AS word)
SELECT word, suggestion, distance FROM (SELECT word, suggestion, levenshtein(word, suggestion) AS distance, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, suggestion), n DESC, suggestion) AS r FROM q JOIN u ON left(word, 2) = left(suggestion, 2) AND regexp_full_match(suggestion, '[a-z]+')) WHERE r <= 3""")
def spell_suggestions(spark, sf):
    lexicon = C.ngram_counts(docs(spark, sf), 1).select(F.col("gram").alias("word"), F.col("count").alias("n")).where(F.col("word").rlike("^[a-z]+$"))
    return C.spell_suggestions(spark.createDataFrame([(w,) for w in ("idoit", "thier", "schien", "pourr")], "word string"), lexicon)


@query(f"""WITH d AS ({D}) SELECT source, count(*) AS records, sum(len(t))::BIGINT AS words, round(avg(len(text)), 2) AS avg_chars, max(len(text)) AS longest FROM d GROUP BY 1""")
def source_stats(spark, sf):
    n = F.size("tokens")
    return docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(n).alias("words"), F.round(F.avg(F.length("text")), 2).alias("avg_chars"), F.max(F.length("text")).alias("longest"))


@query("""SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY 1""")
def language_share(spark, sf):
    d = load(spark, sf, "documents").select("lang")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(d.agg(F.count(F.lit(1)).alias("total")))).select("lang", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


@query("""SELECT doc_id, len(text) - len(replace(text, '.', '')) AS stops, regexp_extract_all(text, '[A-ZÀ-Þ][a-zà-ɏ]+')[1] AS first_name FROM documents""")
def sentence_marks(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", (F.length("text") - F.length(F.replace(F.col("text"), F.lit("."), F.lit("")))).alias("stops"), F.try_element_at(F.regexp_extract_all("text", F.lit("[A-ZÀ-Þ][a-zà-ɏ]+"), F.lit(0)), F.lit(1)).alias("first_name"))



"""Queries of the text functions: cleaning, filters, hashes, deduplication, splits, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import datasets, dedup
from heddle.plans.fragments import DE, EN, FR, TOKENS, sql_list
from heddle.plans.registry import query
from heddle.tables import load


def D(spark, sf, *columns):
    return load(spark, sf, "documents").select("doc_id", *(columns or ("text",)))


_COLLAPSE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_COLLAPSE.format('lower(text)')}) AS h, md5(text) AS raw FROM documents")
def normalised_hash(spark, sf):
    return D(spark, sf).select("doc_id", T.normal_md5(F.col("text")).alias("h"), F.md5("text").alias("raw"))


@query(f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5({_COLLAPSE.format('lower(text)')}) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def exact_dedup(spark, sf):
    return dedup.exact(D(spark, sf), "doc_id", "text").select("doc_id")


@query(f"""WITH d AS (SELECT doc_id, md5({_COLLAPSE.format('lower(text)')}) AS h FROM documents) SELECT min(doc_id) AS doc_id FROM d WHERE doc_id % 3 <> 0 AND h NOT IN (SELECT h FROM d WHERE doc_id % 3 = 0) GROUP BY h""")
def dedup_against_existing(spark, sf):
    d = D(spark, sf)
    return dedup.exact(dedup.not_in(d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 = 0"), "text"), "doc_id", "text").select("doc_id")


@query("""SELECT source, count(*) AS original, count(DISTINCT md5(lower(trim(text)))) AS uniq, count(*) - count(DISTINCT md5(lower(trim(text)))) AS duplicates FROM documents GROUP BY 1""")
def dedup_stats_per_file(spark, sf):
    return dedup.stats(D(spark, sf, "text", "source"), "source", "text")


@query()
def shingle_pairs(spark, sf):
    return dedup.shingle_pairs(D(spark, sf), "doc_id", "text")


@query()
def shingle_pairs_whole(spark, sf):
    return dedup.shingle_pairs(D(spark, sf), "doc_id", "text")


@query()
def minhash_lsh_dedup(spark, sf):
    return dedup.minhash_keep_first(D(spark, sf), "doc_id", "text")


@query(f"""SELECT doc_id, len({TOKENS}) AS n_tokens, sha256(array_to_string({TOKENS}, ' ')) AS tokens_sha256 FROM documents""")
def tokenizer(spark, sf):
    t = T.tokens(F.col("text"))
    return D(spark, sf).select("doc_id", F.size(t).alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("tokens_sha256"))


@query(f"""WITH l AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN {sql_list(EN)}) AS l FROM documents), g AS (SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS p FROM l) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM g) SELECT doc_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS terms FROM r WHERE r <= 6 GROUP BY 1) USING (doc_id)""")
def query_terms(spark, sf):
    return D(spark, sf).select("doc_id", F.coalesce(F.array_join(T.query_tokens(F.col("text"), EN), " "), F.lit("")).alias("terms"))


@query()
def query_terms_whole(spark, sf):
    return D(spark, sf).select("doc_id", F.array_join(T.query_tokens(F.col("text"), EN), " ").alias("terms"))


_HITS = "len(list_filter({t}, lambda x: x IN {words}))"


@query(f"""WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents), s AS (SELECT doc_id, {_HITS.format(t='t', words=sql_list(EN))} AS en, {_HITS.format(t='t', words=sql_list(FR))} AS fr, {_HITS.format(t='t', words=sql_list(DE))} AS de FROM d)
SELECT doc_id, CASE WHEN greatest(en, fr, de) = 0 THEN 'unknown' WHEN en >= fr AND en >= de THEN 'en' WHEN fr >= de THEN 'fr' ELSE 'de' END AS guess FROM s""")
def language_by_markers(spark, sf):
    from heddle.operators.language import by_markers

    return by_markers(D(spark, sf), {"en": EN, "fr": FR, "de": DE})


@query(f"""WITH d AS (SELECT doc_id, len(text) AS n, {TOKENS} AS t FROM documents), m AS (SELECT doc_id, n, CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: x IN {sql_list(EN)})) / len(t) ELSE 0 END AS share, len(list_distinct(list_filter(t, lambda x: x IN {sql_list(EN)}))) AS kinds FROM d)
SELECT doc_id FROM m WHERE kinds >= 2 AND share >= CASE WHEN n > 300 THEN 0.009 ELSE 0.012 END""")
def language_gate(spark, sf):
    from heddle.operators.language import gate

    return gate(D(spark, sf), EN).select("doc_id")


@query(f"""WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents) SELECT doc_id, CASE WHEN len(t) > 0 THEN round((3 * {_HITS.format(t='t', words=sql_list(EN[:4]))} + 2 * {_HITS.format(t='t', words=sql_list(EN[4:9]))} + {_HITS.format(t='t', words=sql_list(EN[9:]))}) / len(t), 5) ELSE 0.0 END AS density FROM d""")
def weighted_density(spark, sf):
    return D(spark, sf).select("doc_id", T.density(T.tokens(F.col("text")), EN[:4], EN[4:9], EN[9:]).alias("density"))


@query(r"""SELECT doc_id, len(text) AS n FROM documents WHERE len(text) BETWEEN 5 AND 5000 AND regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[\x{1000}-\x{109F}]')""")
def validity_filter(spark, sf):
    c = F.col("text")
    return D(spark, sf).where(F.length(c).between(5, 5000) & c.rlike("[A-Za-z]") & ~c.rlike(r"[\x{1000}-\x{109F}]")).select("doc_id", F.length(c).alias("n"))


@query(f"""SELECT doc_id, {_COLLAPSE.format("regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\\s]+|www\\.[^\\s]+', ' ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', ' ', 'g'), '\\+?[0-9][0-9 ()-]{7,}[0-9]', ' ', 'g')")} AS clean FROM documents""")
def contact_removal(spark, sf):
    return D(spark, sf).select("doc_id", T.without_contacts(F.col("text")).alias("clean"))


@query("""SELECT doc_id, translate(text, 'àáâãäåèéêëìíîïòóôõöùúûüýÿÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝŸ', '') AS plain, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM documents""")
def accent_filter_and_slug(spark, sf):
    return D(spark, sf).select("doc_id", T.without_accents(F.col("text")).alias("plain"), T.slug(F.col("text")).alias("slug"))


@query()
def accent_filter_and_slug_whole(spark, sf):
    return D(spark, sf).select("doc_id", T.without_accents(F.col("text")).alias("plain"), T.slug(F.col("text")).alias("slug"))


@query("""SELECT doc_id, coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)licen[sc]e|copyright')), chr(10)), '') AS kept FROM documents""")
def boilerplate_lines(spark, sf):
    return D(spark, sf).select("doc_id", T.without_matching_lines(F.col("text"), "(?i)licen[sc]e|copyright").alias("kept"))


@query("""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR (len(trim(x)) >= 5 AND 1 - len(regexp_replace(x, '[^\\p{L}]', '', 'g')) / len(trim(x)) <= 0.30)), chr(10)) AS kept FROM documents""")
def noisy_lines(spark, sf):
    return D(spark, sf).select("doc_id", T.without_noisy_lines(F.col("text")).alias("kept"))


@query("""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents)
SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE len(string_split(trim(s), ' ')) BETWEEN 10 AND 50) AS fitting FROM s GROUP BY 1""")
def sentence_split(spark, sf):
    s = D(spark, sf).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(F.size(F.split(F.trim("s"), " ")).between(10, 50)).alias("fitting"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_chars, contains(url, 'example.com') AND NOT contains(url, '/fr/') AS allowed FROM pages""")
def html_scan(spark, sf):
    p = load(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length(F.regexp_replace("html", "<[^>]*>", "")).alias("text_chars"), (F.col("url").contains("example.com") & ~F.col("url").contains("/fr/")).alias("allowed"))


@query()
def html_visible_text(spark, sf):
    return load(spark, sf, "pages").select("page_id", T.visible_text(F.col("html")).alias("text"))


@query()
def html_paragraphs(spark, sf):
    from heddle.functions.arrow import paragraphs

    return load(spark, sf, "pages").select("page_id", F.posexplode(paragraphs()("html")).alias("at", "paragraph"))


@query()
def unicode_normal_forms(spark, sf):
    from heddle.functions.arrow import normal_form

    return D(spark, sf).select("doc_id", normal_form("NFKC")("text").alias("nfkc"))


@query("""SELECT event_id, CASE WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2} ') THEN 'space' WHEN s LIKE '%Z' THEN 'zulu' ELSE 'naive' END AS kind FROM
(SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS s FROM events)""")
def timestamp_kinds(spark, sf):
    e = load(spark, sf, "events")
    k = F.col("event_id") % 3
    s = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", T.timestamp_kind(s).alias("kind"))


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT % 2 = 0""")
def json_extract(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf, "events").where(k % 2 == 0).select("event_id", k.alias("k"))


@query("""WITH g AS (SELECT conv_id, count(*) AS n, md5(conv_id::VARCHAR) AS h FROM conversations GROUP BY 1), c AS (SELECT conv_id, n, sum(n) OVER (ORDER BY h, conv_id) - n AS before, sum(n) OVER () AS total FROM g)
SELECT conv_id, CASE WHEN before < 0.8 * total THEN 'train' WHEN before < 0.9 * total THEN 'val' ELSE 'test' END AS split FROM c""")
def group_split(spark, sf):
    return datasets.group_split(load(spark, sf, "conversations"), "conv_id")


@query("""SELECT doc_id, CASE WHEN b < 90 THEN 'train' WHEN b < 95 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || left(md5(doc_id::VARCHAR), 7))::BIGINT % 100 AS b FROM documents)""")
def hash_split(spark, sf):
    return datasets.hash_split(D(spark, sf, "source"), "doc_id").select("doc_id", "split")


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, sha256({_COLLAPSE.format('lower(text)')}) AS f FROM documents)
SELECT a.split AS split_a, b.split AS split_b, count(DISTINCT a.f) AS shared FROM d a JOIN d b ON a.f = b.f AND a.split < b.split GROUP BY 1, 2""")
def split_leakage(spark, sf):
    k = F.col("doc_id") % 10
    d = D(spark, sf).withColumn("split", F.when(k < 8, "train").when(k == 8, "val").otherwise("test"))
    return datasets.leakage(d, "text")


@query("""SELECT conv_id, turn AS turn, text AS instruction, nxt AS output FROM (SELECT conv_id, turn, role, text, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nrole = 'assistant' AND len(nxt) >= 5""")
def instruction_pairs(spark, sf):
    return datasets.instruction_pairs(load(spark, sf, "conversations"))


@query("""SELECT doc_id, '{"messages":[{"role":"user","content":"' || 'Continue ' || doc_id || '"},{"role":"assistant","content":"' || source || '"}]}' AS chat FROM documents WHERE len(text) >= 5""")
def chat_records(spark, sf):
    d = load(spark, sf, "documents").where(F.length("text") >= 5)
    return d.select("doc_id", datasets.chat_json([("user", F.concat(F.lit("Continue "), "doc_id")), ("assistant", F.col("source"))]).alias("chat"))


@query("""SELECT text, source FROM (SELECT text, source, row_number() OVER (PARTITION BY text ORDER BY p, doc_id) AS r FROM (SELECT 1 AS p, doc_id, text, source FROM documents WHERE lang = 'fr' UNION ALL SELECT 2, doc_id, text, source FROM documents WHERE lang <> 'de') WHERE len(text) >= 20) WHERE r = 1""")
def corpus_unify(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    return datasets.unify([d.where("lang = 'fr'"), d.where("lang <> 'de'")], "doc_id", least=20).select("text", "source")


@query("""SELECT doc_id, length_code || lang_code AS codes FROM (SELECT doc_id, CASE WHEN len(text) < 200 THEN 'short,' ELSE '' END AS length_code, CASE WHEN lang NOT IN ('en', 'fr') THEN 'lang' ELSE '' END AS lang_code FROM documents)""")
def record_validator(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.when(F.length("text") < 200, "short,").otherwise(""), F.when(~F.col("lang").isin("en", "fr"), "lang").otherwise("")).alias("codes"))


@query("""WITH d AS (SELECT p_partkey, lower(p_name) AS n, list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda x: x <> '') AS t FROM part), s AS (SELECT *, (list_contains(t, 'small')::INTEGER + list_contains(t, 'ring')::INTEGER) / 2 AS share FROM d)
SELECT p_partkey, (CASE WHEN coalesce(n, '') = '' THEN 0.0 WHEN n = 'small ring' THEN 1.0 WHEN starts_with(n, 'small ring') THEN 0.85 WHEN share > 0 THEN round(least(1.0, share * 0.7 + least(1.0, 0.5 + 0.5 * 2.0 / len(t)) * 0.3), 4) WHEN contains(n, 'small ring') THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM s""")
def relevance_score(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.relevance("small ring", F.col("p_name")).alias("score"))


@query("""SELECT doc_id, rejected FROM (SELECT doc_id, CASE WHEN len(trim(text)) < 100 THEN 'short' WHEN lang NOT IN ('en', 'fr') THEN 'language' WHEN row_number() OVER (PARTITION BY len(trim(text)) >= 100 AND lang IN ('en', 'fr'), md5(trim(text)) ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'kept' END AS rejected FROM documents)""")
def reject_chain(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "lang", F.trim("text").alias("text"))
    return datasets.reject_chain(d, [("short", F.length("text") < 100), ("language", ~F.col("lang").isin("en", "fr"))], "doc_id", "text").select("doc_id", "rejected")



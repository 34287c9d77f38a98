"""Queries of everyday predicates, lookups, edges, tags and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import cleaning as K
from heddle.functions import text as T
from heddle.operators import dedup, rows
from heddle.operators import routine as O
from heddle.plans.fragments import EN, FR, TOKENS, sql_list
from heddle.plans.registry import query
from heddle.tables import load


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'brass') OR contains(lower(p_brand), 'brass') ORDER BY p_partkey LIMIT 100")
def verse_search(spark, sf):
    low = [F.lower(c) for c in ("p_name", "p_type", "p_brand")]
    return load(spark, sf, "part").where(low[0].contains("ring") | low[1].contains("brass") | low[2].contains("brass")).orderBy("p_partkey").limit(100).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'small') OR contains(lower(p_type), 'small') ORDER BY p_partkey LIMIT 50")
def phrases_with_word(spark, sf):
    return load(spark, sf, "part").where(F.lower("p_name").contains("small") | F.lower("p_type").contains("small")).orderBy("p_partkey").limit(50).select("p_partkey")


@query("SELECT doc_id, 'text' AS column_name, 'sentence' AS kind, text AS value FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'source', 'word', source FROM documents")
def conditional_columns(spark, sf):
    """Each column with its kind and the rows where it is worked on."""
    return O.conditional_columns(load(spark, sf, "documents"), "doc_id", [("text", "sentence", "lang = 'en'"), ("source", "word", None)])


@query("SELECT conv_id, turn, coalesce(CASE WHEN turn % 2 = 0 THEN role END, 'none') AS side, text FROM conversations")
def parallel_projection(spark, sf):
    """A field from nested metadata where it is there, else a default."""
    c = load(spark, sf, "conversations").withColumn("meta", F.when(F.col("turn") % 2 == 0, F.struct(F.struct(F.col("role").alias("side")).alias("inner"))))
    return c.select("conv_id", "turn", F.coalesce("meta.inner.side", F.lit("none")).alias("side"), "text")


@query("SELECT p_partkey, unnest(CASE WHEN p_size % 2 = 0 THEN [p_name] ELSE string_split(p_name, ' ') END) AS meaning FROM part")
def dictionary_projection(spark, sf):
    """A scalar or a list of meanings: a row for each."""
    p = load(spark, sf, "part")
    raw = F.when(F.col("p_size") % 2 == 0, F.to_json(F.array("p_name"))).otherwise(F.to_json(F.split("p_name", " ")))
    return p.select("p_partkey", F.explode(F.from_json(raw, "array<string>")).alias("meaning"))


@query("SELECT l_partkey, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)) AS flag FROM lineitem GROUP BY 1")
def last_wins_lookup(spark, sf):
    """Of repeated keys the last line stands."""
    return load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max_by("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_returnflag")).alias("flag"))


@query("SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size = (props->>'$.k')::BIGINT)")
def not_exists_on_json_key(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("p_size"))
    return e.join(load(spark, sf, "part").select("p_size"), "p_size", "left_anti").select("event_id")


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE value > 0.9) GROUP BY 2, 3")
def idempotent_enqueue(spark, sf):
    """New jobs once each, without those that are queued already."""
    e = load(spark, sf, "events")
    new = rows.missing_from(e, e.where("value > 0.9"), ["user_id", "event_type"])
    return new.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT source, round(avg((len(text) BETWEEN 100 AND 20000)::INTEGER), 4) AS fit, round(avg(regexp_matches(text, '^[A-Z]')::INTEGER), 4) AS capital, round(avg(regexp_matches(text, '[.!?]$')::INTEGER), 4) AS closed FROM documents GROUP BY 1")
def text_quality(spark, sf):
    c = F.col("text")
    one = lambda x, n: F.round(F.avg(x.cast("int")), 4).alias(n)
    return load(spark, sf, "documents").groupBy("source").agg(one(F.length(c).between(100, 20000), "fit"), one(c.rlike("^[A-Z]"), "capital"), one(c.rlike(r"[.!?]\z"), "closed"))


@query("SELECT count(*) AS entries, round(avg((p_name <> '')::INTEGER), 4) AS named, round(avg((p_type <> '')::INTEGER), 4) AS typed, count(*) - count(DISTINCT lower(p_name)) AS repeated FROM part")
def dictionary_quality(spark, sf):
    p = load(spark, sf, "part")
    return p.agg(F.count(F.lit(1)).alias("entries"), F.round(F.avg((F.col("p_name") != "").cast("int")), 4).alias("named"), F.round(F.avg((F.col("p_type") != "").cast("int")), 4).alias("typed"), F.count_distinct(F.lower("p_name")).alias("d")).select("entries", "named", "typed", (F.col("entries") - F.col("d")).alias("repeated"))


@query("SELECT p_brand, count(DISTINCT p_type) AS lanes, string_agg(DISTINCT left(p_type, 5), ',' ORDER BY left(p_type, 5)) AS names FROM part GROUP BY 1")
def distinct_lanes(spark, sf):
    return load(spark, sf, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("lanes"), F.array_join(F.array_sort(F.collect_set(F.substring("p_type", 1, 5))), ",").alias("names"))


@query("SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def field_distribution(spark, sf):
    return O.field_distribution(load(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT doc_id FROM documents ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 1")
def arbitrary_row(spark, sf):
    """One row that no order prefers, the same in every run."""
    return load(spark, sf, "documents").select("doc_id").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id").limit(1)


@query("SELECT a, b, kind FROM (SELECT n_nationkey AS a, n_regionkey AS b, 'out' AS kind FROM nation UNION ALL SELECT n_regionkey, n_nationkey, 'in' FROM nation)")
def edges_both_ways(spark, sf):
    n = load(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"), F.lit("out").alias("kind")).unionByName(n.select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"), F.lit("in").alias("kind")))


@query("SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(text || chr(8220) || chr(8203), chr(8220), '\"'), chr(8221), '\"'), chr(8211), '-'), chr(8216), ''''), chr(8217), ''''), chr(8203), ''), chr(65279), '') AS fixed FROM documents")
def encoding_repair(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.repaired(F.concat("text", F.lit("“​"))).alias("fixed"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) END AS even FROM documents")
def whitespace_by_kind(spark, sf):
    """Words: all white space collapses; sentences: line feeds stay."""
    return load(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, T.collapse(F.col("text"))).otherwise(T.even_lines(F.col("text"))).alias("even"))


@query(f"SELECT doc_id, left(sha256(source || '|' || lang || '|' || text), 16) AS h FROM documents")
def provenance_hash(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.substring(F.sha2(F.concat_ws("|", "source", "lang", "text"), 256), 1, 16).alias("h"))


_G = "list_distinct(list_transform(range(1, len({0}) - 1), lambda i: substring(lower({0}), i, 3)))"


@query(f"SELECT p_partkey, round(CASE WHEN greatest(len({_G.format('p_name')}), len({_G.format('p_type')})) = 0 THEN 0.0 ELSE len(list_intersect({_G.format('p_name')}, {_G.format('p_type')})) / greatest(len({_G.format('p_name')}), len({_G.format('p_type')})) END, 4) AS overlap FROM part")
def trigram_overlap(spark, sf):
    a, b = T.char_shingles(F.col("p_name"), 3), T.char_shingles(F.col("p_type"), 3)
    return load(spark, sf, "part").select("p_partkey", F.round(T.overlap(a, b), 4).alias("overlap"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k FROM events")
def tolerant_json(spark, sf):
    """Broken JSON reads as null."""
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return load(spark, sf, "events").select("event_id", F.from_json(raw, "k long").alias("x")).select("event_id", "x.k")


@query("SELECT min(o_orderkey) AS o_orderkey, lower(o_orderstatus) AS a, lower(o_orderpriority) AS b FROM orders GROUP BY 2, 3")
def pair_dedup(spark, sf):
    o = load(spark, sf, "orders")
    return o.groupBy(F.lower("o_orderstatus").alias("a"), F.lower("o_orderpriority").alias("b")).agg(F.min("o_orderkey").alias("o_orderkey"))


@query(f"SELECT doc_id, len(t) AS n, CASE WHEN len(t) = 0 THEN 0.0 ELSE round(1 - len(list_filter(t, lambda x: x IN {sql_list(FR)})) / len(t), 4) END AS purity FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def purity_score(spark, sf):
    t = T.tokens(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.when(F.size(t) == 0, 0.0).otherwise(F.round(1 - T.hit_share(t, FR), 4)).alias("purity"))


_RULES = {"doubled blank": "  ", "shout": "!{2,}", "capitals": "[A-Z]{4,}"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS docs, coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0)::BIGINT AS hits FROM documents" for n, p in _RULES.items()))
def rule_hits(spark, sf):
    return O.rule_hits(load(spark, sf, "documents"), "text", _RULES)


@query("SELECT source, round(avg((NOT regexp_matches(text, '!{2,}|[A-Z]{4,}'))::INTEGER), 4) AS rate, CASE WHEN avg((NOT regexp_matches(text, '!{2,}|[A-Z]{4,}'))::INTEGER) >= 0.9 THEN 'green' WHEN avg((NOT regexp_matches(text, '!{2,}|[A-Z]{4,}'))::INTEGER) >= 0.7 THEN 'amber' ELSE 'red' END AS band FROM documents GROUP BY 1")
def compliance_rate(spark, sf):
    rate = F.avg((~F.col("text").rlike("!{2,}|[A-Z]{4,}")).cast("int"))
    return load(spark, sf, "documents").groupBy("source").agg(F.round(rate, 4).alias("rate"), O.band(rate, 0.9, 0.7).alias("band"))


@query("WITH h AS (SELECT doc_id, 'shout' AS rule, lang FROM documents WHERE regexp_matches(text, '!{2,}') UNION ALL SELECT doc_id, 'capitals', lang FROM documents WHERE regexp_matches(text, '[A-Z]{4,}')) SELECT rule, count(*) AS n FROM h WHERE NOT (rule = 'shout' AND lang = 'fr') AND NOT (rule = 'capitals' AND doc_id % 2 = 0) GROUP BY 1")
def exception_registry(spark, sf):
    """Findings without those that an exception names: by rule and language, by rule and row."""
    d = load(spark, sf, "documents")
    hits = d.where(F.col("text").rlike("!{2,}")).select("doc_id", F.lit("shout").alias("rule"), "lang").unionByName(d.where(F.col("text").rlike("[A-Z]{4,}")).select("doc_id", F.lit("capitals").alias("rule"), "lang"))
    return O.without_exceptions(hits, ["rule = 'shout' and lang = 'fr'", "rule = 'capitals' and doc_id % 2 = 0"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("WITH n AS (SELECT source, count(*) AS now FROM documents WHERE regexp_matches(text, '!{2,}') GROUP BY 1), b AS (SELECT source, count(*) AS base FROM documents WHERE regexp_matches(text, '!{2,}') AND doc_id % 9 <> 0 GROUP BY 1) SELECT source, coalesce(now, 0) AS now, coalesce(base, 0) AS base, coalesce(now, 0) > coalesce(base, 0) AS regressed FROM n FULL JOIN b USING (source)")
def content_gate(spark, sf):
    """Findings by source against a baseline: more than there is a regression."""
    hit = load(spark, sf, "documents").where(F.col("text").rlike("!{2,}"))
    n = lambda df, c: df.groupBy("source").agg(F.count(F.lit(1)).alias(c))
    j = n(hit, "now").join(n(hit.where("doc_id % 9 <> 0"), "base"), "source", "full")
    return j.select("source", F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("base", F.lit(0)).alias("base")).withColumn("regressed", F.col("now") > F.col("base"))


_SAID = {"standard": "ADJ", "small": "ADJ", "medium": "ADJ", "large": "ADJ", "economy": "NOUN", "promo": "ADJ", "anodized": "ADJ", "burnished": "ADJ", "plated": "VERB", "polished": "VERB", "brushed": "ADJ", "tin": "NOUN", "nickel": "ADJ", "brass": "ADJ", "steel": "ADJ"}
_SAID_SQL = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SAID.items()) + " ELSE '?' END"


@query(f"""WITH t AS (SELECT p_partkey, list_distinct(list_transform(list_filter(regexp_split_to_array(lower(p_type), '[/,;.\\s]+'), lambda x: x <> ''), lambda x: {_SAID_SQL})) AS t FROM part)
SELECT p_partkey, CASE WHEN len(t) = 0 OR list_contains(t, '?') THEN 'unknown' WHEN len(t) = 1 THEN t[1] ELSE 'candidates' END AS tag FROM t""")
def pos_normalise(spark, sf):
    """The words of each part's type as tags: an unknown word makes all unknown, one tag stands, several are candidates."""
    return load(spark, sf, "part").select("p_partkey", O.normal_tag(F.col("p_type"), _SAID).alias("tag"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'AUX' WHEN 2 THEN 'X' ELSE 'ADP' END AS tag FROM part")
def pos_bridge(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("common noun", "copula", "gibberish", "postposition"))), (F.col("p_size") % 4 + 1).cast("int"))
    return load(spark, sf, "part").select("p_partkey", O.bridged_tag(raw, {"common noun": "NOUN", "copula": "AUX", "postposition": "ADP"}).alias("tag"))


@query("SELECT p_partkey, p || r || s AS form FROM (SELECT p_partkey, lower(left(p_name, 3)) AS r, unnest(['', 're']) AS p, ['', 'ing'] AS ss FROM part) AS a, (SELECT unnest(['', 'ing']) AS s) AS b")
def generated_forms(spark, sf):
    return O.generated_forms(load(spark, sf, "part").select("p_partkey", F.lower(F.substring("p_name", 1, 3)).alias("root")), "root", ["", "re"], ["", "ing"]).select("p_partkey", "form")


@query(f"SELECT w AS word, regexp_matches(w, '[bcdfghjklmnpqrstvwxz]{{4,}}') AS cluster, regexp_matches(w, '[aeiou]{{4,}}') AS hiatus, NOT regexp_matches(w, '[aeiouyà-ÿ]') AS silent FROM (SELECT DISTINCT w FROM (SELECT unnest({TOKENS}) AS w FROM documents))")
def phonotactics(spark, sf):
    """Violations by word: clusters, vowel runs, no vowel."""
    w = load(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    c = F.col("word")
    return w.select("word", c.rlike("[bcdfghjklmnpqrstvwxz]{4,}").alias("cluster"), c.rlike("[aeiou]{4,}").alias("hiatus"), (~c.rlike("[aeiouyà-ÿ]")).alias("silent"))


@query(f"SELECT doc_id, array_to_string(list_transform(t, lambda x: CASE x WHEN 'the' THEN 'der' WHEN 'of' THEN 'von' WHEN 'and' THEN 'und' ELSE x END), ' ') AS translated FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def dictionary_translate(spark, sf):
    table = F.create_map(*[F.lit(x) for kv in (("the", "der"), ("of", "von"), ("and", "und")) for x in kv])
    return load(spark, sf, "documents").select("doc_id", F.array_join(F.transform(T.tokens(F.col("text")), lambda x: F.coalesce(F.try_element_at(table, x), x)), " ").alias("translated"))


@query("""WITH s AS (SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY 1) SELECT doc_id, langs AS kind, n AS related, CASE WHEN langs >= 4 THEN 'green' WHEN langs >= 3 THEN 'amber' ELSE 'red' END AS band FROM documents JOIN s ON s.source IS NOT DISTINCT FROM documents.source""")
def relationship_bands(spark, sf):
    """Each document by how many languages its source holds, and how many documents."""
    d = load(spark, sf, "documents").select("doc_id", F.col("source").alias("own"), "lang")
    s = d.groupBy(F.col("own").alias("source")).agg(F.count(F.lit(1)).alias("related"), F.count_distinct("lang").alias("kind"))
    return d.join(s, F.col("own").eqNullSafe(F.col("source"))).select("doc_id", "kind", "related", O.band(F.col("kind"), 4, 3).alias("band"))


@query()
def near_dedup_ngrams(spark, sf):
    """Keep-first over pairs with enough common shingles; against brute force on a small table."""
    from heddle.plans.folders import checkpoints

    checkpoints(spark)
    d = load(spark, sf, "documents").select("doc_id", "text")
    return dedup.keep_first(d, "doc_id", dedup.shingle_pairs(d, "doc_id", "text")).select("doc_id")


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS letters, K AS kinds FROM (SELECT doc_id, text, (regexp_matches(text, '[0-9]'))::INTEGER + (regexp_matches(text, '[!?]'))::INTEGER + (regexp_matches(text, '[^\\x00-\\x7F]'))::INTEGER AS K FROM documents)")
def character_kinds(spark, sf):
    c = F.col("text")
    kinds = sum((c.rlike(p).cast("int") for p in ("[0-9]", "[!?]", r"[^\x00-\x7F]")), F.lit(0))
    return load(spark, sf, "documents").select("doc_id", F.length(F.regexp_replace(c, "[^A-Za-z]", "")).alias("letters"), kinds.alias("kinds"))

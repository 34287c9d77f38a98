"""Queries of phonology and word analysis over the distinct words of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions.linguistic import Syllables
from heddle.operators import phonology as P
from heddle.operators import tagging as G
from heddle.plans.fragments import D, sql_list
from heddle.plans.registry import query
from heddle.tables import load

_V = "aeiouyàáâäèéêëìíîïòóôöùúûüœæ"
_ON = ["", *"bcdfghjklmnpqrstvwxzç", "th", "sh", "wh", "ch", "st", "bl", "tr", "cr", "pr", "fr", "gr"]
_NU = [*_V, "ea", "ou", "io", "ie", "ei", "au", "ai", "oi", "ue", "eu"]
_CO = ["", *"lmnrstdg", "nd", "ng", "st", "nt"]
SOUNDS = P.Sounds(_V, tuple(_ON), tuple(_NU), tuple(_CO), (("áéíóú", "T2"), ("àèìòù", "T3"), ("âêîôûäöü", "T4")))
#: The ordered tone rules that the tests spell out.
RULES = {("T1", "T3"): ("T2", "T3"), ("T3", "T1"): ("T2", "T1"), ("T3", "T3"): ("T2", "T3"), ("T3", "T4"): ("T3", "T2")}
AFFIXES = [("tion", "suffix", "N"), ("ing", "suffix", "V"), ("ed", "suffix", "V"), ("ly", "suffix", "ADV"), ("s", "suffix", "N"), ("re", "prefix", "V"), ("in", "prefix", "ADJ")]
LEXICON = [("the", "DET"), ("of", "PREP"), ("and", "CONJ"), ("der", "DET"), ("les", "DET"), ("hand", "N"), ("her", "PRON"), ("red", "ADJ")]

_RULE = " ".join(f"WHEN '{a} {b}' THEN ['{c}', '{d}']" for (a, b), (c, d) in RULES.items())
_SYL = f"CASE WHEN len(regexp_extract_all(word, '[^{_V}]*[{_V}]+(?:[^{_V}]+$)?')) = 0 THEN [word] ELSE regexp_extract_all(word, '[^{_V}]*[{_V}]+(?:[^{_V}]+$)?') END"
_TONE = "CASE " + " ".join(f"WHEN regexp_matches(x, '[{m}]') THEN '{t}'" for m, t in SOUNDS.marks) + " ELSE 'T1' END"
_PART = [f"regexp_extract(x, '^([^{_V}]*)([{_V}]*)(.*)$', {k})" for k in (1, 2, 3)]


def _words(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("word"))
    return d.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(t) AS word FROM ({D})), s AS (SELECT word, {_SYL} AS s FROM w), t AS (SELECT word, s, list_transform(s, lambda x: {_TONE}) AS t FROM s),
r AS (SELECT word, s, t, CASE WHEN len(t) < 2 THEN t ELSE list_reduce(list_transform(t, lambda x: [x]), lambda a, b: a[1 : len(a) - 1] || CASE a[len(a)] || ' ' || b[1] {_RULE} ELSE [a[len(a)], b[1]] END) END AS u,
list_transform(s, lambda x: CASE WHEN {_PART[0]} IN {sql_list(_ON)} AND {_PART[1]} IN {sql_list(_NU)} AND {_PART[2]} IN {sql_list(_CO)} THEN 0 ELSE 1 END + CASE WHEN length({_PART[0]}) > 2 THEN 1 ELSE 0 END + CASE WHEN length({_PART[2]}) > 2 THEN 1 ELSE 0 END) AS bad FROM t)
SELECT word, array_to_string(s, '|') AS syllables, array_to_string(t, ' ') AS tones, array_to_string(u, ' ') AS sandhi, list_sum(bad)::INTEGER AS n_violations, len(s) > 2 AS secondary FROM r""")
def word_phonology(spark, sf):
    p = P.phonology(_words(spark, sf).select("word"), SOUNDS, RULES)
    return p.select("word", F.array_join("syllables", "|").alias("syllables"), F.array_join("tones", " ").alias("tones"), F.array_join("sandhi", " ").alias("sandhi"), F.size("violations").alias("n_violations"), F.array_contains("stress", "secondary").alias("secondary"))


_AFFIX = "(VALUES " + ", ".join(f"({k}, '{a}', '{kind}', '{t}')" for k, (a, kind, t) in enumerate(AFFIXES)) + ") AS f(k, affix, kind, tag)"
_LEX = "(VALUES " + ", ".join(f"('{w}', '{t}')" for w, t in LEXICON) + ") AS l(word, tag)"


@query(f"""WITH d AS ({D}), e AS (SELECT doc_id, source, unnest(t) AS word FROM d), w AS (SELECT word, count(*) AS n FROM e GROUP BY 1), x AS (SELECT * FROM {_AFFIX}), l AS (SELECT * FROM {_LEX}),
c AS (SELECT word, affix, tag, k, CASE kind WHEN 'prefix' THEN substr(word, length(affix) + 1) ELSE left(word, length(word) - length(affix)) END AS root FROM w, x WHERE CASE kind WHEN 'prefix' THEN starts_with(word, affix) ELSE ends_with(word, affix) END AND length(word) - length(affix) >= 3),
b AS (SELECT c.* FROM c JOIN w ON w.word = c.root QUALIFY row_number() OVER (PARTITION BY c.word ORDER BY length(affix) DESC, k) = 1),
s AS (SELECT word, list(source ORDER BY source) AS senses FROM (SELECT * FROM (SELECT DISTINCT word, source FROM e WHERE source IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY word ORDER BY source) <= 3) GROUP BY 1)
SELECT w.word, w.n, array_to_string({_SYL.replace("word", "w.word")}, '|') AS syllables, coalesce(root, w.word) AS root, affix, coalesce(own.tag, b.tag, of_root.tag, 'X') AS pos, coalesce(array_to_string(senses, '|'), '') AS senses
FROM w LEFT JOIN b ON b.word = w.word LEFT JOIN l AS own ON own.word = w.word LEFT JOIN l AS of_root ON of_root.word = coalesce(root, w.word) LEFT JOIN s ON s.word = w.word""")
def word_analysis(spark, sf):
    """Every word with its syllables, root, affix, part of speech and the first sources it stands in."""
    senses = load(spark, sf, "documents").where("source is not null").select("source", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).select("word", F.col("source").alias("sense"))
    out = P.analysed(_words(spark, sf), SOUNDS, AFFIXES, spark.createDataFrame(LEXICON, "word string, tag string"), senses)
    return out.select("word", "n", F.array_join("syllables", "|").alias("syllables"), "root", "affix", "pos", F.array_join("senses", "|").alias("senses"))


MUNCH = Syllables(frozenset(_ON), frozenset(_NU), frozenset(_CO))
_ALT = lambda xs: "(" + "|".join(x for x in xs if x) + ")"
_VALID = f"{_ALT(_ON)}?{_ALT(_NU)}{_ALT(_CO)}?"
_MUNCHED = f"""WITH RECURSIVE w AS (SELECT word, count(*) AS n FROM (SELECT unnest(t) AS word FROM ({D})) GROUP BY 1),
s AS (SELECT word, word AS rest, []::VARCHAR[] AS parts FROM w UNION ALL SELECT word, substr(rest, k + 1), parts || [left(rest, k)] FROM (
SELECT *, coalesce(list_max(list_filter([1, 2, 3, 4, 5, 6], lambda i: i <= length(rest) AND regexp_full_match(left(rest, i), '{_VALID}'))), 1) AS k FROM s WHERE rest <> '')), m AS (SELECT word, parts FROM s WHERE rest = '')"""


@query(_MUNCHED + " SELECT word, array_to_string(parts, '|') AS syllables FROM m")
def syllable_max_munch(spark, sf):
    return G.max_munch(_words(spark, sf).select("word"), MUNCH).select("word", F.array_join("syllables", "|").alias("syllables"))


@query(_MUNCHED + f""", r AS (SELECT word, n, len(parts) AS pred, len({_SYL}) AS gold, list_transform(range(1, len(parts)), lambda i: length(array_to_string(parts[1:i], ''))) AS a, list_transform(range(1, len({_SYL})), lambda i: length(array_to_string(({_SYL})[1:i], ''))) AS b FROM m JOIN w USING (word))
SELECT CASE WHEN n >= 100 THEN 'frequent' WHEN n >= 10 THEN 'middle' ELSE 'rare' END AS band, CASE WHEN a = b THEN 'equal' WHEN pred > gold THEN 'over' WHEN pred < gold THEN 'under' ELSE 'moved' END AS error, count(*) AS words, sum(len(list_intersect(a, b)))::BIGINT AS shared FROM r GROUP BY 1, 2""")
def syllable_errors(spark, sf):
    """Longest match against the vowel rule by how frequent words are: equal, over- and undersegmented, and moved boundaries."""
    w = G.max_munch(_words(spark, sf), MUNCH).withColumn("gold", P.syllables(F.col("word"), SOUNDS))
    ends = lambda c: F.expr(f"transform(if(size({c}) > 1, sequence(1, size({c}) - 1), array()), i -> length(array_join(slice({c}, 1, i), '')))")
    w = w.withColumn("a", ends("syllables")).withColumn("b", ends("gold"))
    band = F.when(F.col("n") >= 100, "frequent").when(F.col("n") >= 10, "middle").otherwise("rare")
    error = F.when(F.col("a") == F.col("b"), "equal").when(F.size("syllables") > F.size("gold"), "over").when(F.size("syllables") < F.size("gold"), "under").otherwise("moved")
    return w.groupBy(band.alias("band"), error.alias("error")).agg(F.count(F.lit(1)).alias("words"), F.sum(F.size(F.array_intersect("a", "b"))).alias("shared"))


@query(_MUNCHED + f""", r AS (SELECT len(parts) AS pred, len({_SYL}) AS gold, parts = ({_SYL}) AS same FROM m JOIN w USING (word))
SELECT least(gold, 6)::INTEGER AS gold, CASE WHEN same THEN 'equal' WHEN pred > gold THEN 'over' WHEN pred < gold THEN 'under' ELSE 'shifted' END AS error, count(*) AS words FROM r GROUP BY ALL""")
def segmentation_errors(spark, sf):
    """Longest match against the vowel rule by how many syllables a word has, six and more as one."""
    w = G.max_munch(_words(spark, sf), MUNCH).withColumn("gold", P.syllables(F.col("word"), SOUNDS))
    error = F.when(F.col("syllables") == F.col("gold"), "equal").when(F.size("syllables") > F.size("gold"), "over").when(F.size("syllables") < F.size("gold"), "under").otherwise("shifted")
    return w.groupBy(F.least(F.size("gold"), F.lit(6)).alias("gold"), error.alias("error")).agg(F.count(F.lit(1)).alias("words"))


@query(f"""WITH RECURSIVE w AS (SELECT word, count(*) AS n FROM (SELECT unnest(t) AS word FROM ({D})) GROUP BY 1), r AS (SELECT word AS part FROM w WHERE n >= 20 AND length(word) >= 3),
s AS (SELECT word, word AS rest, []::VARCHAR[] AS parts FROM w WHERE length(word) >= 6
UNION ALL SELECT word, rest, parts FROM (SELECT word, substr(s.rest, length(r.part) + 1) AS rest, parts || [r.part] AS parts, row_number() OVER (PARTITION BY word ORDER BY length(r.part) DESC) AS p FROM s JOIN r ON starts_with(s.rest, r.part) AND length(r.part) < length(word) WHERE s.rest <> '' AND len(parts) < 6) WHERE p = 1)
SELECT word, array_to_string(parts, '+') AS parts FROM s WHERE rest = ''""")
def compound_splits(spark, sf):
    """Words that are two or more frequent words in a row."""
    w = _words(spark, sf)
    return G.compounds(w.select("word"), w.where("n >= 20")).select("word", F.array_join("parts", "+").alias("parts"))


CLOSED = {"the": "DET", "of": "ADP", "and": "CCONJ", "in": "ADP", "der": "DET", "die": "DET", "und": "CCONJ", "le": "DET", "les": "DET", "de": "ADP", "et": "CCONJ", "los": "DET", "que": "SCONJ"}
KNOWN = {"hand": "NOUN", "thing": "NOUN", "her": "PRON", "red": "ADJ", "other": "ADJ", "there": "ADV"}
TAILS = {"tion": "NOUN", "ing": "VERB", "ed": "VERB", "er": "NOUN", "en": "VERB", "ly": "ADV"}
_LETTERS = "regexp_extract_all(text, '[A-Za-zÀ-ɏ]+')"
_TAG = "CASE " + " ".join([*(f"WHEN lower(x) = '{w}' THEN '{t} 95'" for w, t in CLOSED.items()), *(f"WHEN lower(x) = '{w}' THEN '{t} 90'" for w, t in KNOWN.items()), r"WHEN i > 1 AND regexp_matches(x, '^\p{Lu}') THEN 'PROPN 80'", *(f"WHEN ends_with(lower(x), '{s}') THEN '{TAILS[s]} 60'" for s in sorted(TAILS, key=len, reverse=True))]) + " ELSE 'NOUN 30' END"


@query(f"""WITH s AS (SELECT doc_id, {_LETTERS} AS l FROM documents), t AS (SELECT doc_id, list_transform(l, lambda x, i: {_TAG}) AS t FROM s)
SELECT doc_id, len(t) AS n, sha256(array_to_string(t, ',')) AS tags_sha256, len(list_filter(t, lambda x: x = 'PROPN 80')) AS names FROM t""")
def pos_tagger(spark, sf):
    """Every token's tag and confidence in every document, as a digest of all of them."""
    t = load(spark, sf, "documents").select("doc_id", G.tags(T.regexp_words(F.col("text")), CLOSED, KNOWN, TAILS).alias("t"))
    shown = F.transform("t", lambda x: F.concat_ws(" ", x["tag"], F.round(x["confidence"] * 100).cast("int").cast("string")))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join(shown, ","), 256).alias("tags_sha256"), F.size(F.filter("t", lambda x: x["tag"] == "PROPN")).cast("long").alias("names"))


@query()
def subword_pieces(spark, sf):
    """Every document's pieces as a digest, their number and the share that the vocabulary knows; tests hold it against the library."""
    import public_tokenizers

    s = G.subwords(load(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return s.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.concat_ws(",", "ids"), 256).alias("ids_sha256"), "coverage")

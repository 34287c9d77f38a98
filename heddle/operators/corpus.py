"""Corpus statistics over tables (doc_id, tokens) or (doc_id, text): counts, n-grams, collocations, term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import text as T
from heddle.operators.rows import first_per_key


def tokenized(docs: DataFrame, *also: str, least: int = 1) -> DataFrame:
    """(doc_id, *also, tokens)."""
    return docs.select("doc_id", *also, T.tokens(F.col("text"), least).alias("tokens"))


def word_stats(docs: DataFrame) -> DataFrame:
    """(word, frequency, doc_freq, source_count, diversity) over (doc_id, source, tokens). Each word is summed per document first."""
    per = docs.select("doc_id", "source", F.explode("tokens").alias("word")).groupBy("word", "doc_id", "source").agg(F.count(F.lit(1)).alias("n"))
    total = docs.agg(F.count_distinct("doc_id").alias("docs"))
    out = per.groupBy("word").agg(F.sum("n").alias("frequency"), F.count_distinct("doc_id").alias("doc_freq"), F.count_distinct("source").alias("source_count"))
    return out.join(F.broadcast(total)).select("word", "frequency", "doc_freq", "source_count", F.round(F.col("doc_freq") / F.col("docs"), 4).alias("diversity"))  # one row


def surface_forms(docs: DataFrame, k: int = 10) -> DataFrame:
    """(word, form, n): the k most frequent written forms of each lower-cased word."""
    form = docs.select(F.explode(T.regexp_words(F.col("text"))).alias("form"))
    n = form.groupBy(F.lower("form").alias("word"), "form").agg(F.count(F.lit(1)).alias("n"))
    return first_per_key(n, ["word"], [F.desc("n"), F.asc("form")], k)


def pair_counts(docs: DataFrame, window: int = 2) -> DataFrame:
    """(a, b, n): unordered pairs of different tokens at most `window` apart, a < b."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda d: F.when(F.size("tokens") > d, F.zip_with(F.slice("tokens", 1, F.size("tokens") - d), F.slice("tokens", d + 1, F.size("tokens") - d), lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))))
    p = docs.select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b")
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def collocations(docs: DataFrame, window: int = 2, least: int = 5, k: int = 10) -> DataFrame:
    """(word, partner, n, pmi): the k partners of each word with the largest positive PMI; counts of `least` or more."""
    single = docs.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    total = single.agg(F.sum("f").alias("total"))
    often = single.where(F.col("f") >= least)
    n = pair_counts(docs, window).where(F.col("n") >= least)
    joined = n.join(often.select(F.col("w").alias("a"), F.col("f").alias("fa")), "a").join(often.select(F.col("w").alias("b"), F.col("f").alias("fb")), "b").join(F.broadcast(total))  # one row
    pmi = joined.withColumn("pmi", F.round(F.log2(F.col("n") * F.col("total") / (F.col("fa") * F.col("fb"))), 4)).where("pmi > 0")
    both = pmi.select(F.col("a").alias("word"), F.col("b").alias("partner"), "n", "pmi").unionByName(pmi.select(F.col("b").alias("word"), F.col("a").alias("partner"), "n", "pmi"))
    return first_per_key(both, ["word"], [F.desc("pmi"), F.asc("partner")], k)


def neighbours(docs: DataFrame, window: int = 2, k: int = 5) -> DataFrame:
    """(word, partner, n): the k most frequent neighbours of each word."""
    n = pair_counts(docs, window)
    both = n.select(F.col("a").alias("word"), F.col("b").alias("partner"), "n").unionByName(n.select(F.col("b").alias("word"), F.col("a").alias("partner"), "n"))
    return first_per_key(both, ["word"], [F.desc("n"), F.asc("partner")], k)


def ngram_counts(docs: DataFrame, n: int) -> DataFrame:
    """(gram, count) of n-grams within each row's tokens."""
    return docs.select(F.explode(T.ngrams(F.col("tokens"), n)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("count"))


def idf(docs: DataFrame) -> DataFrame:
    """(word, df, idf): ln((1 + N) / (1 + df)) + 1 over rows of tokens, six digits."""
    total = docs.agg(F.count(F.lit(1)).alias("rows"))
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(total)).select("word", "df", F.round(F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1, 6).alias("idf"))  # one row


def top_terms(docs: DataFrame, k: int = 5, least: int = 2) -> DataFrame:
    """(doc_id, word, score): the k terms of each row with the largest count times idf, three digits."""
    tf = docs.select("doc_id", F.explode("tokens").alias("word")).where(F.length("word") >= least).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    score = tf.join(idf(docs).select("word", "idf"), "word").select("doc_id", "word", F.round(F.col("tf") * F.col("idf"), 3).alias("score"))
    return first_per_key(score, ["doc_id"], [F.desc("score"), F.asc("word")], k)


def summary(docs: DataFrame) -> DataFrame:
    """One row of totals over (doc_id, text, tokens): records, characters, words, distinct words, shortest, longest, upper median of words."""
    n = F.size("tokens")
    flat = docs.select(F.explode("tokens").alias("w")).agg(F.count_distinct("w").alias("distinct_words"))
    sizes = docs.groupBy(n.alias("size")).agg(F.count(F.lit(1)).alias("c"))
    one = docs.agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("text")).alias("chars"), F.sum(n).alias("words"), F.min(n).alias("shortest"), F.max(n).alias("longest"))
    # sizes: a row for each length; the upper median is the first length with more than half of the rows up to it
    upto = sizes.withColumn("upto", F.sum("c").over(Window.orderBy("size"))).join(F.broadcast(one.select("records")))
    median = upto.where(F.expr("upto > records div 2")).agg(F.min("size").alias("upper_median"))
    return one.join(F.broadcast(flat)).join(F.broadcast(median))


def openers(paragraphs: DataFrame, least: int = 5, documents: int = 3, lift: float = 2.0) -> DataFrame:
    """(marker, n, docs, lift, confidence): first words of paragraphs that are much likelier there than anywhere."""
    starts = paragraphs.where(F.size("tokens") > 0).select("doc_id", F.element_at("tokens", 1).alias("marker"))
    whole = paragraphs.select(F.explode("tokens").alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("everywhere"))
    totals = starts.agg(F.count(F.lit(1)).alias("n_starts")).join(F.broadcast(whole.agg(F.sum("everywhere").alias("n_all"))))
    s = starts.groupBy("marker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).where(F.col("docs") >= documents)
    j = s.join(whole, "marker").join(F.broadcast(totals)).where(F.expr(f"n >= greatest({least}, ceil(0.001 * n_starts))"))
    j = j.withColumn("lift", F.round((F.col("n") / F.col("n_starts")) / (F.col("everywhere") / F.col("n_all")), 4)).where(F.col("lift") >= lift)
    return j.select("marker", "n", "docs", "lift", F.round(F.least(F.lit(1.0), F.col("lift") / 10), 4).alias("confidence"))


def position_histogram(docs: DataFrame) -> DataFrame:
    """(word, first, middle, last): where in its row each token stands; a lone token is first."""
    size = F.size("tokens")
    e = docs.select(size.alias("size"), F.posexplode("tokens").alias("at", "word"))
    return e.groupBy("word").agg(F.count_if(F.col("at") == 0).alias("first"), F.count_if((F.col("at") > 0) & (F.col("at") < F.col("size") - 1)).alias("middle"), F.count_if((F.col("at") > 0) & (F.col("at") == F.col("size") - 1)).alias("last"))


def contexts(docs: DataFrame, lexicon: DataFrame, k: int = 3, width: int = 200) -> DataFrame:
    """(word, doc_id, snippet): the first k rows that hold each listed word, in one pass over the corpus."""
    e = docs.select("doc_id", F.substring("text", 1, width).alias("snippet"), F.explode(F.array_distinct("tokens")).alias("word"))
    return first_per_key(e.join(lexicon.select("word").distinct(), "word"), ["word"], [F.asc("doc_id")], k)


def layers(docs: DataFrame) -> DataFrame:
    """(level, n, tokens): lines, paragraphs, documents and corpus, each rolled up from the one below."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.trim("line") != "")
    line = lines.select("doc_id", "at", F.size(T.tokens(F.col("line"))).alias("tokens"))
    doc = line.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("lines"))
    rolled = doc.agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    kinds = F.array(F.struct(F.lit("line").alias("level"), F.col("lines").alias("n"), "tokens"), F.struct(F.lit("document").alias("level"), F.col("documents").alias("n"), "tokens"), F.struct(F.lit("corpus").alias("level"), F.lit(1).cast("long").alias("n"), "tokens"))
    return rolled.select(F.explode(kinds).alias("x")).select("x.*")


def predict_next(bigrams: DataFrame, unigrams: DataFrame, words: DataFrame, k: int = 3) -> DataFrame:
    """(word, next, n): the k likeliest next words; words never followed get the most frequent words instead."""
    b = bigrams.select(F.split("gram", " ")[0].alias("word"), F.split("gram", " ")[1].alias("next"), F.col("count").alias("n"))
    hit = first_per_key(b.join(words, "word"), ["word"], [F.desc("n"), F.asc("next")], k)
    common = unigrams.select(F.col("gram").alias("next"), F.col("count").alias("n")).orderBy(F.desc("n"), F.asc("next")).limit(k)
    rest = words.join(hit.select("word").distinct(), "word", "left_anti").join(F.broadcast(common))  # k rows
    return hit.select("word", "next", "n").unionByName(rest.select("word", "next", "n"))


def spell_suggestions(words: DataFrame, lexicon: DataFrame, k: int = 3) -> DataFrame:
    """(word, suggestion, distance): the k nearest entries among those with the same first two letters."""
    a = words.select("word", F.substring("word", 1, 2).alias("block"))
    b = lexicon.select(F.col("word").alias("suggestion"), F.substring("word", 1, 2).alias("block"), "n")
    d = a.join(b, "block").withColumn("distance", F.levenshtein("word", "suggestion"))
    return first_per_key(d, ["word"], [F.asc("distance"), F.desc("n"), F.asc("suggestion")], k).select("word", "suggestion", "distance")



"""Features of sentences, paragraphs and documents, each level rolled up from the one below; clause classes and structures.

Marker lists are parameters. A paragraph is a line of a text, a sentence what stands between . ! ? and white space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators.rows import first_per_key


@dataclass(frozen=True)
class Markers:
    """Words that show negation, questions, conditions, relative and temporal clauses, and joined clauses."""

    negative: tuple[str, ...] = ("not", "no", "nicht", "pas")
    question: tuple[str, ...] = ("what", "who", "why")
    condition: tuple[str, ...] = ("if", "wenn", "si")
    relative: tuple[str, ...] = ("which", "that", "qui", "que")
    time: tuple[str, ...] = ("when", "while", "quand")
    joined: tuple[str, ...] = ("and", "und", "et", "y")
    past: tuple[str, ...] = ("was", "were", "had")
    future: tuple[str, ...] = ("will", "shall", "wird")


def holds(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def clause(text: Column, tokens: Column, m: Markers) -> Column:
    """The first rule that holds: question, negative, conditional, relative, temporal, compound, else statement."""
    rules = [("question", text.endswith("?") | holds(tokens, m.question)), ("negative", holds(tokens, m.negative)), ("conditional", holds(tokens, m.condition)),
             ("relative", holds(tokens, m.relative)), ("temporal", holds(tokens, m.time)), ("compound", holds(tokens, m.joined))]
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules], F.lit("statement"))


def structure(clause_name: Column, n: Column) -> Column:
    """One of four templates: fragment (below three tokens), simple, compound, complex."""
    return F.when(n < 3, "fragment").when(clause_name.isin("conditional", "relative", "temporal"), "complex").when(clause_name == "compound", "compound").otherwise("simple")


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, at, s, tokens) of (doc_id, text)."""
    p = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    s = p.select("doc_id", "paragraph", F.posexplode(T.sentences(F.col("line"))).alias("at", "s"))
    return s.withColumn("tokens", T.tokens(F.col("s")))


def line_features(docs: DataFrame, m: Markers = Markers()) -> DataFrame:
    """Per sentence: n_tokens, clause, structure, first, last, hyphenated, prefixed (first token begins with one of the re-, un- class), chars."""
    t = F.col("tokens")
    s = sentences(docs).withColumn("clause", clause(F.col("s"), t, m)).withColumn("n_tokens", F.size(t))
    return s.select(
        "doc_id", "paragraph", "at", "n_tokens", "clause", structure(F.col("clause"), F.col("n_tokens")).alias("structure"),
        F.coalesce(F.try_element_at(t, F.lit(1)), F.lit("")).alias("first"), F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit("")).alias("last"),
        F.size(F.filter(t, lambda x: x.contains("-"))).alias("hyphenated"), F.exists(t, lambda x: x.startswith("un") | x.startswith("re")).alias("prefixed"), F.length("s").alias("chars"),
    )


def paragraph_features(docs: DataFrame, m: Markers = Markers()) -> DataFrame:
    """Per paragraph: lines, tokens, mean tokens, questions, negations, first and last token, in one pass over its sentences."""
    f = line_features(docs, m)
    edge = F.struct("at", "first", "last")
    g = f.groupBy("doc_id", "paragraph").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("n_tokens").alias("tokens"), F.round(F.avg("n_tokens"), 4).alias("mean_tokens"), F.count_if(F.col("clause") == "question").alias("questions"),
        F.count_if(F.col("clause") == "negative").alias("negations"), F.min(edge).alias("a"), F.max(edge).alias("b"))
    return g.select("doc_id", "paragraph", "lines", "tokens", "mean_tokens", "questions", "negations", F.col("a.first").alias("first"), F.col("b.last").alias("last"))


def document_features(docs: DataFrame, m: Markers = Markers()) -> DataFrame:
    """Per document: paragraphs, lines, tokens, distinct tokens and its most frequent token (the smaller of equals)."""
    p = paragraph_features(docs, m).groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens"))
    words = sentences(docs).select("doc_id", F.explode("tokens").alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    distinct = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("distinct_tokens"))
    top = first_per_key(words, ["doc_id"], [F.desc("n"), F.asc("word")]).select("doc_id", F.col("word").alias("top"))
    return p.join(distinct, "doc_id", "left").join(top, "doc_id", "left").select("doc_id", "paragraphs", "lines", "tokens", F.coalesce("distinct_tokens", F.lit(0)).alias("distinct_tokens"), F.coalesce("top", F.lit("")).alias("top"))


def sentence_analysis(docs: DataFrame, m: Markers = Markers()) -> DataFrame:
    """Per sentence: tokens, negation, question and tense (future before past before present)."""
    t = F.col("tokens")
    tense = F.when(holds(t, m.future), "future").when(holds(t, m.past), "past").otherwise("present")
    return sentences(docs).select("doc_id", "paragraph", "at", F.size(t).alias("n_tokens"), holds(t, m.negative).alias("negated"), (F.col("s").endswith("?") | holds(t, m.question)).alias("asks"), tense.alias("tense"))


def paragraph_analysis(docs: DataFrame) -> DataFrame:
    """Per paragraph: style (by mean sentence length), variety of words and cohesion, the mean word overlap of neighbouring sentences."""
    s = sentences(docs).select("doc_id", "paragraph", "at", F.array_distinct("tokens").alias("t"), F.size("tokens").alias("n"))
    listed = s.groupBy("doc_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("at", "t", "n"))).alias("l"))
    sizes = F.transform("l", lambda x: x.n)
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    kinds = F.size(F.array_distinct(F.flatten(F.transform("l", lambda x: x.t))))
    near = F.when(F.size("l") > 1, F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: T.overlap(F.element_at("l", i).t, F.element_at("l", i + 1).t)))
    cohesion = F.when(F.size("l") > 1, F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / (F.size("l") - 1)).otherwise(0.0)
    mean = total / F.size("l")
    style = F.when(mean > 12, "long").when(mean > 6, "plain").otherwise("short")
    return listed.select("doc_id", "paragraph", style.alias("style"), F.round(F.when(total > 0, kinds / total).otherwise(0.0), 4).alias("variety"), F.round(cohesion, 4).alias("cohesion"))


def arcs(docs: DataFrame, verbs: tuple[str, ...], objects: tuple[str, ...]) -> DataFrame:
    """(doc_id, paragraph, at, token, head, relation): a flat tree with the verb-final heuristic.

    The root is the last token among `verbs`, else the last token. A token before it is its object if it is among `objects`,
    else its subject if it is the first token, else a modifier of the token behind it; tokens behind the root are marks.
    """
    s = sentences(docs).where(F.size("tokens") > 0)
    known = F.array(*map(F.lit, verbs))
    last = F.aggregate(F.sequence(F.lit(1), F.size("tokens")), F.lit(0), lambda a, i: F.when(F.array_contains(known, F.element_at("tokens", i)), i).otherwise(a))
    s = s.withColumn("root", F.when(last > 0, last).otherwise(F.size("tokens")))
    e = s.select("doc_id", "paragraph", F.col("at").alias("sentence"), "root", F.posexplode("tokens").alias("k", "token")).withColumn("at", F.col("k") + 1)
    obj = F.col("token").isin(*objects)
    relation = F.when(F.col("at") == F.col("root"), "root").when(F.col("at") > F.col("root"), "mark").when(obj, "obj").when(F.col("at") == 1, "nsubj").otherwise("mod")
    head = F.when(relation == "root", 0).when(relation == "mod", F.col("at") + 1).otherwise(F.col("root"))
    return e.select("doc_id", "paragraph", "sentence", "at", "token", head.alias("head"), relation.alias("relation"))

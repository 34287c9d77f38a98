"""Hypotheses from a corpus: parts of speech, morphology, sentence patterns, grammar, merged collocations, pattern counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.rows import first_per_key


def rule_tags(counts: DataFrame, closed: dict[str, str], suffixes: dict[str, str], default: str = "NOUN") -> DataFrame:
    """(word, tag, n): a rule tagger over (word, n): closed classes, then the longest suffix, else the default."""
    table = F.create_map(*[F.lit(x) for kv in closed.items() for x in kv])
    tail = F.coalesce(*[F.when(F.col("word").endswith(s), F.lit(t)) for s, t in sorted(suffixes.items(), key=lambda x: (-len(x[0]), x[0]))], F.lit(default))
    return counts.select("word", F.coalesce(F.try_element_at(table, F.col("word")), tail).alias("tag"), "n")


def tag_counts(words: DataFrame, closed: dict[str, str], suffixes: dict[str, str], default: str = "NOUN") -> DataFrame:
    """(word, tag, n): the rule tagger over the words of a table (word)."""
    return rule_tags(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), closed, suffixes, default)


def pos_hypotheses(tagged: DataFrame, dictionary: DataFrame, weight: int = 10) -> DataFrame:
    """(word, tag, votes, confidence): the tag with most votes, a dictionary entry (word, tag) counting `weight` times; the smaller of equals."""
    votes = tagged.select("word", "tag", F.col("n").alias("votes")).unionByName(dictionary.join(tagged.select("word").distinct(), "word", "left_semi").select("word", "tag", F.lit(weight).cast("long").alias("votes")))
    s = votes.groupBy("word", "tag").agg(F.sum("votes").alias("votes"))
    every = s.groupBy("word").agg(F.sum("votes").alias("all"))
    return first_per_key(s, ["word"], [F.desc("votes"), F.asc("tag")]).join(every, "word").select("word", "tag", "votes", F.round(F.col("votes") / F.col("all"), 4).alias("confidence"))


def morphology(words: DataFrame, prefixes: list[str], suffixes: list[str]) -> DataFrame:
    """(word, relation, part): a row for each affix whose removal leaves another attested word of three letters or more."""
    w = words.select("word").distinct()
    cut = [(p, "prefix", F.col("word").startswith(p), F.expr(f"substring(word, {len(p) + 1})")) for p in prefixes] + [(s, "suffix", F.col("word").endswith(s), F.expr(f"substring(word, 1, length(word) - {len(s)})")) for s in suffixes]
    found = F.array(*[F.when(c, F.struct(F.lit(k).alias("relation"), F.lit(a).alias("part"), root.alias("root"))) for a, k, c, root in cut])
    e = w.select("word", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("word", "x.*").where("length(root) >= 3")
    return e.join(w.select(F.col("word").alias("root")), "root").select("word", "relation", "part", "root")


def sentence_patterns(features: DataFrame, most: int = 50) -> DataFrame:
    """(clause, pattern, n): at most `most` distinct patterns (structure and length class) of each clause, by count, then name."""
    length = F.when(F.col("n_tokens") < 5, "short").when(F.col("n_tokens") < 12, "middle").otherwise("long")
    g = features.groupBy("clause", F.concat_ws("/", "structure", length, F.when(F.col("prefixed"), "prefixed").otherwise("plain")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return first_per_key(g, ["clause"], [F.desc("n"), F.asc("pattern")], most)


def phenomena(sentences: DataFrame, markers: dict[str, list[str]], least: int = 1) -> DataFrame:
    """(kind, marker, n, docs): how many sentences and documents hold each marker; each (kind, marker) once."""
    known = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(m).alias("marker")) for k, ms in markers.items() for m in ms])
    e = sentences.select("doc_id", F.explode(F.filter(known, lambda x: F.array_contains(F.col("tokens"), x.marker))).alias("x"))
    g = e.groupBy("x.kind", "x.marker", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("kind", "marker").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).where(F.col("n") >= least)


def merged_collocations(pairs: DataFrame, least: int, pmi: float, most: int = 2000) -> DataFrame:
    """(a, b, n, pmi): both orders of a pair (first, second, n, pmi) as one, counts summed, the largest PMI kept, the `most` best."""
    g = pairs.groupBy(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b")).agg(F.sum("n").alias("n"), F.max("pmi").alias("pmi"))
    return g.where((F.col("n") >= least) & (F.col("pmi") >= pmi)).orderBy(F.desc("pmi"), F.desc("n"), "a", "b").limit(most)


def across_records(docs: DataFrame, order: str) -> DataFrame:
    """(gram, n): bigrams of the corpus read as one text in the order of the records, those across two records included.

    Within a record they are counted there; across, the last token of a record meets the first of the next one that has any.
    """
    inner = docs.where(F.size("tokens") > 1).select(F.explode(F.zip_with(F.slice("tokens", F.lit(1), F.size("tokens") - 1), F.slice("tokens", F.lit(2), F.size("tokens") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).alias("gram"))
    edges = docs.where(F.size("tokens") > 0).select(order, F.element_at("tokens", 1).alias("a"), F.element_at("tokens", -1).alias("b"))
    # records in one global order without one task for all: neighbours within key ranges, then across range borders
    span = F.floor(F.col(order) / 10_000)
    from pyspark.sql.window import Window

    e = edges.withColumn("span", span)
    near = e.select(F.lead("a").over(Window.partitionBy("span").orderBy(order)).alias("next"), "b").where("next is not null")
    ends = e.groupBy("span").agg(F.min(F.struct(order, "a")).alias("x"), F.max(F.struct(order, "b")).alias("y"))
    border = ends.select(F.lead("x.a").over(Window.orderBy("span")).alias("next"), F.col("y.b").alias("b")).where("next is not null")
    cross = near.unionByName(border).select(F.concat("b", F.lit(" "), "next").alias("gram"))
    return inner.unionByName(cross).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def related_words(words: DataFrame, query: str, tags: DataFrame, least: int = 2, k: int = 10) -> DataFrame:
    """(word, shared, n): other words of the query's tag that share at least `least` first letters, by shared letters, count and word."""
    from heddle.functions import text as T

    tag = tags.where(F.col("word") == query).select("tag")
    same = tags.select("word", "tag").where((F.col("word") != query) & F.col("word").startswith(query[:least])).join(F.broadcast(tag), "tag")  # one row
    return same.join(words.select("word", "n"), "word").select("word", T.shared_prefix(F.col("word"), F.lit(query)).alias("shared"), "n").orderBy(F.desc("shared"), F.desc("n"), "word").limit(k)

"""Token-level judgements against lexicons and sets: attestation, coverage, topics, registers, staged translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators.rows import first_per_key


def attestation(docs: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, n, attested, score, verdict): how many tokens are in known (word, weight), weight 1 verified, .5 attested."""
    e = docs.select("doc_id", F.explode("tokens").alias("word")).where(F.length("word") >= least).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("c"))
    j = e.join(known.groupBy("word").agg(F.max("weight").alias("weight")), "word", "left")
    g = j.groupBy("doc_id").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("weight").isNotNull(), F.col("c")).otherwise(0)).alias("attested"), F.round(F.sum(F.col("c") * F.coalesce("weight", F.lit(0.0))) / F.sum("c"), 4).alias("score"))
    return g.withColumn("verdict", F.when(F.col("score") >= 0.8, "PASS").when(F.col("score") >= 0.5, "PARTIAL").otherwise("FAIL"))


def attestation_index(sources: dict[str, DataFrame]) -> DataFrame:
    """(word, source), distinct, from several (word) tables."""
    out = None
    for name, df in sources.items():
        d = df.select("word", F.lit(name).alias("source")).distinct()
        out = d if out is None else out.unionByName(d)
    return out


def topic(tokens: Column, topics: dict[str, list[str]]) -> Column:
    """The topic with the largest share of its key words present, the earlier of equals; `none` without any."""
    share = {name: F.size(F.array_intersect(tokens, F.array(*map(F.lit, words)))) / F.lit(len(words)) for name, words in topics.items()}
    most = F.greatest(*share.values()) if len(share) > 1 else next(iter(share.values()))
    out = F.when(most == 0, "none")
    for name, s in share.items():
        out = out.when(s == most, name)
    return out


def register(tokens: Column) -> Column:
    """literary, formal or common by mean word length and variety."""
    n = F.size(tokens)
    mean = F.aggregate(tokens, F.lit(0), lambda a, x: a + F.length(x)) / n
    variety = F.size(F.array_distinct(tokens)) / n
    score = F.when(mean > 6, 2).when(mean > 5, 1).otherwise(0) + F.when(variety > 0.8, 1).otherwise(0)
    return F.when(n == 0, "none").when(score >= 3, "literary").when(score >= 2, "formal").otherwise("common")


def tiered_lookup(words: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """(word, target, tier): for each word the target of the first tier (word, target) that has it; ties by target."""
    every = None
    for k, df in enumerate(tiers, 1):
        t = df.select("word", "target", F.lit(k).alias("tier"))
        every = t if every is None else every.unionByName(t)
    return words.join(first_per_key(every.join(words, "word", "left_semi"), ["word"], [F.asc("tier"), F.asc("target")]), "word", "left")


def segment_depths(lines: DataFrame) -> DataFrame:
    """(doc_id, at, similarity, depth) of (doc_id, at, tokens): overlap with the line before and how deep it dips below its neighbours."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id").orderBy("at")
    s = lines.withColumn("similarity", F.round(F.coalesce(T.overlap(F.array_distinct("tokens"), F.array_distinct(F.lag("tokens").over(w))), F.lit(0.0)), 4)).drop("tokens")
    depth = (F.lag("similarity").over(w) + F.lead("similarity").over(w)) / 2 - F.col("similarity")
    return s.withColumn("depth", F.round(F.coalesce(depth, F.lit(0.0)), 6))

"""Consensus over evidence rows (key, value, tier, source, confidence) and quality bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.operators.rows import first_per_key


def majority(votes: DataFrame, threshold: float) -> DataFrame:
    """(key, value, votes, agreement, accepted): the most frequent value of each key, the smaller of equals."""
    n = votes.groupBy("key", "value").agg(F.count(F.lit(1)).alias("votes"))
    n = n.withColumn("total", F.sum("votes").over(Window.partitionBy("key")))
    best = first_per_key(n, ["key"], [F.desc("votes"), F.asc("value")])
    share = F.round(F.col("votes") / F.col("total"), 4)
    return best.select("key", "value", "votes", share.alias("agreement"), (share >= threshold).alias("accepted"))


def weighted(evidence: DataFrame, weight: Column, threshold: float, least_share: float = 0.5) -> DataFrame:
    """(key, value, share, accepted): the value with the largest sum of tier weight times confidence."""
    s = evidence.groupBy("key", "value").agg(F.sum(weight * F.col("confidence")).alias("score"), F.sum(weight).alias("weight"))
    s = s.withColumn("all", F.sum("score").over(Window.partitionBy("key")))
    best = first_per_key(s, ["key"], [F.desc(F.round("score", 6)), F.asc("value")])
    share, level = F.col("score") / F.col("all"), F.col("score") / F.col("weight")
    return best.select("key", "value", F.round(share, 4).alias("share"), ((F.round(share, 6) >= least_share) & (F.round(level, 6) >= threshold)).alias("accepted"))


def tier_gate(evidence: DataFrame, weight: Column, tiers: int, confidence: float) -> DataFrame:
    """(key, tiers, confidence, accepted): enough distinct tiers and enough weighted confidence."""
    g = evidence.groupBy("key").agg(F.count_distinct("tier").alias("tiers"), F.round(F.sum(weight * F.col("confidence")) / F.sum(weight), 6).alias("confidence"))
    return g.withColumn("accepted", (F.col("tiers") >= tiers) & (F.col("confidence") >= confidence))


def routed(scored: DataFrame, score: str, auto: float = 0.95, verify: float = 0.70) -> DataFrame:
    """Adds `route`: auto, verifier or review."""
    return scored.withColumn("route", F.when(F.col(score) >= auto, "auto").when(F.col(score) >= verify, "verifier").otherwise("review"))


def track_record(accuracy: Column, topic: Column, penalty: Column, recent: Column) -> Column:
    """.4 accuracy + .3 topic + .2 (1 - penalty) + .3 recent, held between .1 and .95."""
    return F.least(F.lit(0.95), F.greatest(F.lit(0.1), 0.4 * accuracy + 0.3 * topic + 0.2 * (1 - penalty) + 0.3 * recent))


def health_band(percent: Column) -> Column:
    return F.when(percent > 90, "healthy").when(percent > 70, "fair").otherwise("poor")

"""Evaluation metrics over tables of gold and predicted values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame) -> DataFrame:
    """(gold, pred, n)."""
    return pairs.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def per_tag(pairs: DataFrame) -> DataFrame:
    """(tag, precision, recall, f1), four digits; 0 where undefined."""
    c = confusion(pairs)
    tags = c.select(F.explode(F.array(F.struct(F.col("gold").alias("tag"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("gold_n"), F.lit(0).cast("long").alias("pred_n")), F.struct(F.col("pred").alias("tag"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("gold_n"), F.col("n").alias("pred_n")))).alias("x")).select("x.*")
    g = tags.groupBy("tag").agg(F.sum("hit").alias("hit"), F.sum("gold_n").alias("gold_n"), F.sum("pred_n").alias("pred_n"))
    p = F.when(F.col("pred_n") > 0, F.col("hit") / F.col("pred_n")).otherwise(0.0)
    r = F.when(F.col("gold_n") > 0, F.col("hit") / F.col("gold_n")).otherwise(0.0)
    return g.select("tag", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"))


def boundary_scores(pairs: DataFrame) -> DataFrame:
    """(id, precision, recall, exact) of segmentations (id, gold, pred: arrays of parts) by where parts end; linear in their number.

    Empty parts end where the part before does. Only the lengths of the parts leave the JVM.
    """

    @F.pandas_udf("precision double, recall double")
    def scored(gold: pd.Series, pred: pd.Series) -> pd.DataFrame:
        rows = []
        for g, p in zip(gold, pred, strict=True):
            g, p = (np.unique(np.cumsum(np.asarray(x if x is not None else [], np.int64))) for x in (g, p))
            met = len(np.intersect1d(g, p, assume_unique=True))
            rows.append((met / len(p) if len(p) else 0.0, met / len(g) if len(g) else 0.0))
        return pd.DataFrame(rows, columns=["precision", "recall"])

    sizes = lambda c: F.transform(c, F.length)
    s = pairs.select("id", (F.col("gold") == F.col("pred")).alias("exact"), scored(sizes("gold"), sizes("pred")).alias("s"))
    return s.select("id", F.round("s.precision", 4).alias("precision"), F.round("s.recall", 4).alias("recall"), "exact")


def mcnemar(pairs: DataFrame) -> DataFrame:
    """One row (b, c, chi2): discordant counts of two systems and the continuity-corrected statistic."""
    s = pairs.agg(F.count_if(F.col("first") & ~F.col("second")).alias("b"), F.count_if(~F.col("first") & F.col("second")).alias("c"))
    d = F.abs(F.col("b") - F.col("c")) - 1
    return s.withColumn("chi2", F.when(F.col("b") + F.col("c") > 0, F.round(F.greatest(d, F.lit(0)) ** 2 / (F.col("b") + F.col("c")), 4)).otherwise(0.0))


def below_floor(scores: DataFrame, floors: DataFrame) -> DataFrame:
    """(metric, value, floor) of metrics under their floors."""
    return scores.join(floors, "metric").where("value < floor").select("metric", "value", "floor")

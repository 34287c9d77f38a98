"""Time series over (ts, ...): windows, percentiles, streaks, folds, alerts. Batch forms; heddle.streaming has the live ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def window_stats(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """(start, n, errors, total) of tumbling or sliding windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("start"), "n", "errors", "total")


def percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nearest-rank percentiles per key."""
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    return df.groupBy(*keys).agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max(value).alias("largest"))


def streaks(events: DataFrame, key: str) -> DataFrame:
    """(key, start, days): runs of consecutive days with an event."""
    day = events.select(key, F.to_date("ts").alias("day")).distinct()
    run = F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    return day.withColumn("run", run).groupBy(key, "run").agg(F.min("day").alias("start"), F.count(F.lit(1)).alias("days")).drop("run")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """(key, start, n): events closer than `gap` belong together."""
    g = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), "n")


def review_fold(reviews: DataFrame, keys: list[str], order: list[str], quality: str) -> DataFrame:
    """(keys, repetition, interval, ease): the spaced-repetition recurrence over each key's reviews in order.

    A quality below 3 starts anew; else intervals go 1, 6, then grow by the ease after this review, rounded up. The ease
    never falls under 1.3. Intervals have no bound and are doubles; the ease is shown with two digits.
    """
    listed = reviews.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(quality).cast("int").alias("q")))).alias("r"))
    start = F.struct(F.lit(0).alias("repetition"), F.lit(0.0).alias("interval"), F.lit(2.5).alias("ease"))

    def step(a, x):
        d = 5 - x.q
        ease = F.greatest(F.lit(1.3), a.ease + (0.1 - d * (0.08 + d * 0.02)))
        interval = F.when((x.q < 3) | (a.repetition == 0), 1.0).when(a.repetition == 1, 6.0).otherwise(F.ceil(a.interval * ease).cast("double"))
        return F.struct(F.when(x.q < 3, 0).otherwise(a.repetition + 1).alias("repetition"), interval.alias("interval"), ease.alias("ease"))

    return listed.select(*keys, F.aggregate("r", start, step).alias("s")).select(*keys, "s.repetition", "s.interval", F.round("s.ease", 2).alias("ease"))


def capped_routes(events: DataFrame, route: str, most: int) -> DataFrame:
    """(route, n) of the `most` busiest routes; the rest together as __other__ (a bounded report, nothing is lost)."""
    n = events.groupBy(route).agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.desc("n"), route).limit(most).select(route, F.lit(True).alias("top"))
    named = n.join(F.broadcast(top), route, "left")
    return named.groupBy(F.when(F.col("top"), F.col(route).cast("string")).otherwise("__other__").alias("route")).agg(F.sum("n").alias("n"))


def alerts(samples: DataFrame, key: str, ts: str, value: str, limit: float) -> DataFrame:
    """(key, since, until, n): runs of consecutive samples above the limit."""
    order = Window.partitionBy(key).orderBy(ts)
    flag = samples.select(key, ts, (F.col(value) > limit).alias("bad"))
    run = F.row_number().over(order) - F.row_number().over(Window.partitionBy(key, "bad").orderBy(ts))
    return flag.withColumn("run", run).where("bad").groupBy(key, "run").agg(F.min(ts).alias("since"), F.max(ts).alias("until"), F.count(F.lit(1)).alias("n")).drop("run")


def rolling_accuracy(decisions: DataFrame, key: str, ts: list[str], correct: str, window: int = 5, decay: float = 0.9) -> DataFrame:
    """(key, ts, score): accuracy of the last decisions, older ones weighted by decay."""
    last = F.collect_list(F.col(correct).cast("double")).over(Window.partitionBy(key).orderBy(*ts).rowsBetween(-window + 1, 0))
    d = decisions.withColumn("__l", last)
    num = F.aggregate("__l", F.lit(0.0), lambda a, x: a * decay + x)
    den = F.aggregate("__l", F.lit(0.0), lambda a, x: a * decay + 1)
    return d.select(key, *ts, F.round(num / den, 4).alias("score"))

"""Queries of time series over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import series as S
from heddle.plans.registry import query
from heddle.tables import load


def events(spark, sf):
    return load(spark, sf, "events")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def tumbling_windows(spark, sf):
    return S.window_stats(events(spark, sf), "1 hour")


@query("""SELECT start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 2) AS total FROM (SELECT *, time_bucket(INTERVAL '30 minutes', ts) - i * INTERVAL '30 minutes' AS start FROM events, range(4) r(i)) GROUP BY 1""")
def sliding_windows(spark, sf):
    return S.window_stats(events(spark, sf), "2 hours", "30 minutes")


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99, max(value) AS largest FROM events GROUP BY 1""")
def nearest_rank_percentiles(spark, sf):
    return S.percentiles(events(spark, sf), ["event_type"], "value")


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), g AS (SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS run FROM d) SELECT user_id, min(day)::VARCHAR AS start, count(*) AS days FROM g GROUP BY user_id, run""")
def activity_streaks(spark, sf):
    return S.streaks(events(spark, sf), "user_id").withColumn("start", F.col("start").cast("string"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    return S.sessions(events(spark, sf), "user_id", "6 hours")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_type, (event_id % 6)::INTEGER AS q, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, event_type, 0::BIGINT AS i, 0 AS repetition, 0.0::DOUBLE AS interval_, 2.5::DOUBLE AS ease FROM (SELECT DISTINCT user_id, event_type FROM o)
UNION ALL SELECT user_id, event_type, i, CASE WHEN q < 3 THEN 0 ELSE repetition + 1 END, CASE WHEN q < 3 OR repetition = 0 THEN 1.0 WHEN repetition = 1 THEN 6.0 ELSE ceil(interval_ * e) END, e
FROM (SELECT o.user_id, o.event_type, o.i, o.q, s.repetition, s.interval_, greatest(1.3::DOUBLE, s.ease + (0.1::DOUBLE - (5 - o.q) * (0.08::DOUBLE + (5 - o.q) * 0.02::DOUBLE))) AS e FROM s JOIN o ON o.user_id = s.user_id AND o.event_type = s.event_type AND o.i = s.i + 1))
SELECT user_id, event_type, repetition, interval_ AS interval, round(ease, 2) AS ease FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY i DESC) AS last FROM s) WHERE last = 1""")
def spaced_repetition(spark, sf):
    e = events(spark, sf).withColumn("quality", F.expr("cast(pmod(event_id, 6) as int)"))
    return S.review_fold(e, ["user_id", "event_type"], ["ts", "event_id"], "quality")


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS r FROM n) SELECT CASE WHEN r <= 10 THEN user_id::VARCHAR ELSE '__other__' END AS route, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def capped_routes(spark, sf):
    return S.capped_routes(events(spark, sf), "user_id", 10)


@query("""WITH f AS (SELECT user_id, ts, value > 10 AS bad FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - row_number() OVER (PARTITION BY user_id, bad ORDER BY ts) AS run FROM f) SELECT user_id, min(ts) AS since, max(ts) AS until, count(*) AS n FROM g WHERE bad GROUP BY user_id, run""")
def alert_runs(spark, sf):
    return S.alerts(events(spark, sf), "user_id", "ts", "value", 10)


@query("""SELECT user_id, ts, event_id, round(list_reduce(list_prepend(0.0::DOUBLE, l), lambda a, x: a * 0.9 + x) / list_reduce(list_prepend(0.0::DOUBLE, list_transform(l, lambda x: 1.0::DOUBLE)), lambda a, x: a * 0.9 + x), 4) AS score FROM (SELECT user_id, ts, event_id, list((event_type <> 'error')::INTEGER::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM events)""")
def rolling_accuracy(spark, sf):
    e = events(spark, sf).withColumn("right", (F.col("event_type") != "error").cast("int"))
    return S.rolling_accuracy(e, "user_id", ["ts", "event_id"], "right")


@query("""SELECT event_type, count(*) AS n, round(min(value), 2) AS smallest, round(max(value), 2) AS largest, arg_max(value, ts) AS latest FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1""")
def metric_statistics(spark, sf):
    e = events(spark, sf).where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 2).alias("smallest"), F.round(F.max("value"), 2).alias("largest"), F.max_by("value", "ts").alias("latest"))


@query("""SELECT event_type, left(user_id::VARCHAR, 1) AS prefix, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2""")
def issue_detection(spark, sf):
    e = events(spark, sf).where(F.col("event_type").isin("error", "signup"))
    return e.groupBy("event_type", F.substring(F.col("user_id").cast("string"), 1, 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))

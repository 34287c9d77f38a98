"""Queries of the relational operators: joins, aggregates, windows, top-k, set operations, changes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.operators import rows
from heddle.plans.registry import query
from heddle.tables import load


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-01-01' GROUP BY ALL""")
def pricing_summary(spark, sf):
    li = load(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-01-01").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'F' GROUP BY n_name HAVING count(DISTINCT o_custkey) > 3""")
def inner_join_distinct_having(spark, sf):
    o = load(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers")).where("n_customers > 3")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def left_anti_missing(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_name")
    return rows.missing_from(c, load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT count(*) AS missing FROM documents LEFT JOIN labels USING (doc_id) WHERE labels.doc_id IS NULL""")
def left_anti_count(spark, sf):
    d, lab = load(spark, sf, "documents").select("doc_id"), load(spark, sf, "labels").select("doc_id")
    return d.join(lab, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


@query("""WITH s AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS sources, max(l_quantity) AS best FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2)
SELECT p_partkey, p_brand, sources, best FROM part JOIN s ON p_partkey = l_partkey
WHERE p_size > 10 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 50)""")
def attested_by_sources(spark, sf):
    li = load(spark, sf, "lineitem")
    s = li.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("sources"), F.max("l_quantity").alias("best")).where("sources >= 2")
    bad = li.where("l_returnflag = 'R' and l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    p = load(spark, sf, "part").where("p_size > 10").select("p_partkey", "p_brand").join(s, F.col("p_partkey") == F.col("l_partkey")).drop("l_partkey")
    return rows.missing_from(p, bad, ["p_partkey"])


@query("""SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right
FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey + 100 AS k FROM orders) b ON a.k = b.k""")
def full_outer_key_compare(spark, sf):
    a = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return rows.compare_keys(a, load(spark, sf, "orders").select((F.col("o_custkey") + 100).alias("k")), "k")


_CDC_OLD = "SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 10 <> 3"
_CDC_NEW = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 10 <> 5"


def _cdc(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    return o.where("k % 10 <> 3"), o.where("k % 10 <> 5").withColumn("s", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("s")))


@query(f"""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'removed' WHEN a.s = b.s AND a.p = b.p THEN 'unchanged' ELSE 'changed' END AS change
FROM ({_CDC_OLD}) a FULL JOIN ({_CDC_NEW}) b ON a.k = b.k""")
def change_capture(spark, sf):
    return rows.changes(*_cdc(spark, sf), "k", ["s", "p"])


@query(f"""SELECT k, s, p, 1 + (k IN (SELECT k FROM ({_CDC_OLD})))::INTEGER AS version FROM ({_CDC_NEW})
UNION ALL SELECT k, s, p, 1 AS version FROM ({_CDC_OLD}) WHERE k NOT IN (SELECT k FROM ({_CDC_NEW}))""")
def bulk_upsert(spark, sf):
    old, new = _cdc(spark, sf)
    return rows.upsert(old.withColumn("version", F.lit(1)), new, ["k"])


@query("""SELECT c_custkey, c_custkey % 5 = 0 AS deleted FROM customer""")
def soft_delete(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey")
    return rows.soft_delete(c, c.where("c_custkey % 5 = 0"), "c_custkey")


@query("""SELECT user_id, arg_max(value, ts) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id""")
def restore_as_of(spark, sf):
    return rows.restore_as_of(load(spark, sf, "events"), "user_id", "value", "ts", F.lit("2024-01-15").cast("timestamp"))


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3""")
def top_k_per_key(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return rows.first_per_key(e, ["user_id", "event_type"], [F.desc("value"), F.asc("event_id")], 3)


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_state_per_key(spark, sf):
    return rows.first_per_key(load(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


_PARTIAL = "SELECT event_id, user_id, nullif(event_type, 'view') AS a, CASE WHEN value > 10 THEN 'x' ELSE '' END AS b, ts FROM events"


@query(f"""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (a IS NOT NULL)::INT + (b <> '')::INT DESC, ts, event_id) AS r FROM ({_PARTIAL})) WHERE r = 1""")
def most_complete_row(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", F.nullif("event_type", F.lit("view")).alias("a"), F.when(F.col("value") > 10, "x").otherwise("").alias("b"), "ts")
    return rows.most_complete(e, ["user_id"], ["a", "b"], [F.asc("ts"), F.asc("event_id")]).select("event_id", "user_id")


@query("""WITH g AS (SELECT *, count(DISTINCT p_type) OVER (PARTITION BY p_brand, p_size) AS kinds, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS least FROM part)
SELECT p_partkey, p_brand, p_size, p_type FROM g WHERE kinds > 1 OR p_partkey = least""")
def collapse_identical_groups(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    return rows.collapse_identical(p, ["p_brand", "p_size"], ["p_type"], "p_partkey")


@query("""SELECT column_name, blank FROM (SELECT count(*) FILTER (event_type IS NULL OR trim(event_type) = '' OR event_type = 'view') AS event_type, count(*) FILTER (props IS NULL) AS props FROM events)
UNPIVOT (blank FOR column_name IN (event_type, props))""")
def null_counts_per_column(spark, sf):
    e = load(spark, sf, "events").select(F.nullif("event_type", F.lit("view")).alias("event_type"), "props")
    return rows.null_counts(e, ["event_type", "props"])


@query("""SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1""")
def duplicate_groups(spark, sf):
    return rows.duplicate_groups(load(spark, sf, "events"), ["user_id", "event_type"])


@query("""SELECT round(count(*) / count(DISTINCT l_orderkey), 4) AS ratio FROM lineitem""")
def duplication_ratio(spark, sf):
    return rows.duplication_ratio(load(spark, sf, "lineitem"), F.col("l_orderkey"))


@query("""SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents""")
def multi_table_counts(spark, sf):
    return rows.row_counts({t: load(spark, sf, t) for t in ("orders", "lineitem", "documents")})


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') GROUP BY 1""")
def foreign_key_orphans(spark, sf):
    parents = load(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return rows.orphans(load(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey", parents, "o_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10""")
def filtered_page(spark, sf):
    return rows.page(load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), {"o_orderstatus": "O"}, ["-o_totalprice", "o_orderkey"], 20, 10).select("o_orderkey", "o_totalprice")


@query("""WITH h AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'ring' THEN 1 WHEN lower(p_name) LIKE 'ring%' THEN 2 WHEN contains(lower(p_name), 'ring') THEN 3 END AS stage FROM part)
SELECT p_partkey, p_name, stage FROM h WHERE stage = (SELECT min(stage) FROM h) ORDER BY p_partkey LIMIT 50""")
def staged_lookup(spark, sf):
    low = F.lower("p_name")
    return rows.fallback_lookup(load(spark, sf, "part").select("p_partkey", "p_name"), [low == "ring", low.startswith("ring"), low.contains("ring")], 50, ["p_partkey"])


@query("""SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY 1""")
def group_concat(spark, sf):
    return load(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))


@query("""SELECT c_mktsegment, n_regionkey, count(*) AS n, grouping(c_mktsegment)::INTEGER + grouping(n_regionkey)::INTEGER AS level
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)""")
def layered_rollup(spark, sf):
    c = load(spark, sf, "customer").join(F.broadcast(load(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows by its schema
    return c.rollup("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), (F.grouping("c_mktsegment").cast("int") + F.grouping("n_regionkey").cast("int")).alias("level"))


@query("""SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def union_distinct(spark, sf):
    a = load(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return a.union(load(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey")).distinct()


@query("""SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'left', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 EXCEPT SELECT s_nationkey FROM supplier)""")
def set_difference(spark, sf):
    a = load(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    b = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    n = F.count(F.lit(1)).alias("n")
    return a.intersect(b).agg(n).select(F.lit("both").alias("side"), "n").union(a.subtract(b).agg(n).select(F.lit("left"), "n"))


@query("""SELECT DISTINCT least(o_custkey, l_suppkey) AS a, greatest(o_custkey, l_suppkey) AS b, count(*) OVER (PARTITION BY least(o_custkey, l_suppkey), greatest(o_custkey, l_suppkey)) AS n
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey""")
def unordered_pair_counts(spark, sf):
    return _pair_counts(load(spark, sf, "orders"), load(spark, sf, "lineitem"))


@query()
def unordered_pair_counts_whole(spark, sf):
    return _pair_counts(load(spark, sf, "orders"), load(spark, sf, "lineitem"))


def _pair_counts(orders, lines):
    o = orders.select("o_orderkey", "o_custkey")
    j = o.join(lines.select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey")).where("o_custkey <> l_suppkey")
    return j.groupBy(F.least("o_custkey", "l_suppkey").alias("a"), F.greatest("o_custkey", "l_suppkey").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, l_linenumber, coalesce(count(*) OVER w, 0) AS n_before, coalesce(sum(l_partkey) OVER w, 0)::BIGINT AS sum_before
FROM (SELECT l_orderkey AS o_orderkey, min(l_linenumber) AS l_linenumber, l_partkey FROM lineitem GROUP BY ALL)
WINDOW w AS (PARTITION BY o_orderkey ORDER BY l_linenumber RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING)""")
def range_context_window(spark, sf):
    return _range_context(load(spark, sf, "lineitem"))


@query()
def range_context_window_whole(spark, sf):
    return _range_context(load(spark, sf, "lineitem"))


def _range_context(lines):
    li = lines.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    w = Window.partitionBy("o_orderkey").orderBy("l_linenumber").rangeBetween(-2, -1)
    return li.select("o_orderkey", "l_linenumber", F.count(F.lit(1)).over(w).alias("n_before"), F.coalesce(F.sum("l_partkey").over(w), F.lit(0)).alias("sum_before"))


@query("""SELECT l_orderkey, max(l_linenumber) - min(l_linenumber) + 1 - count(DISTINCT l_linenumber) AS gaps FROM lineitem GROUP BY 1 HAVING gaps > 0""")
def numbering_gaps(spark, sf):
    g = load(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.max("l_linenumber") - F.min("l_linenumber") + 1 - F.count_distinct("l_linenumber")).alias("gaps"))
    return g.where("gaps > 0")


@query("""SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 1""")
def majority_value(spark, sf):
    return rows.first_per_key(load(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")), ["p_brand"], [F.desc("n"), F.asc("p_type")])


@query("""WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS a, 'n' || n_nationkey AS b FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || n_nationkey, 's' || s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey),
w AS (SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT e.b, depth + 1 FROM w JOIN e ON e.a = w.node WHERE depth < 2) SELECT node, min(depth) AS depth FROM w GROUP BY 1""")
def graph_reach(spark, sf):
    from heddle.operators.graph import reach

    r, n, s = (load(spark, sf, t) for t in ("region", "nation", "supplier"))
    e = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("r"), "r_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    e = e.union(n.join(s, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("s"), "s_suppkey")))
    return reach(e, spark.createDataFrame([("r1",)], "node string"), 2)


@query("""SELECT n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def graph_degree(spark, sf):
    from heddle.operators.graph import degree

    n, s = load(spark, sf, "nation"), load(spark, sf, "supplier")
    return degree(n.join(s, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("src"), F.col("s_name").alias("dst"))).select(F.col("node").alias("n_name"), "n")


@query("""SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part""")
def snapshot_counts(spark, sf):
    return rows.fingerprint(load(spark, sf, "orders"), "orders").unionByName(rows.fingerprint(load(spark, sf, "part"), "part")).select("table_name", "n")


_REPORT = "SELECT n_name AS metric, round(avg(s_acctbal), 2) AS value, CASE WHEN avg(s_acctbal) > {cut} THEN 'green' ELSE 'red' END AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE {rows} GROUP BY 1"


@query(f"""SELECT b.metric, round(b.value - a.value, 4) AS delta, CASE WHEN a.metric IS NULL THEN 'new' WHEN a.status = 'green' AND b.status = 'red' THEN 'regression' WHEN a.status <> b.status THEN 'changed' ELSE 'same' END AS transition
FROM ({_REPORT.format(cut=4000, rows="true")}) b LEFT JOIN ({_REPORT.format(cut=5000, rows="s_suppkey % 3 > 0")}) a USING (metric)""")
def report_compare(spark, sf):
    n, s = load(spark, sf, "nation"), load(spark, sf, "supplier")

    def report(df, cut):
        g = df.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("metric")).agg(F.avg("s_acctbal").alias("v"))
        return g.select("metric", F.round("v", 2).alias("value"), F.when(F.col("v") > cut, "green").otherwise("red").alias("status"))

    return rows.compare_reports(report(s.where("s_suppkey % 3 > 0"), 5000), report(s, 4000))

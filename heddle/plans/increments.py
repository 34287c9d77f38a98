"""Queries of incremental work: staging, changesets, provenance, audits, promotion and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import ledger as L
from heddle.plans.registry import query
from heddle.tables import load


@query("""SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) NOT IN (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0) GROUP BY o_custkey, o_orderstatus""")
def raw_to_staging(spark, sf):
    from heddle.operators.rows import content_hash

    o = load(spark, sf, "orders")
    have = o.where("o_orderkey % 3 = 0").select(content_hash("o_custkey", "o_orderstatus").alias("hash"))
    return L.staged(o.select("o_orderkey", "o_custkey", "o_orderstatus"), have, "o_orderkey", ["o_custkey", "o_orderstatus"]).select("o_orderkey")


@query("""WITH n AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS every, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag DESC) AS r FROM n)
SELECT l_orderkey, l_returnflag, round(n / every, 4) AS share, CASE WHEN round(n / every, 4) >= 0.6 THEN 'canonical' ELSE 'review' END AS target FROM g WHERE r = 1""")
def staging_to_canonical(spark, sf):
    return L.canonical(load(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", 0.6)


_NEW = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders"
_OLD = "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 7 <> 0"


def _versions(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return o.where("o_orderkey % 7 <> 0"), o.withColumn("o_totalprice", F.expr("if(o_orderkey % 5 = 0, o_totalprice + 1, o_totalprice)"))


@query(f"""WITH n AS ({_NEW}), o AS ({_OLD}) SELECT n.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'inserted' ELSE 'updated' END AS kind FROM n LEFT JOIN o USING (o_orderkey) WHERE n.o_orderdate > TIMESTAMP '1995-01-01' AND (o.o_orderkey IS NULL OR n.o_totalprice <> o.o_totalprice)""")
def changeset(spark, sf):
    old, new = _versions(spark, sf)
    return L.changeset(old, new, "o_orderkey", ["o_totalprice"], "o_orderdate", F.lit("1995-01-01").cast("timestamp"))


@query(f"""WITH n AS ({_NEW}), o AS ({_OLD}), c AS (SELECT n.* FROM n LEFT JOIN o USING (o_orderkey) WHERE n.o_orderdate > TIMESTAMP '1995-01-01' AND (o.o_orderkey IS NULL OR n.o_totalprice <> o.o_totalprice)), t AS (SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c) UNION ALL SELECT * FROM c)
SELECT 'applied' AS state, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM t UNION ALL SELECT 'dry run', count(*), round(sum(o_totalprice), 2) FROM o""")
def incremental_pipeline(spark, sf):
    """Detect, apply and report, beside a dry run of the same changeset."""
    old, new = _versions(spark, sf)
    c = L.changeset(old, new, "o_orderkey", ["o_totalprice"], "o_orderdate", F.lit("1995-01-01").cast("timestamp"))
    n = (F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    done = [L.applied(old, new, c, "o_orderkey", dry).agg(*n).select(F.lit(name).alias("state"), "n", "total") for name, dry in (("applied", False), ("dry run", True))]
    return done[0].unionByName(done[1])


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' END AS reason FROM documents)
SELECT doc_id, reason FROM s WHERE reason IS NOT NULL ORDER BY CASE reason WHEN 'failed' THEN 0 WHEN 'changed' THEN 1 ELSE 2 END, doc_id LIMIT 50""")
def incremental_vectors(spark, sf):
    """One bounded batch of rows to embed."""
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"))
    have = d.where("doc_id % 3 <> 0").withColumn("hash", F.expr("if(doc_id % 5 = 0, 'old', hash)"))
    return L.vector_work(d, have, d.where("doc_id % 11 = 0"), "doc_id", 50)


@query("""WITH b AS (SELECT source AS name, count(*) AS n, sum(n_chars) AS h FROM documents WHERE source <> 'src3' GROUP BY 1), a AS (SELECT source AS name, count(*) AS n, sum(n_chars + CASE WHEN source = 'src5' THEN 1 ELSE 0 END) AS h FROM documents WHERE source <> 'src1' AND (source <> 'src2' OR doc_id % 2 = 0) GROUP BY 1)
SELECT name, CASE WHEN a.n IS NULL THEN 'missing' WHEN b.n IS NULL THEN 'new' WHEN a.n <> b.n THEN 'rows' WHEN a.h <> b.h THEN 'hash' ELSE 'same' END AS state FROM b FULL JOIN a USING (name)""")
def provenance_verify(spark, sf):
    d = load(spark, sf, "documents")
    m = lambda df, x: df.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(x).cast("string").alias("hash"))
    return L.provenance(m(d.where("source <> 'src3'"), F.col("n_chars")), m(d.where("source <> 'src1' and (source <> 'src2' or doc_id % 2 = 0)"), F.expr("n_chars + if(source = 'src5', 1, 0)")))


@query("""SELECT o_orderkey, 'o_orderstatus' AS column_name, o_orderstatus AS old, 'X' AS new FROM orders WHERE o_orderkey % 5 = 0 AND o_orderstatus <> 'X' UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::VARCHAR, (o_custkey + 1)::VARCHAR FROM orders WHERE o_orderkey % 3 = 0""")
def audit_log(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    now = o.withColumn("o_orderstatus", F.expr("if(o_orderkey % 5 = 0, 'X', o_orderstatus)")).withColumn("o_custkey", F.expr("if(o_orderkey % 3 = 0, o_custkey + 1, o_custkey)"))
    return L.audit(o, now, "o_orderkey", ["o_orderstatus", "o_custkey"])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS l_suppkey FROM lineitem""")
def reference_remap(spark, sf):
    old = load(spark, sf, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1).alias("new"))
    return L.remapped(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", old)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'unknown' WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'silent' ELSE 'fine' END AS state FROM customer""")
def reference_audit(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey")
    return L.reference_audit(c, "c_custkey", c.where("c_custkey % 9 <> 0"), load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("""WITH e AS (SELECT l_partkey AS hypothesis, count(*) AS n, avg(1 - l_discount) AS c FROM lineitem GROUP BY 1)
SELECT p_partkey AS hypothesis, CASE WHEN p_type IN (SELECT p_type FROM part WHERE p_size = 7) THEN 'duplicate' WHEN n >= 20 AND c >= 0.94 THEN 'promoted' ELSE 'waiting' END AS outcome FROM part LEFT JOIN e ON hypothesis = p_partkey""")
def hypothesis_promotion(spark, sf):
    p, li = load(spark, sf, "part"), load(spark, sf, "lineitem")
    return L.promoted(p.select(F.col("p_partkey").alias("hypothesis"), F.col("p_type").alias("expression")), li.select(F.col("l_partkey").alias("hypothesis"), (1 - F.col("l_discount")).alias("confidence")), p.where("p_size = 7").select(F.col("p_type").alias("expression")), 20, 0.94)


@query("""SELECT column_name, count(*) AS cells, count(*) FILTER (WHERE regexp_matches(x, '\\s\\s')) AS blanks, count(*) FILTER (WHERE x <> lower(x)) AS capitals, count(*) FILTER (WHERE len(x) > 100) AS long FROM (SELECT 'text' AS column_name, text AS x FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE x IS NOT NULL GROUP BY 1""")
def column_audit(spark, sf):
    checks = {"blanks": r"x rlike '\\s\\s'", "capitals": "x <> lower(x)", "long": "length(x) > 100"}
    return L.column_audit(load(spark, sf, "documents"), ["text", "lang", "source"], checks)


@query("""WITH g AS (SELECT source, (count(*) < 5)::INTEGER + (count(DISTINCT lang) < 4)::INTEGER + (min(n_chars) < 50)::INTEGER + (max(n_chars) > 20000)::INTEGER + (avg(n_chars) < 2000)::INTEGER AS failed FROM documents GROUP BY 1)
SELECT source, failed, CASE WHEN failed >= 3 THEN 'critical' WHEN failed >= 1 THEN 'warning' ELSE 'ok' END AS verdict FROM g""")
def verification_checks(spark, sf):
    n = F.col("n_chars")
    one = lambda c: c.cast("int")
    failed = one(F.count(F.lit(1)) < 5) + one(F.count_distinct("lang") < 4) + one(F.min(n) < 50) + one(F.max(n) > 20000) + one(F.avg(n) < 2000)
    return load(spark, sf, "documents").groupBy("source").agg(failed.alias("failed")).withColumn("verdict", L.verdict(F.col("failed")))


@query("""SELECT 'orders' AS table_name, count(*) FILTER (WHERE o_orderkey IS NULL OR o_custkey IS NULL) AS incomplete, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FILTER (WHERE c_custkey IS NULL OR coalesce(c_name, '') = ''), count(*) FROM customer""")
def key_completeness(spark, sf):
    n = F.count(F.lit(1)).alias("n")
    o = load(spark, sf, "orders").agg(F.count_if(F.col("o_orderkey").isNull() | F.col("o_custkey").isNull()).alias("incomplete"), n)
    c = load(spark, sf, "customer").agg(F.count_if(F.col("c_custkey").isNull() | (F.coalesce("c_name", F.lit("")) == "")).alias("incomplete"), n)
    return o.select(F.lit("orders").alias("table_name"), "incomplete", "n").unionByName(c.select(F.lit("customer").alias("table_name"), "incomplete", "n"))


@query("""SELECT * FROM (SELECT 'orders' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'sum of lines', sum(l_quantity) FROM lineitem UNION ALL SELECT 'silent customers', count(*)::DOUBLE FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'returned share', round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 2) FROM lineitem) SELECT metric, round(value, 2) AS value, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band""".replace("SELECT * FROM (SELECT 'orders'", "WITH m AS (SELECT 'orders'").replace("FROM lineitem) SELECT metric", "FROM lineitem) SELECT metric") + " FROM m")
def metric_evaluator(spark, sf):
    """Metrics by kind: a count, a sum, a count of zeros of a map, a ratio as percent; each with its band."""
    c = lambda df, e, n: df.agg(e.cast("double").alias("value")).select(F.lit(n).alias("metric"), "value")
    o, li = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    silent = load(spark, sf, "customer").join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    every = [c(o, F.count(F.lit(1)), "orders"), c(li, F.sum("l_quantity"), "sum of lines"), c(silent, F.count(F.lit(1)), "silent customers"), c(li, F.round(100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1)), 2), "returned share")]
    out = every[0]
    for m in every[1:]:
        out = out.unionByName(m)
    return out.select("metric", F.round("value", 2).alias("value"), F.when(F.col("value") > 50, "high").otherwise("low").alias("band"))


@query("""WITH log AS (SELECT 'documents' AS table_name, count(*) AS rows_imported, CASE WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS status FROM labels GROUP BY quality UNION ALL SELECT 'orders', count(*), 'completed' FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'psalms', count(*), 'completed' FROM documents GROUP BY lang),
live AS (SELECT 'documents' AS table_name, count(*) AS live FROM documents UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer)
SELECT table_name, claimed, live, live - claimed AS difference, CASE WHEN live IS NULL THEN 'no table' WHEN live = claimed THEN 'ok' ELSE 'mismatch' END AS outcome FROM (SELECT table_name, sum(rows_imported)::BIGINT AS claimed FROM log WHERE status = 'completed' GROUP BY 1) LEFT JOIN live USING (table_name)""")
def import_reconciliation(spark, sf):
    """What import batches claim, by their states, against the live tables."""
    n = F.count(F.lit(1))
    batch = lambda table, by, name, status: load(spark, sf, table).groupBy(by).agg(n.alias("rows_imported")).select(F.lit(name).alias("table_name"), "rows_imported", status.alias("status"))
    done = F.lit("completed")
    log = batch("labels", "quality", "documents", F.when(F.col("quality") == 1, "completed").otherwise("failed")).unionByName(batch("orders", "o_orderstatus", "orders", done)).unionByName(batch("documents", "lang", "psalms", done))
    one = lambda t: load(spark, sf, t).agg(n.alias("rows")).select(F.lit(t).alias("table_name"), "rows")
    return L.reconciled(log, one("documents").unionByName(one("orders")).unionByName(one("customer")))


_LIMITS = [("empty texts", "lower", 0.0, 5.0), ("languages", "higher", 9.0, 4.0), ("mean length", "higher", 100.0, None), ("longest", "lower", 10.0, 100.0), ("sources", "info", None, None), ("of no source", "lower", None, None), ("smallest label", None, -1.0, None), ("not measured", "lower", 1.0, 2.0)]


@query("""WITH m AS (SELECT unnest([{'metric': 'empty texts', 'value': count(*) FILTER (WHERE coalesce(text, '') = '')::DOUBLE}, {'metric': 'languages', 'value': count(DISTINCT lang)::DOUBLE}, {'metric': 'mean length', 'value': avg(n_chars)}, {'metric': 'longest', 'value': max(n_chars)::DOUBLE}, {'metric': 'sources', 'value': count(DISTINCT source)::DOUBLE}, {'metric': 'of no source', 'value': count(*) FILTER (WHERE source IS NULL)::DOUBLE}, {'metric': 'not measured', 'value': NULL::DOUBLE}], recursive := true) FROM documents UNION ALL SELECT 'smallest label', min(quality)::DOUBLE FROM labels)
SELECT metric, round(value, 4) AS value, CASE metric WHEN 'sources' THEN 'info' WHEN 'not measured' THEN 'absent' WHEN 'empty texts' THEN CASE WHEN value <= 0 THEN 'green' WHEN value <= 5 THEN 'amber' ELSE 'red' END
WHEN 'languages' THEN CASE WHEN value >= 9 THEN 'green' WHEN value >= 4 THEN 'amber' ELSE 'red' END WHEN 'mean length' THEN CASE WHEN value >= 100 THEN 'green' ELSE 'amber' END
WHEN 'longest' THEN CASE WHEN value <= 10 THEN 'green' WHEN value <= 100 THEN 'amber' ELSE 'red' END WHEN 'of no source' THEN 'amber' ELSE CASE WHEN value <= -1 THEN 'green' ELSE 'amber' END END AS status FROM m""")
def metric_bands(spark, sf):
    """Measured values against limits in both directions, some without a limit."""
    from heddle.operators.routine import threshold_status

    d, one = load(spark, sf, "documents"), lambda c: c.cast("double")
    row = d.agg(one(F.count_if(F.coalesce("text", F.lit("")) == "")).alias("empty texts"), one(F.count_distinct("lang")).alias("languages"), F.avg("n_chars").alias("mean length"), one(F.max("n_chars")).alias("longest"), one(F.count_distinct("source")).alias("sources"), one(F.count_if(F.col("source").isNull())).alias("of no source"), F.lit(None).cast("double").alias("not measured"))
    m = row.unpivot([], row.columns, "metric", "value").unionByName(load(spark, sf, "labels").agg(one(F.min("quality")).alias("value")).select(F.lit("smallest label").alias("metric"), "value"))
    j = m.join(spark.createDataFrame(_LIMITS, "metric string, direction string, green double, amber double"), "metric")
    return j.select("metric", F.round("value", 4).alias("value"), threshold_status(F.col("value"), F.col("direction"), F.col("green"), F.col("amber")).alias("status"))

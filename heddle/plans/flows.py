"""Queries of streams that keep state: change-driven update and the crawl's frontier."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from heddle.operators import in_place as P
from heddle.plans.folders import checkpoints
from heddle.plans.fragments import TOK
from heddle.plans.registry import query
from heddle.sources import database as DB
from heddle.sources.versions import Versions
from heddle.streaming import frontier as C
from heddle.streaming import updates as U
from heddle.tables import load

_LIVE = "WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' revised edition' ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS seq FROM documents WHERE doc_id % 7 <> 3)"


class Stopped(Exception):
    """Ends a run between a commit and its checkpoint."""


def _updated(spark, sf) -> Versions:
    """Three deliveries of documents as a stream: all, revisions of a third with all others again, removals. The second run ends after its commit, so that Spark replays its batch."""
    root = f"{checkpoints(spark)}/updates-{uuid.uuid4().hex}"
    d = load(spark, sf, "documents").select("doc_id", "text", F.lit(False).alias("deleted"))
    revised = d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" revised edition"))).otherwise(F.col("text")))
    gone = d.where("doc_id % 7 = 3").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"))
    store = Versions(spark, f"{root}/store")
    for k, delivery in enumerate((d, revised, gone)):
        delivery.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(d.schema).parquet(f"{root}/in")

        def fail(batch_id, said, k=k):
            if k == 1 and not said.get("replayed"):
                raise Stopped

        try:
            U.follow(stream, store, f"{root}/checkpoint", after=fail, key="doc_id")
        except Exception:
            if k != 1:
                raise
            U.follow(stream, store, f"{root}/checkpoint", after=fail, key="doc_id")
    return store


@query(_LIVE + " SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, seq::BIGINT AS seq FROM f")
def change_driven_records(spark, sf):
    return U.records(_updated(spark, sf), "doc_id").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "seq")


@query(_LIVE + f", w AS (SELECT doc_id, unnest({TOK.format('text')}) AS word FROM f) SELECT word, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_records FROM w GROUP BY 1")
def change_driven_words(spark, sf):
    return U.words(_updated(spark, sf))


_ADDRESS = r"regexp_replace(lower(regexp_extract(u, '^[^/?]*')) || substr(u, length(regexp_extract(u, '^[^/?]*')) + 1), '/+$', '')"
_FETCHED = rf"""WITH c AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u0 FROM pages),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(u0, '([?&])((utm_[a-z]+|ref|fbclid|gclid)=[^&]*(&|$))+', '\1', 'g'), '[?&]$', ''), '^$', '') AS u FROM c),
p AS (SELECT page_id, {_ADDRESS} AS address, html FROM s),
f AS (SELECT address, page_id, html, 60 + page_id * 60 AS sec FROM p UNION ALL SELECT address, page_id, CASE WHEN page_id % 3 = 0 THEN html || '<!-- new -->' ELSE html END, 1000000 + page_id * 60 FROM p)"""


def _crawled(spark, sf) -> str:
    """All pages fetched, and again a day and more later by a second run, when a third has changed; returns the folder of both streams.

    Fetches come in the order of time: where the first run still goes on when the second begins, its later fetches come with the second's.
    """
    root = f"{checkpoints(spark)}/crawl-{uuid.uuid4().hex}"
    p = load(spark, sf, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("text"))
    first = p.withColumn("at", F.timestamp_seconds(60 + F.col("page_id") * 60))
    again = p.withColumn("text", F.when(F.col("page_id") % 3 == 0, F.concat("text", F.lit("<!-- new -->"))).otherwise(F.col("text"))).withColumn("at", F.timestamp_seconds(1_000_000 + F.col("page_id") * 60))
    fetched, second = first.unionByName(again), F.timestamp_seconds(F.lit(1_000_000))
    for delivery in (fetched.where(F.col("at") < second), fetched.where(F.col("at") >= second)):
        delivery.write.mode("append").parquet(f"{root}/in")
        fetched = C.fetches(spark.readStream.schema(delivery.schema).parquet(f"{root}/in"))
        C.run(C.frontier(fetched), f"{root}/events", f"{root}/addresses")
        C.saved_texts(fetched).writeStream.format("noop").option("checkpointLocation", f"{root}/texts").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return root


@query(_FETCHED + """, o AS (SELECT *, lag(html) OVER (PARTITION BY address ORDER BY sec) AS before FROM f),
g AS (SELECT address, count(*) AS visits, count(*) FILTER (WHERE before <> html) AS changes, max(sec) AS sec, sha256(arg_max(html, sec)) AS digest, list(CASE WHEN before IS NULL THEN 1 WHEN before <> html THEN 0.5 ELSE 2 END ORDER BY sec) AS turns FROM o WHERE address <> '' GROUP BY address)
SELECT address, visits::BIGINT AS visits, changes::BIGINT AS changes, digest, (sec + list_reduce(list_prepend(86400.0::DOUBLE, turns::DOUBLE[]), lambda i, x: greatest(3600, least(2592000, floor(i * x)))))::BIGINT AS due FROM g""")
def crawl_frontier(spark, sf):
    s = C.state_table(spark, f"{_crawled(spark, sf)}/addresses", "seen")
    return s.select("address", "visits", "changes", "digest", (F.col("due_ms") / 1000).cast("long").alias("due"))


@query(_FETCHED + " SELECT sha256(html) AS digest, arg_min(address, (sec, address)) AS address, count(*)::BIGINT AS times FROM f WHERE address <> '' GROUP BY 1")
def saved_text_state(spark, sf):
    return C.state_table(spark, f"{_crawled(spark, sf)}/texts", "first").select("digest", "address", "times")


def _squeeze(c):
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


_CLEANED = r"""WITH p AS (SELECT doc_id, source, text, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS n FROM documents),
q AS (SELECT *, CASE WHEN n = '' AND text <> '' THEN text ELSE n END AS new FROM p),
m AS (SELECT source, new, min(doc_id) AS first FROM q WHERE new <> text AND source IS NOT NULL GROUP BY ALL), h AS (SELECT DISTINCT source, text FROM q WHERE source IS NOT NULL),
r AS (SELECT q.*, q.new IS DISTINCT FROM q.text AS moved, q.new IS DISTINCT FROM q.text AND coalesce(h.text IS NOT NULL OR m.first <> q.doc_id, false) AS refused FROM q LEFT JOIN m ON m.source = q.source AND m.new = q.new LEFT JOIN h ON h.source = q.source AND h.text = q.new)"""


def _in_place(spark, sf):
    """Documents whose white space is squeezed in place, texts unique per source; the run is stopped after three batches and resumed."""
    store = Versions(spark, f"{checkpoints(spark)}/cleaned-{uuid.uuid4().hex}")
    store.commit({"documents": load(spark, sf, "documents")})
    how = {"cleaners": {"text": _squeeze}, "unique": [["source", "text"]], "batches": 5}
    P.clean(store, "documents", "doc_id", stop_after=3, **how)
    P.clean(store, "documents", "doc_id", **how)
    return store


@query(_CLEANED + " SELECT doc_id, sha256(coalesce(CASE WHEN refused THEN text ELSE new END, '')) AS text_sha256 FROM r")
def in_place_clean(spark, sf):
    return _in_place(spark, sf).read("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query(_CLEANED + " SELECT doc_id, 'text' AS field, sha256(text) AS old_sha256, sha256(new) AS new_sha256 FROM r WHERE moved AND NOT refused")
def in_place_audit(spark, sf):
    return _in_place(spark, sf).read("documents_audit").select("doc_id", "field", F.sha2("old_value", 256).alias("old_sha256"), F.sha2("new_value", 256).alias("new_sha256"))


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END::DOUBLE AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN '2' ELSE '1' END AS updated_at FROM orders""")
def database_sync(spark, sf):
    """Orders written to a database, then newer rows of a third and older rows of another third; read back in ranges of the key."""
    root = checkpoints(spark)
    if root.split(":")[0] not in (root, "file"):
        raise ValueError("a database in a file needs a shared folder that is mounted")
    folder = root.removeprefix("file:").replace("//", "/")
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/sync-{uuid.uuid4().hex}.db"
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.lit("1").alias("updated_at"))
    DB.write(o, path, "orders", "o_orderkey", "updated_at")
    news = o.where("o_orderkey % 3 <> 2").withColumn("updated_at", F.when(F.col("o_orderkey") % 3 == 0, "2").otherwise("0")).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    DB.write(news, path, "orders", "o_orderkey", "updated_at")
    return DB.read(spark, path, "orders", o.schema, "o_orderkey")

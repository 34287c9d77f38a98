"""Micro-batches that change a table once each, and the state of a crawl with its timers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from heddle.sources.versions import Versions
from heddle.streaming import frontier as C
from heddle.streaming import updates as U


def batch(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, deleted boolean, imported_at string")


def live(store):
    return {r.id: r.text for r in U.records(store).collect()}


def test_batches_converge(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    first = U.apply_batch(store, batch(spark, [(1, "tawng tawng", False, "a"), (2, "lei", None, "a"), (None, "x", False, "a"), (9, "y", True, "a")]), 0)
    assert first == {"new": 2, "changed": 0, "unchanged": 0, "removed": 0, "ignored": 1, "unkeyed": 1, "live": 2, "version": 1}
    again = U.apply_batch(store, batch(spark, [(1, "tawng tawng", False, "b"), (2, "lei", False, "b")]), 1)
    assert (again["unchanged"], again["changed"]) == (2, 0)  # the time of an import is not content
    third = U.apply_batch(store, batch(spark, [(1, "tawng new", False, "c"), (2, None, True, "c"), (3, None, False, "c")]), 2)
    assert (third["changed"], third["removed"], third["new"], third["live"]) == (1, 1, 1, 2)
    assert live(store) == {1: "tawng new", 3: None}
    assert {(r.word, r.n, r.n_records) for r in U.words(store).collect()} == {("tawng", 1, 1), ("new", 1, 1)}
    assert U.apply_batch(store, batch(spark, [(1, "never", False, "d")]), 2) == {"replayed": True}
    U.compact(store)
    assert live(store) == {1: "tawng new", 3: None} and store.manifest().notes["ledger"] == {"main": 2}
    back = U.apply_batch(store, batch(spark, [(2, "lei", False, "e"), (1, None, True, "e")]), 0, stream="other", tag="v2")
    assert (back["new"], back["removed"]) == (1, 1) and store.manifest().notes["tag"] == "v2"
    assert {(r.word, r.n, r.n_records) for r in U.words(store).collect()} == {("lei", 1, 1)}


def test_a_batch_that_empties_the_table_is_refused(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    U.apply_batch(store, batch(spark, [(k, "w", False, "") for k in range(10)]), 0)
    with pytest.raises(U.Regression):
        U.apply_batch(store, batch(spark, [(k, None, True, "") for k in range(5)]), 1, most_change=0.05)
    assert len(live(store)) == 10
    assert U.apply_batch(store, batch(spark, [(0, None, True, "")]), 1, most_change=0.1)["live"] == 9


def test_whole_deliveries_say_what_is_gone(spark):
    new = batch(spark, [(1, "a", False, ""), (2, "b", False, "")]).withColumn("content_hash", F.col("text"))
    old = spark.createDataFrame([(2, "x", "x"), (3, "c", "c")], "id long, content_hash string, text string")
    assert {(r.id, r.status) for r in U.changes(new, old, "id", whole=True).collect()} == {(1, "new"), (2, "changed"), (3, "removed")}
    assert {(r.id, r.status) for r in U.changes(new, old, "id").collect()} == {(1, "new"), (2, "changed")}


def test_last_row_of_a_key_counts(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    U.apply_batch(store, batch(spark, [(1, "old", False, "1"), (1, "newest", False, "3"), (1, "new", False, "2")]), 0, order="imported_at")
    assert live(store) == {1: "newest"}


ADDRESSES = {
    "https://A.Example.org/x/?utm_source=feed": "a.example.org/x",
    "http://a.example.org/x?ref=1&page=2#top": "a.example.org/x?page=2",
    "a.example.org/": "a.example.org",
    "http://a.example.org/X?a=1&gclid=7": "a.example.org/X?a=1",
    " ": "",
}


def test_addresses(spark):
    df = spark.createDataFrame([(u,) for u in ADDRESSES], "u string")
    assert {r.u: r.a for r in df.select("u", C.address(F.col("u")).alias("a")).collect()} == ADDRESSES


def test_frontier_over_a_restart(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    deliveries = [
        [("http://a/1", "one", day), ("http://a/1/", "two", day + dt.timedelta(hours=1)), ("http://b", "one", day), (None, "x", day), ("http://c", "x", None)],
        [("http://a/1", "two", day + dt.timedelta(days=3)), ("http://d", None, day + dt.timedelta(days=3))],
        [("http://d", None, day + dt.timedelta(days=9))],
    ]
    for rows in deliveries:
        spark.createDataFrame(rows, "url string, text string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        fetched = C.fetches(spark.readStream.schema("url string, text string, at timestamp").parquet(str(tmp_path / "in")))
        C.run(C.frontier(fetched), str(tmp_path / "out"), str(tmp_path / "addresses"))
    told = sorted((r.address, r.kind, r.visits) for r in spark.read.schema(C.EVENTS).parquet(str(tmp_path / "out")).collect())
    assert told == sorted([("a/1", "new", 1), ("a/1", "changed", 2), ("b", "new", 1), ("a/1", "unchanged", 3), ("d", "new", 1), ("d", "unchanged", 2), ("b", "due", 1), ("a/1", "due", 3)])  # a visit takes the place of an earlier timer
    state = {r.address: (r.visits, r.changes, r.size, r.interval_s) for r in C.state_table(spark, str(tmp_path / "addresses"), "seen").collect()}
    assert state == {"a/1": (3, 1, 3, 86400), "b": (1, 0, 3, 86400), "d": (2, 0, 0, 172800)}

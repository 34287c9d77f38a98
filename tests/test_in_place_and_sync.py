"""Cleaning in place over stops, and writes to a database that happen once or not at all."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from heddle.operators import in_place as P
from heddle.sources import database as D
from heddle.sources.versions import Versions

SQUEEZE = {"word": lambda c: F.trim(F.regexp_replace(c, " +", " ")), "note": lambda c: F.regexp_replace(c, "<[^>]*>", "")}
ROWS = [(1, "a  b", "x"), (2, "a b", "<b>y</b>"), (3, "c  d", None), (4, "c d ", "<i></i>"), (5, " e", "z"), (6, None, ""), (None, "f  g", "<p>q"), (7, "  ", "w"), (8, "c  d", "v")]
WANT = {1: ("a  b", "x"), 2: ("a b", "y"), 3: ("c d", None), 4: ("c d ", "<i></i>"), 5: ("e", "z"), 6: (None, ""), None: ("f  g", "<p>q"), 7: ("  ", "w"), 8: ("c  d", "v")}


def store_of(spark, path):
    store = Versions(spark, str(path))
    store.commit({"words": spark.createDataFrame(ROWS, "id long, word string, note string")})
    return store


def rows(store):
    return {r.id: (r.word, r.note) for r in store.read("words").collect()}


def test_stopped_and_resumed_equals_one_run(spark, tmp_path):
    whole, cut = store_of(spark, tmp_path / "a"), store_of(spark, tmp_path / "b")
    said = P.clean(whole, "words", "id", SQUEEZE, [["word"]], batches=4)
    assert rows(whole) == WANT and (said["cells"], said["blocked"], said["finished"]) == (3, 2, True)
    assert said["refused"] == 5  # 1: 2 holds it; 4 and 8: 3 comes first; both cells of the row without an id
    first = P.clean(cut, "words", "id", SQUEEZE, [["word"]], batches=4, stop_after=2)
    assert len(first["done"]) == 2 and not first["finished"] and rows(cut) == {r[0]: r[1:] for r in ROWS}
    assert P.clean(cut, "words", "id", SQUEEZE, [["word"]], batches=9) == {**said, "done": [0, 1, 2, 3]}
    assert rows(cut) == WANT
    audit = {(r.id, r.field, r.old_value, r.new_value) for r in cut.read("words_audit").collect()}
    assert audit == {(2, "note", "<b>y</b>", "y"), (3, "word", "c  d", "c d"), (5, "word", " e", "e")}
    again = P.clean(cut, "words", "id", SQUEEZE, [["word"]])
    assert again["cells"] == 0 and rows(cut) == WANT and cut.read("words_audit").count() == 3


def test_keys_of_several_columns(spark):
    df = spark.createDataFrame([(1, "a ", "k"), (2, "a", "l"), (3, "a ", None), (4, "a  ", "k")], "id long, word string, kind string")
    assert {r.id for r in P.refusals(df, "id", {"word": F.trim}, [["word", "kind"]]).collect()} == {4}


def open_rows(path, table="t"):
    return sorted(sqlite3.connect(path).execute(f'SELECT * FROM "{table}"').fetchall(), key=repr)


def left(path):
    return [r[0] for r in sqlite3.connect(path).execute("SELECT name FROM sqlite_master WHERE name LIKE 'stage_%'").fetchall()]


def test_reload_upsert_and_read(spark, tmp_path):
    path = str(tmp_path / "x.db")
    kind = "id long, name string, at string"
    df = spark.createDataFrame([(k, f"n{k}", "2024-01-01") for k in range(500)], kind).repartition(6)
    D.write(df, path, "t")
    D.write(df.where("id < 400"), path, "t")
    assert len(open_rows(path)) == 400 and left(path) == []
    D.write(df.where("id >= 490"), path, "t", mode="append")
    assert sorted(map(tuple, D.read(spark, path, "t", kind, "id", 7).collect())) == sorted(tuple(r) for r in df.where("id < 400 or id >= 490").collect())
    D.write(df.where("id < 3"), path, "u", "id", "at")
    news = spark.createDataFrame([(0, "older", "2023-01-01"), (1, "newer", "2025-01-01"), (1, "newest", "2026-01-01"), (2, "no time", None), (9, "first", None)], kind)
    D.write(news, path, "u", "id", "at")
    D.write(news, path, "u", "id", "at")
    assert open_rows(path, "u") == [(0, "n0", "2024-01-01"), (1, "newest", "2026-01-01"), (2, "n2", "2024-01-01"), (9, "first", None)]


def test_a_failed_task_leaves_nothing_and_a_retry_gives_each_row_once(spark, tmp_path):
    path = str(tmp_path / "x.db")
    good = spark.range(100).selectExpr("id", "'a' as name")
    D.write(good, path, "t")
    broken = spark.range(0, 50, 1, 5).selectExpr("id", "if(id = 49, raise_error('lost'), 'b') as name")
    with pytest.raises(Exception, match="lost"):
        D.write(broken, path, "t")
    assert open_rows(path) == [(k, "a") for k in sorted(range(100), key=lambda k: repr((k, "a")))] and left(path) == []
    D.write(spark.range(0, 50, 1, 5).selectExpr("id", "'b' as name"), path, "t")
    assert len(open_rows(path)) == 50
    # two attempts of one task: only the reported stage is moved
    w = D._Writer(D._Database({"dsn": path, "table": "t"}), good.schema, True)
    w.write(iter([(1, "lost attempt")]))
    w.commit([w.write(iter([(1, "kept")])), None])
    assert open_rows(path) == [(1, "kept")] and left(path) == []


def test_values_and_empty(spark, tmp_path):
    path = str(tmp_path / "x.db")
    df = spark.sql("select 1L as id, true as b, array(1, 2) as a, named_struct('x', 'é') as s, date'2024-02-03' as d, 1.50BD as m, cast(null as string) as n, 0.5D as f")
    D.write(df, path, "v")
    assert open_rows(path, "v") == [(1, 1, "[1, 2]", '{"x": "é"}', "2024-02-03", "1.50", None, 0.5)]
    assert D.read(spark, path, "v", "b boolean, f double").first() == (True, 0.5)
    D.write(df.where("false"), path, "v")
    assert open_rows(path, "v") == [] and D.read(spark, path, "v", "id long", "id").count() == 0

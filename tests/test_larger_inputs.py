"""Queries against their SQL on small tables that hold what larger ones do: later ids, odd white space, long texts."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from heddle.plans import registry
from heddle.streaming import updates as U
from tests.oracle import rows_of


def equals_sql(spark, at, name: str, **tables) -> list:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{at}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
    con.execute(registry.oracle_sql()[name])
    columns, expected = [c[0] for c in con.description], con.fetchall()
    df = registry.queries()[name](spark, str(at))
    found = rows_of(df.columns, df.collect())
    assert found == rows_of(columns, expected)
    return found


def documents(spark, texts: list):
    return spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_chunks_behind_blank_lines(spark, tmp_path):
    long = "word " * 70
    texts = [f"{long}\n\n{long}", f"a\n \t\n# {long}", f"\u00a0{long}\u2003", f"{long}\n\x0b\n{long}", f"{long}\x01{long}", f"{long}  \n", "x" * 60, "x" * 59, None, "", f"{long}. \n\n. {long}", "y" * 58 + "\n\n" + "z" * 59]
    assert len(equals_sql(spark, tmp_path, "heading_chunks", documents=documents(spark, texts))) == 9


@pytest.mark.parametrize("name", ["crawl_frontier", "saved_text_state"])
def test_a_first_run_that_goes_on_when_the_second_begins(spark, tmp_path, name):
    pages = [(1, "http://a/x", "one"), (3, "http://a/y", "two"), (17_000, "http://a/x", "three"), (40_000, "http://a/y", "one"), (90_000, "http://a/z", "four")]
    equals_sql(spark, tmp_path, name, pages=spark.createDataFrame(pages, "page_id long, url string, html string"))


def test_word_differences_of_long_texts(spark):
    def seconds(n: int) -> float:
        text = " ".join("".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(n))
        rows = spark.createDataFrame([(text, "gone gone " + text)], "new_text string, old_text string")
        t = time.monotonic()
        found = {(r.word, r.n, r.n_records) for r in U._word_differences(rows).where(F.col("word") == "gone").collect()}
        assert found == {("gone", -2, -1)}
        return time.monotonic() - t

    seconds(10)
    assert seconds(40_000) < 20  # by the square of a text's length it took minutes


def test_shingle_pairs_without_shuffled_shingles(spark, monkeypatch):
    """Equal to brute force over several blocks; of texts from one vocabulary only alike ones are compared, and no shingle is shuffled."""
    import random

    from heddle.operators import dedup

    monkeypatch.setattr(dedup, "BLOCK", 20, raising=False)
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(60)]
    texts = []
    for size in [3, 10, 40, 200] * 8:
        base = [r.choice(words) for _ in range(size)]
        for _ in range(4):
            t = list(base)
            for _ in range(r.randint(0, max(1, size // 15))):
                t[r.randrange(size)] = r.choice(words)
            texts.append(" ".join(t))
    texts += ["abcd", "abcde", "ABCDE", "", None]
    sets, heads, want = {}, {}, set()
    for k, t in enumerate(texts):
        if t and len(t) >= 5 and heads.setdefault(t.lower(), k) == k:
            sets[k] = {t.lower()[i : i + 5] for i in range(len(t) - 4)}
        elif t and len(t) >= 5:
            want.add((heads[t.lower()], k, 1.0))
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                want.add((a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 4)))
    found = dedup.shingle_pairs(documents(spark, texts), "doc_id", "text")
    assert {tuple(x) for x in found.collect()} == want and len(want) > 50
    # before, every shingle of every text was exploded, counted and joined
    assert "explode(s" not in found._jdf.queryExecution().toString() and "Window" not in found._jdf.queryExecution().toString()


def test_bounds_of_many_queries_and_parts():
    """Queries that must read every part give batches of bounded size (before, one batch with a row for each query and part)."""
    import numpy as np
    import pyarrow as pa

    from heddle.operators import vector_index as VI

    r = np.random.default_rng(1)
    centres = r.normal(size=(100, 8))
    centres /= np.sqrt((centres**2).sum(1, keepdims=True))
    parts = np.array([(c, ring, 5, 0.0, 180.0) for c in range(100) for ring in range(4)])
    v = pa.FixedSizeListArray.from_arrays(pa.array(r.normal(size=8 * 1000)), 8).cast(pa.list_(pa.float64()))
    b = pa.RecordBatch.from_arrays([pa.array(range(1000)), v, pa.nulls(1000, pa.float64())], names=["id", "v", "kth"])
    out = [list(VI._bounded(centres, parts, 10, -1.0, found)(iter([b]))) for found in (False, True)]
    assert max(x.num_rows for some in out for x in some) <= 50_000
    read = [(i, c, g) for some in out for x in some for i, c, g in zip(x.column(0).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]
    assert len(read) == len(set(read)) == 1000 * 400
    first = pa.Table.from_batches(out[1]).slice(0, 3).to_pylist()
    assert [x["v"] for x in first] == [v[x["id"]].as_py() for x in first]


def test_discovery_counts_are_added_up_in_tasks(spark, monkeypatch):
    """Equal to counts of single tokens, however early a task sends them; no row a token is made."""
    from collections import Counter

    import pyarrow as pa

    from heddle.operators import discovery_run as R
    from heddle.operators import word_tallies as W

    said = [[f"w{(d * k + j) % 5}" for j in range(k % 4)] + ["not"] * (d % 2) for d in range(6) for k in range(9)]
    want = Counter(("word", w, "") for t in said for w in t) + Counter(("pair", *p) for t in said for p in zip(t, t[1:], strict=False))
    want += Counter({("marker", "negation", "not"): sum("not" in t for t in said), ("pattern", "c", "p"): len(said)})

    def found() -> Counter:
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.string())), pa.array(["c"] * len(x)), pa.array(["p"] * len(x))], names=list("tcp")) for x in (said[:20], said[20:21], said[21:])]
        out = Counter()
        for b in R._tallied([("negation", "not"), ("negation", "never")])(iter(batches)):
            for r in b.to_pylist():
                out[r["kind"], r["a"], r["b"]] += r["n"]
        return out

    assert found() == want
    for name in ("RAW_PAIRS", "PAIRS", "WORDS"):
        monkeypatch.setattr(W, name, 1)
    assert found() == want
    plan = R.counts(documents(spark, ["A b. Not c"]), R.Rules({}, {}))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "transform" not in plan.split("MapInArrow")[0]

"""Held-out results on the fixture tables: toxic texts are found in every language, the byte model beats the words."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from heddle.llm import ctw, queries, suffixes
from tests.llm import reference as R
from tests.llm.test_operators import frame, words

SF = "/root/testdata/sf0.1"
there = pytest.mark.skipif(not Path(SF, "labels.parquet").exists(), reason="no fixture tables")


@there
def test_toxic_texts_are_found_in_every_language(spark):
    scored = queries.op9_toxicity(spark, SF).where("held_out")
    j = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    g = j.groupBy("lang").agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, 1 - F.col("predicted"))).alias("spared"), F.count_if(F.col("toxic") == 1).alias("n"))
    rows = g.collect()
    assert len(rows) == 4 and all(r.n > 5 and r.recall >= 0.9 and r.spared >= 0.95 for r in rows)


@there
def test_the_byte_model_beats_the_words(spark):
    r = ctw.scores(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert r.score > r.base


def test_long_and_hot_texts_lose_all_repeats(spark):
    import random

    rnd = random.Random(8)
    long = words(rnd, 9000)
    rows = [(k, long[:700]) for k in range(60)] + [(100, long), (101, long[5000:9000] + words(rnd, 60)), (102, words(rnd, 300)), (103, "ab" * 900)]
    want = dict(zip((i for i, _ in rows), R.repeats([t for _, t in rows], 400), strict=True))
    for crowd in (4000, 2):
        done = suffixes.without_repeats(frame(spark, rows), crowd=crowd).select("doc_id", F.length("__kept").alias("kept"), F.size("__spans").alias("spans"))
        got = {r.doc_id: (r.kept, r.spans) for r in done.collect()}
        assert got == {i: (n - removed, spans) for i, (n, removed, spans, _) in want.items()}

"""Models fitted by summed gradients: equal to one machine, to enumeration of all paths, and right on held-out rows."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.functions.linguistic import Syllables
from heddle.operators import crf, fitting, lid
from heddle.plans import registry
from tests import oracle


def test_sums_equal_one_machine(spark):
    rng = np.random.default_rng(1)
    rows = [(["the cat sat", "le chat dort", "", None][k % 4], "ab"[k % 2]) for k in range(60)]
    f = lid.featured(spark.createDataFrame(rows, "text string, lang string").repartition(7), 64)
    w = rng.normal(size=(64, 2))
    got = fitting.summed(f, lambda b: np.r_[b.num_rows, lid.log_loss(w, b.column(1), b.column(2), np.array(["ab".index(x) for x in b.column(0).to_pylist()]))[1].ravel()])
    found = [lid.cells(t or "", 64) for t, _ in rows]
    _, g = lid.log_loss(w, pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32())), np.array(["ab".index(x) for _, x in rows]))
    assert got[0] == 60 and np.allclose(got[1:], g.ravel())
    assert fitting.summed(f.where("false"), lambda b: np.zeros(3)) is None


def test_gradient_of_the_language_model_by_differences():
    rng = np.random.default_rng(2)
    found = [lid.cells(t, 32) for t in ("abc abd", "xyz", "ab xy")]
    cell, weight = pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32()))
    label, w = np.array([0, 1, 2]), rng.normal(size=(32, 3))
    _, g = lid.log_loss(w, cell, weight, label)
    for i, k in ((3, 0), (7, 2), (20, 1)):
        d = np.zeros_like(w)
        d[i, k] = 1e-5
        slope = (lid.log_loss(w + d, cell, weight, label)[0] - lid.log_loss(w - d, cell, weight, label)[0]) / 2e-5
        assert abs(slope - g[i, k]) < 1e-6


def test_quasi_newton_finds_the_minimum():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 12))
    h, b = a.T @ a + np.eye(12), rng.normal(size=12)
    x = fitting.minimised(lambda x: (float(x @ h @ x / 2 - b @ x), h @ x - b), np.zeros(12), 200, enough=1e-9)
    assert np.allclose(x, np.linalg.solve(h, b), atol=1e-6)


@pytest.mark.skipif(not oracle.there(), reason="no fixture tables")
def test_languages_of_held_out_documents(spark):
    said = registry.queries()["trained_language_id"](spark, "/root/testdata/sf0.01")
    held = said.where("held_out and lang is not null").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("lang") == F.col("predicted")).cast("double")).alias("right")).first()
    assert said.count() == 1000 and held.n > 100 and held.right >= 0.95


def test_language_edge_cases(spark):
    rows = [(1, "the cat", "a"), (2, "le chat", "b"), (3, None, None), (4, "", "a"), (5, "?!", "b"), (6, "the " * 300_000, None)]
    f = lid.featured(spark.createDataFrame(rows, "id long, text string, lang string"), 256)
    got = {r.id: r for r in lid.identified(f, lid.train(f, "lang", buckets=256)).collect()}
    assert (got[1].predicted, got[2].predicted, got[6].predicted) == ("a", "b", "a") and got[3].predicted is got[4].predicted is got[5].predicted is None
    with pytest.raises(ValueError):
        lid.train(f, "lang", labels_at_most=1)
    none = lid.train(f.where("false"), "lang", buckets=256)
    assert none.labels == [] and lid.identified(f, none).where("predicted is not null").count() == 0


def score(x, word, tags):
    s, pair = crf._potentials(x, crf.cells(crf._codes([word])))
    return s[0][np.arange(len(word)), tags].sum() + sum(pair[a, b] for a, b in zip(tags, tags[1:], strict=False))


def test_crf_equals_all_paths():
    x = np.random.default_rng(5).normal(size=crf.SIZE)
    for word in ("a", "ab", "banana", "piangsak"):
        paths = [(1, *p) for p in itertools.product((0, 1), repeat=len(word) - 1)]
        s = np.array([score(x, word, p) for p in paths])
        assert tuple(crf.best_tags(x, [word])[0]) == paths[s.argmax()]
        gold = np.array([paths[len(paths) // 2]])
        loss = crf.expectations(x, [word], gold)[1]
        assert abs(loss - (np.log(np.exp(s).sum()) - score(x, word, gold[0]))) < 1e-9


def test_crf_gradient_by_differences():
    x = np.random.default_rng(6).normal(size=crf.SIZE) * 0.3
    words, tags = ["banana", "abacus"], np.array([[1, 0, 1, 0, 1, 0], [1, 1, 0, 1, 0, 0]])
    g = crf.expectations(x, words, tags)[2:]
    for i in [*np.argsort(-np.abs(g))[:6], crf.SIZE - 1, crf.SIZE - 3]:
        d = np.zeros_like(x)
        d[i] = 1e-5
        assert abs((crf.expectations(x + d, words, tags)[1] - crf.expectations(x - d, words, tags)[1]) / 2e-5 - g[i]) < 1e-6


def test_crf_learns_syllables_of_unseen_words(spark):
    rule = Syllables(frozenset(["", "k", "p", "t", "kh", "th", "l", "m", "n", "s", "z", "ts"]), frozenset(["a", "e", "i", "o", "u", "ua", "ia", "ai"]), frozenset(["", "n", "ng", "k", "m"]))
    rnd = random.Random(7)
    part = lambda: rnd.choice(["k", "p", "t", "kh", "th", "l", "m", "s", "z", "ts"]) + rnd.choice(["a", "e", "i", "o", "u", "ua", "ia", "ai"]) + rnd.choice(["", "", "n", "ng", "k", "m"])
    words = sorted({"".join(part() for _ in range(rnd.randrange(1, 5))) for _ in range(1500)})
    gold = spark.createDataFrame([(w, rule.split(w)) for w in words], "word string, gold array<string>")
    taught = gold.where("crc32(cast(word as binary)) % 5 <> 0").select("word", F.col("gold").alias("syllables"))
    model = crf.train(taught)
    found = crf.segmented(gold.where("crc32(cast(word as binary)) % 5 = 0"), model)
    s = crf.boundary_scores(found).first()
    assert s.f1 >= 0.97 and s.whole >= 0.9
    edge = crf.segmented(spark.createDataFrame([(None,), ("",), ("K",), ("日本",)], "word string"), model)
    assert [r.syllables is None or "".join(r.syllables) for r in edge.collect()] == [True, "", "k", "日本"]

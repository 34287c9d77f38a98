"""Tables with versions, and the observation build: hand-computed counts, atomic commits, runs that change nothing."""

import pytest
from pyspark.sql import functions as F

from heddle.operators import observation as O
from heddle.sources.versions import Conflict, Versions

ROWS = [
    ("verse:a", "GEN", 0, "pasian in vantung leh leitung a piangsak hi"),
    ("verse:a", "TEST", 0, "gam hi gam"),
    ("verse:b", "EXO", 0, "pathian in om hi"),
    ("phrase", "P1", 0, "a hi hi"),
    ("phrase", "P1", 1, "..."),
]


def rows(spark, data=ROWS):
    df = spark.createDataFrame(data, "source_id string, document_id string, sentence_id int, text string")
    return df.withColumn("source_ref", F.concat_ws(":", "source_id", "document_id", F.col("sentence_id").cast("string")))


SETTINGS = O.Settings(variants=(("pathian", "pasian"),), least=1)


def test_hand_computed_statistics(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    said = O.build(store, rows(spark), SETTINGS, "r1", spark.createDataFrame([("hi", "seen")], "word string, attestation string"))
    # pairs at most two apart, of different words: 13 + 2 + 5 + 2
    assert said == {"sentences": 4, "inserted": 4, "words": 10, "changed_words": 10, "tokens": 18, "pair_occurrences": 22, "version": 1}
    w = {r.word: r for r in store.read("word_stats").collect()}
    assert [(w[x].frequency, w[x].doc_freq, w[x].sent_freq, w[x].source_count, w[x].diversity) for x in ("pasian", "hi", "gam")] == [(2, 2, 2, 2, 0.5), (5, 4, 4, 3, 1.0), (2, 1, 1, 1, 0.25)]
    assert [tuple(x) for x in w["pasian"].surface_forms] == [("pasian", 1), ("pathian", 1)]
    assert [tuple(x) for x in w["gam"].left] == [("gam", 1), ("hi", 1)] and [tuple(x) for x in w["gam"].neighbours] == [("hi", 2)]
    assert w["hi"].snippet == "a hi hi" and w["hi"].attestation == "seen" and w["gam"].attestation is None
    pmi = {x.key: (x.pmi, x.n) for x in w["gam"].collocations}
    assert pmi == {"hi": (round(__import__("math").log2(2 * 18 / (2 * 5)), 4), 2)}
    o = {r.document_id: r for r in store.read("observations").collect()}
    assert o["EXO"].corrected and o["EXO"].tokens == ["pasian", "in", "om", "hi"] and not o["GEN"].corrected


def test_a_second_run_changes_nothing_and_a_third_adds(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    O.build(store, rows(spark), SETTINGS, "r1")
    again = O.build(store, rows(spark), SETTINGS, "r2")
    assert (again["inserted"], again["changed_words"], again["version"]) == (0, 0, 1)
    more = O.build(store, rows(spark, [*ROWS, ("phrase", "P2", 0, "new hi")]), SETTINGS, "r3")
    assert (more["inserted"], more["version"]) == (1, 2)
    runs = {r.word: (r.first_run, r.last_run) for r in store.read("word_stats").collect()}
    assert runs["hi"] == ("r1", "r3") and runs["new"] == ("r3", "r3")
    assert store.read("observations").count() == 5 and store.read("observations", 1).count() == 4
    assert store.read("word_stats", 1).where("word = 'new'").count() == 0


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    store.commit({"a": spark.range(3), "b": spark.range(4)})

    broken = spark.range(5).select(F.expr("if(id = 4, raise_error('lost'), id)").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": spark.range(9), "b": broken})
    assert store.numbers() == [1] and store.read("a").count() == 3 and store.read("b").count() == 4
    assert store.vacuum() >= 1  # the data that no manifest names
    assert store.read("a").count() == 3
    (tmp_path / "s" / "drafts" / "half.json").write_text('{"version": 2, "tab')
    assert store.manifest().version == 1


def test_of_two_writers_one_wins(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    first = store.commit({"a": spark.range(3)})
    store.commit({"a": spark.range(4)}, base=first.version)
    with pytest.raises(Conflict):
        store.commit({"a": spark.range(5)}, base=first.version)
    assert store.read("a").count() == 4 and store.read("a", 1).count() == 3 and store.read("x") is None


def test_appends_keep_old_rows_where_they_are(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    store.commit({"a": spark.range(3)}, {"n": "ä"})
    m = store.commit({}, append={"a": spark.range(10, 12), "b": spark.range(1)})
    assert len(m.tables["a"]["paths"]) == 2 and sorted(r.id for r in store.read("a").collect()) == [0, 1, 2, 10, 11]
    assert store.manifest(1).notes == {"n": "ä"} and store.vacuum(keep=1) == 0 and store.numbers() == [2]


def test_empty_and_null(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([(1, None, None), (None, "x", "A b. a")], "doc_id long, source string, text string")
    assert O.build(store, O.sentences(docs.where("false")), SETTINGS)["words"] == 0
    said = O.build(store, O.sentences(docs), SETTINGS)
    assert (said["sentences"], said["words"], said["version"]) == (2, 2, 2)


def test_counts_do_not_depend_on_how_rows_are_held(spark, tmp_path, monkeypatch):
    """Tallies that are sent early, words whose rows are added up as they come, documents that lie apart, rows that come twice."""
    from collections import Counter

    import pyarrow as pa

    from heddle.operators import word_tallies as W

    said = [("s", str(d), k, [f"w{(d * k + j) % 7}" for j in range(5)] + ["the"]) for d in range(9) for k in range(4)]
    said = said[::2] + said[1::2]

    def batches():
        for s in range(0, len(said), 5):
            rows = said[s : s + 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int64()), pa.array([" ".join(r[3]) for r in rows]), pa.nulls(len(rows), pa.list_(pa.string())), pa.array([r[3] for r in rows]), pa.array([4] * len(rows), pa.int64())], names=list("abcdefg"))

    def found():
        t = pa.Table.from_batches(list(W.tallies(2)(batches())))
        words = sorted(set(t["word"].to_pylist()))
        t = t.append_column("h", pa.array([words.index(w) // 2 for w in t["word"].to_pylist()], pa.int64())).sort_by("h")
        return sorted((r for b in W.sums(3, 2)(iter(t.to_batches(max_chunksize=3))) for r in b.to_pylist()), key=lambda r: (r["word"], r["partner"] or ""))

    want = found()
    the = next(r for r in want if r["word"] == "the" and r["partner"] is None)
    assert (the["frequency"], the["sent_freq"], the["doc_freq"], the["source_count"]) == (36, 36, 9, 1)
    left = Counter(t[i] for *_, t in said for i in (3, 4))
    assert [(x["key"], x["n"]) for x in the["left"]] == sorted(left.items(), key=lambda x: (-x[1], x[0]))[:3] and the["right"] is None
    for name in ("RAW_PAIRS", "PAIRS", "WORDS", "CHUNK"):
        monkeypatch.setattr(W, name, 1)
    assert found() == want
    store = Versions(spark, str(tmp_path / "s"))
    assert O.build(store, rows(spark, [*ROWS, ROWS[0], ("verse:a", "TEST", 0, "a earlier")]), SETTINGS)["sentences"] == 4
    assert store.read("observations").where("document_id = 'TEST'").first().text == "a earlier"

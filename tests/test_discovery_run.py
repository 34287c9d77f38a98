"""Discovery as one run: what it stores, what a second run changes, what a failing capability does; claims."""

import pytest
from pyspark.sql import functions as F

from heddle.operators import discovery_run as R
from heddle.sources.versions import Versions

RULES = R.Rules({"the": "DET"}, {"ing": "VERB"}, (("king", "NOUN"),), (("re",), ("s",)), {"negation": ["not"]}, least_pair=2, least_pmi=0.5, least_marker=1)
TEXTS = [(1, "the king sings. the king does not sing."), (2, "a redo of the song. songs do not last?"), (3, None), (4, ""), (5, "the king sings. the king does not sing.")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("n", F.lit(0))


def stored(store):
    return {(r["kind"], r["subject"], r["predicate"], r["object"]): (r["n"], r["confidence"]) for r in store.read("hypotheses").collect()}


def test_hand_computed_hypotheses(spark, docs, tmp_path):
    store = Versions(spark, str(tmp_path))
    said = R.run(store, docs, RULES)
    h = stored(store)
    assert said["version"] == 1 and not said["failed"] and set(said["status"]) == {"pos", "morph_relation", "collocation", "sentence_pattern", "grammar"}
    assert h["pos", "word:the", "pos:DET", None] == (5, 1.0)
    # the tagger says VERB four times, the dictionary counts ten
    assert h["pos", "word:king", "pos:NOUN", None] == (10, round(10 / 14, 4))
    assert ("morph_relation", "word:songs", "morph:suffix:s", "root:song") in h and ("morph_relation", "word:sings", "morph:suffix:s", "root:sing") in h
    assert ("morph_relation", "word:redo", "morph:prefix:re", "root:do") not in h
    assert h["grammar", "negation", "marker", "not"] == (3, 0.3)
    assert h["collocation", "word:king", "collocates", "word:the"][0] == 4


def test_a_second_run_changes_nothing_and_a_grown_corpus_updates(spark, docs, tmp_path):
    store = Versions(spark, str(tmp_path))
    R.run(store, docs, RULES)
    before = stored(store)
    again = R.run(store, docs, RULES)
    assert again["version"] == 1 and all(set(of) == {"unchanged"} for of in again["status"].values()) and stored(store) == before
    dry = R.run(store, docs.where("doc_id = 2"), RULES, dry_run=True)
    assert dry["version"] == 1 and stored(store) == before and "updated" in dry["status"]["pos"]
    R.run(store, docs.where("doc_id = 2"), RULES)
    now = stored(store)
    assert set(now) >= set(before) and now["pos", "word:the", "pos:DET", None][0] == 1 and now["pos", "word:king", "pos:NOUN", None] == before["pos", "word:king", "pos:NOUN", None]


def test_one_failing_capability_is_named_and_the_others_go_on(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setitem(R.MAKERS, "morphology", lambda c, rules: c.select(F.raise_error(F.lit("no")).alias("id")))
    store = Versions(spark, str(tmp_path))
    said = R.run(store, docs, RULES)
    assert list(said["failed"]) == ["morphology"] and {k for k, *_ in stored(store)} == {"pos", "collocation", "sentence_pattern", "grammar"}


def test_choices_caps_and_empty_tables(spark, docs, tmp_path):
    store = Versions(spark, str(tmp_path))
    with pytest.raises(ValueError, match="songs"):
        R.run(store, docs, RULES, ["pos", "songs"])
    assert R.run(store, docs.where("false"), RULES)["version"] == 0 and store.read("hypotheses") is None
    R.run(store, docs, RULES, ["pos"], {"pos": 2})
    assert {s for _, s, *_ in stored(store)} == {"word:king", "word:the"}
    assert R.run(store, docs, R.Rules({}, {}), ["pos", "grammar"])["failed"] == {}


def test_claims(spark):
    rows = [("pos", "word:word:a", None, None, {"upos": "NOUN"}), ("pos", " b ", "pos:VERB", "x", None), ("pos", "c", " ", None, {}), ("morph_relation", "d", None, None, {"type": "suffix", "root": "r"}),
            ("morph_relation", "e", "morph:x", "root:q", None), ("morph_relation", "f", "morph:x", None, None), ("collocation", "g", "with", "h", None), ("collocation", "g", "with", "", None), ("other", "a", "b", "c", None), (None, "a", "b", "c", None), ("pos", None, "p", None, None)]
    df = spark.createDataFrame(rows, "kind string, subject string, predicate string, object string, extras map<string,string>").withColumn("type_of", F.lit(1))
    want = {("lexicon", "word:a", "pos:NOUN", None), ("lexicon", "b", "pos:VERB", None), ("morphology", "d", "morph:suffix", "root:r"), ("morphology", "e", "morph:x", "root:q"), ("lexicon", "g", "with", "h")}
    assert {tuple(r)[1:] for r in R.claims(df).collect()} == want

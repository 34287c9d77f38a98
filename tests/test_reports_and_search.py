"""Hand-computed cases of reconciliation, bands, contexts, bilingual cleaning, discussions and dictionary and topic search."""

import pytest
from pyspark.sql import functions as F

from heddle.functions import cleaning as K
from heddle.operators import ledger as L
from heddle.operators import routine as O
from heddle.operators import search as S
from heddle.sources import readers as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_reconciliation(spark):
    log = spark.createDataFrame([("a", 2, "completed"), ("a", 3, "completed"), ("a", 9, "failed"), ("b", 1, "completed"), ("c", 4, "completed"), (None, 4, "completed"), ("d", 1, None), ("e", None, "completed")], "table_name string, rows_imported long, status string")
    live = spark.createDataFrame([("a", 5), ("b", 0), ("d", 1), ("e", 7)], "table_name string, rows long")
    assert rows(L.reconciled(log, live)) == [("a", 5, 5, 0, "ok"), ("b", 1, 0, -1, "mismatch"), ("c", 4, None, None, "no table"), ("e", None, 7, 7, "mismatch")]
    assert rows(L.reconciled(log.where("false"), live)) == []


@pytest.mark.parametrize(
    ("value", "direction", "green", "amber", "said"),
    [(1.0, "lower", 1.0, 2.0, "green"), (1.5, "lower", 1.0, 2.0, "amber"), (3.0, "lower", 1.0, 2.0, "red"), (3.0, "lower", 1.0, None, "amber"), (2.0, "higher", 2.0, 1.0, "green"), (1.0, "higher", 2.0, 1.0, "amber"), (0.5, "higher", 2.0, 1.0, "red"), (0.5, "higher", 2.0, None, "amber"),
     (9.0, "info", 1.0, 2.0, "info"), (None, "info", 1.0, 2.0, "info"), (None, "lower", 1.0, 2.0, "absent"), (1.0, None, 1.0, 2.0, "green"), (1.0, "", None, 2.0, "amber"), (1.0, "lower", None, None, "amber")],
)
def test_threshold_status(spark, value, direction, green, amber, said):
    df = spark.createDataFrame([(value, direction, green, amber)], "v double, d string, g double, a double")
    assert df.select(O.threshold_status(F.col("v"), F.col("d"), F.col("g"), F.col("a"))).first()[0] == said


def test_contexts(spark):
    df = spark.createDataFrame([("As John 3:16 of old Ur says",), ("of old UR they sang",), ("now",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(K.context(F.col("text"), [r"\bjohn [0-9]+:[0-9]+"], [r"\bold ur\b"])).collect()] == ["scripture", "historical", "modern", "modern", "modern"]
    assert {r[0] for r in df.select(K.context(F.col("text"), [], [])).collect()} == {"modern"}


def test_bilingual_cleaning(spark):
    pairs = [(1, "# Head\n- one   café â€™x", "* see http://a.b or me@x.org, Anna"), (2, "ram here", "fine"), (3, " \n ", "fine"), (4, "fine", "http://only.link"), (5, None, "x"), (6, "x", None), (7, "program", "kept")]
    got = rows(K.bilingual(spark.createDataFrame(pairs, "id long, own string, other string"), "own", "other", r"\bram\b", {"PERSON": ["Anna"]}))
    assert got == [(1, "Head one café x", "see or , [PERSON]"), (7, "program", "kept")]


def test_discussions(spark):
    talk = [(1, "a", "Words words trees ab é-word 1234"), (1, "b", "trees with words"), (2, "a", "TREES birds"), (3, "c", None), (4, "a", ""), (5, None, "words trees words")]
    df = spark.createDataFrame(talk, "conv_id long, role string, text string").withColumn("term", F.lit(1))
    assert rows(S.key_terms(df, ["with"], 2).where("id = 1")) == [(1, "trees", 2), (1, "words", 3)]
    got = {r[0]: tuple(r)[1:] for r in S.like_discussion(df, 1, ["with"]).collect()}
    # "é-word" is two words, é and word
    assert got == {2: (0.25, 0.5, "trees"), 3: (0.0, 0.0, ""), 4: (0.0, 0.5, ""), 5: (0.6667, 0.0, "trees words")}


def test_dictionary_and_topic_search(spark):
    book = spark.createDataFrame([(1, "water", "aqua"), (2, "water lily", "flos"), (3, "underwater", "sub"), (4, None, "x"), (5, "fire", "ignis"), (6, "Water", "aqua")], "id long, headword string, meaning string")
    assert [r[0] for r in S.cross_lingual({"en": book}, "water", "en").collect()] == [1, 6, 2, 3]
    with pytest.raises(ValueError, match="zz"):
        S.cross_lingual({"en": book}, "water", "zz")
    assert [r[0] for r in S.topical(book, "Water flos", "id", ["headword", "meaning"]).collect()][0] == 2
    assert [r[0] for r in S.topical(book, "ignis", "id", ["headword", "meaning"]).collect()] == [5]
    assert S.topical(book, "", "id", ["headword"]).count() == 6 and S.topical(book.where("false"), "x", "id", ["headword"]).count() == 0


def test_availability(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    assert rows(R.availability(spark, str(tmp_path), ["a", "b"])) == [("a", True, 3), ("b", False, 0)]
    assert rows(R.availability(spark, str(tmp_path), [])) == []

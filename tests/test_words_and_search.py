"""Phonology by hand-computed cases, hybrid ranking over small tables, evidence by tiers."""

import pytest
from pyspark.sql import functions as F

from heddle.operators import phonology as P
from heddle.operators import search as S
from heddle.plans.words import AFFIXES, RULES

T1, T2, T3, T4 = "T1", "T2", "T3", "T4"
PLAIN = P.Sounds("aeiou", ("", "p", "t", "k", "m", "n", "s", "l", "v", "th"), ("a", "e", "i", "o", "u", "ia", "ai"), ("", "m", "n", "ng", "k"), (("x", T3),))


@pytest.mark.parametrize(("tones", "want"), [([T1, T3], [T2, T3]), ([T3, T1], [T2, T1]), ([T3, T3], [T2, T3]), ([T3, T4], [T3, T2]), ([T1, T1], [T1, T1]), ([], []), ([T1], [T1]), ([T1, T3, T3], [T2, T2, T3]), ([T3, T4, T1, T3], [T3, T2, T2, T3])])
def test_tones_are_rewritten_in_order(spark, tones, want):
    df = spark.createDataFrame([(tones,)], "t array<string>")
    assert df.select(P.sandhi(F.col("t"), RULES).alias("t")).first().t == want
    assert df.select(P.sandhi(F.col("t"), {}).alias("t")).first().t == tones


def test_structure_stress_and_violations(spark):
    words = [("pan",), ("om",), ("pa",), ("Pasian",), ("",), (None,), ("strank",), ("zzz",), ("tapasi",)]
    got = {r.word: r for r in P.phonology(spark.createDataFrame(words, "word string"), PLAIN, RULES).collect()}
    assert [tuple(got[w].structures[0])[1:] for w in ("pan", "om", "pa")] == [("p", "a", "n", True), ("", "o", "m", True), ("p", "a", "", True)]
    assert got["Pasian"].syllables == ["pa", "sian"] and got["Pasian"].valid and got["Pasian"].stress == ["primary", "unstressed"]
    assert got["tapasi"].stress == ["primary", "unstressed", "secondary"] and got["pa"].stress == ["primary"]
    assert not got[""].valid and got[""].violations == ["empty"] and got[""].stress == []
    assert got["strank"].violations == ["structure str|a|nk", "onset str"] and got["zzz"].syllables == ["zzz"] and not got["zzz"].valid
    assert got[None].syllables is None


def test_roots_and_analysis(spark):
    w = spark.createDataFrame([("sing", 2), ("singing", 1), ("ing", 1), ("resing", 4), ("xing", 1), ("abcs", 1)], "word string, n long")
    assert {(r.word, r.root, r.affix) for r in P.roots(w, AFFIXES).collect()} == {("sing", "sing", None), ("singing", "sing", "ing"), ("ing", "ing", None), ("resing", "sing", "re"), ("xing", "xing", None), ("abcs", "abcs", None)}
    lex = spark.createDataFrame([("sing", "V"), ("ing", "Q")], "word string, tag string")
    senses = spark.createDataFrame([("sing", x) for x in "dbcab"], "word string, sense string")
    got = {r.word: (r.pos, r.senses) for r in P.analysed(w, PLAIN, AFFIXES, lex, senses).collect()}
    assert got["sing"] == ("V", ["a", "b", "c"]) and got["singing"] == ("V", []) and got["ing"][0] == "Q" and got["xing"][0] == "X"


@pytest.fixture(scope="module")
def books(spark):
    d = spark.createDataFrame([(1, "zomi", "a people"), (2, "bang", "the zomi community gathers"), (3, "sawhding", "hello"), (4, "zomite", "x"), (5, "azomi", "y")], "id long, word string, english string")
    e = spark.createDataFrame([(1, "love", "a great affection")], "id long, head string, said string")
    return {"dictionary": (d, "id", "word", "english"), "en": (e, "id", "head", "said")}


def ranked(df):
    return [(r.table_name, r.id, r.score, r.way) for r in df.collect()]


def test_first_way_to_a_row_counts(books):
    assert ranked(S.hybrid(books, "Zomi")) == [("dictionary", 1, 1.0, "exact"), ("dictionary", 4, 0.9, "prefix"), ("dictionary", 5, 0.7, "contains"), ("dictionary", 2, 0.6, "any")]
    assert ranked(S.hybrid(books, "hello")) == [("dictionary", 3, 1.0, "second")]
    assert ranked(S.hybrid(books, "what is zomi", stop=["what", "is"]))[0] == ("dictionary", 1, 0.95, "exact")
    assert ranked(S.hybrid(books, "?!...")) == []


def test_text_and_vectors_join_in(spark, books):
    text = spark.createDataFrame([("wiki", 1, 8.0), ("wiki", 2, 2.0)], "table_name string, id long, score double")
    dense = spark.createDataFrame([("vec", 7, 0.8123), ("dictionary", 1, 0.99)], "table_name string, id long, score double")
    both = ranked(S.hybrid(books, "zomi love", text=text, dense=dense))
    assert both[:4] == [("dictionary", 1, 0.95, "exact"), ("en", 1, 0.95, "exact"), ("wiki", 1, 0.95, "text"), ("dictionary", 4, 0.855, "prefix")]
    assert ("vec", 7, 0.8123, "vector") in both and ("wiki", 2, 0.8, "text") in both
    assert all(w != "vector" for *_, w in ranked(S.hybrid(books, "zomi", dense=dense)))  # one word, and found
    assert ("vec", 7, 0.8123, "vector") in ranked(S.hybrid(books, "nowhere", dense=dense))


def test_lower_tiers_are_asked_for_open_queries_only(spark):
    q = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, []), (4, ["zz"])], "query_id int, words array<string>")
    t1 = spark.createDataFrame([("a", 1, "x")], "word string, item int, evidence string")
    t2 = spark.createDataFrame([("a", 9, "no"), ("c", 5, "y"), ("c", 4, "y"), ("c", 6, "y")], "word string, item int, evidence string")
    got = {(r.query_id, r.tier, r.word, r.item) for r in S.tiered(q, [("one", t1, 0.9), ("two", t2, 0.5)], 1, 2).collect()}
    assert got == {(1, "one", "a", 1), (2, "two", "c", 4), (2, "two", "c", 5)}
    more = {(r.query_id, r.item) for r in S.tiered(q, [("one", t1, 0.9), ("two", t2, 0.5)], 2, 2).collect()}
    assert more == {(1, 1), (1, 9), (2, 4), (2, 5)}

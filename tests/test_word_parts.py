"""Longest match, compounds, tags and pieces against plain versions; recall of the MinHash bands against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from heddle.functions.linguistic import Syllables, tagged
from heddle.operators import dedup
from heddle.operators import tagging as G


def test_longest_match_and_known_compounds(spark):
    rule = Syllables(frozenset(["", "v", "t", "p"]), frozenset(["a", "u", "ia"]), frozenset(["", "n", "ng"]), {"vatu": ("v", "atu")})
    got = {r.word: r.syllables for r in G.max_munch(spark.createDataFrame([("vantung",), ("piang",), ("vatu",), ("xyz",), ("",), (None,)], "word string"), rule).collect()}
    assert got == {"vantung": ["van", "tung"], "piang": ["piang"], "vatu": ["v", "atu"], "xyz": ["x", "y", "z"], "": [], None: None}


def test_compounds_take_the_longest_root_first(spark):
    w = spark.createDataFrame([(x,) for x in ("sun", "sunday", "day", "sundayschool", "school", "dayday", "daysu", "sundayschoolday", "sunsunsunsunsunsunsun")], "word string")
    got = {r.word: r.parts for r in G.compounds(w, w).collect()}
    assert got == {"sunday": ["sun", "day"], "sundayschool": ["sunday", "school"], "dayday": ["day", "day"], "sundayschoolday": ["sundayschool", "day"]}


def test_tags_equal_the_plain_function(spark):
    closed, lexicon, tails = {"the": "DET"}, {"dog": "NOUN", "ran": "VERB"}, {"ing": "VERB", "ling": "ADJ"}
    tokens = ["The", "Dog", "darling", "Élan", "singing", "blah", "Tom"]
    df = spark.createDataFrame([(tokens,), ([],), (None,)], "t array<string>")
    got = [r.t for r in df.select(G.tags(F.col("t"), closed, lexicon, tails).alias("t")).collect()]
    assert [tuple(x) for x in got[0]] == tagged(tokens, closed, lexicon, tails) and got[1:] == [[], None]


def test_pieces_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ["Hello world", "", None, "日本語 \U0001f600", "a" * 5000, "  two  blanks\n"]
    got = {r.id: r for r in G.subwords(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("piece_bpe_32k.model")).collect()}
    for k, t in enumerate(texts):
        assert got[k].ids == sp.encode(t or "") and got[k].coverage == (1.0 if t else 0.0)  # bytes stand in for unknown letters
        assert sp.decode(got[k].ids) == sp.decode(sp.encode(t or ""))


def test_recall_of_the_bands(spark):
    """Pairs of texts by their true similarity: the share that meets in a band is at least near what the bands promise."""
    rnd = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows, pairs = [], []
    for k in range(400):
        a = "".join(rnd.choice(letters) for _ in range(600))
        b = list(a)
        for at in rnd.sample(range(600), 14):
            b[at] = rnd.choice("0123456789")
        b = "".join(b)
        grams = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
        j = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        rows += [(2 * k, a), (2 * k + 1, b)]
        pairs.append((2 * k, j))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bands, size in ((dedup.BANDS, dedup.BAND_ROWS), (dedup.WIDE_BANDS, dedup.WIDE_ROWS)):
        keys = {}
        for r in dedup.minhash_bands(df, "doc_id", "text", bands=bands, rows=size).collect():
            keys.setdefault(r.id, set()).add((r.band, r.key))
        some = [(i, j) for i, j in pairs if 0.78 <= j <= 0.84]
        met = sum(bool(keys[i] & keys[i + 1]) for i, _ in some) / len(some)
        promised = sum(1 - (1 - j**size) ** bands for _, j in some) / len(some)
        assert len(some) > 100 and abs(met - promised) < 0.1
    assert met >= 0.9
    kept = dedup.minhash_keep_first(df, "doc_id", "text", dedup.WIDE_BANDS, dedup.WIDE_ROWS).count()
    assert kept <= 400 + 0.12 * 400

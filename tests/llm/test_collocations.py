"""Phrase mining against counts of all phrases, and its edge cases."""

import random
import re
from collections import Counter

import pytest

from heddle.llm import collocations as C
from tests.llm.test_operators import frame


def brute(rows, min_count=10, most=3, inside=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, most + 1):
                for i in range(len(w) - d + 1):
                    f[lang, tuple(w[i : i + d])] += 1
    cand = {k: a for k, a in f.items() if a >= min_count and len(k[1]) > 1}
    gone = set()
    for (lang, w), a in cand.items():
        for d in range(2, len(w)):
            for i in range(len(w) - d + 1):
                if 100 * a >= inside * f[lang, w[i : i + d]]:
                    gone.add((lang, w[i : i + d]))
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            s, _, left, right = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for k, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def corpus(seed, n=120):
    rnd = random.Random(seed)
    some = ["the", "of", "Été", "a\x01b", "a", "zz\x00", "Über", "x", "in", "on", "日本", "y'z"]
    return [(rnd.choice(["en", "en", "de", None, ""]), "".join(rnd.choice(some) + rnd.choice([" ", " ", "\t", "  ", ". ", "\n", ", "]) for _ in range(rnd.randrange(1, 90)))) for _ in range(n)]


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("most", "shard", "min_count", "top"), [(3, 1 << 23, 10, 2000), (3, 60, 4, 2000), (4, 500, 3, 25), (2, 200, 5, 2000)])
def test_equals_brute_force(spark, most, shard, min_count, top):
    rows = corpus(most * 7 + min_count)
    df = frame(spark, rows, "lang string, text string").repartition(5)
    assert got(C.collocations(df, min_count=min_count, most_words=most, top=top, shard=shard)) == brute(rows, min_count, most, 50, top)


def test_ancestors_in_other_ranges(spark):
    """One word starts nearly all phrases, over more ranges than it has neighbours."""
    rows = [("en", " ".join(f"hot w{k % 40} w{(k * 7) % 11}." for k in range(j, j + 60))) for j in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(C.collocations(frame(spark, rows, "lang string, text string"))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edge_cases(spark):
    kind = "lang string, text string, phrase string, n long"
    assert got(C.collocations(frame(spark, [], kind))) == []
    rows = [(None, None), ("en", ""), ("en", None), ("de", " \t "), ("en", "...!?")]
    assert got(C.collocations(frame(spark, [(*r, "x", 1) for r in rows], kind))) == []
    long = "word " * 30_000 + "x" * 200_000 + " end " + "pair of. " * 50
    rows = [("en", long), ("en", long), (None, "new york " * 12)]
    assert got(C.collocations(frame(spark, [(*r, "x", 1) for r in rows], kind), shard=4096)) == brute(rows)


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_019
    cut = spark.sql(f"select cast((cast(1000000 as decimal(7, 0)) * cast({big} as decimal(15, 0)) * cast({big} as decimal(15, 0))) div (cast({big + 2} as decimal(15, 0)) * cast({big + 1} as decimal(15, 0))) as long) as s").first().s
    assert cut == 1000000 * big * big // ((big + 2) * (big + 1))

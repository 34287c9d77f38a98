"""Queries over whole texts and all rows, against brute force on small tables."""

import hashlib
import re
from collections import Counter

import pytest

from heddle.plans import registry
from heddle.plans.fragments import EN

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    head = " ".join(f"word{k}" for k in range(60))
    rows = [(1, head + " ".join(f"left{k}" for k in range(200))), (2, head + " ".join(f"right{k}" for k in range(200))), (4, "the cat the cat sees a dog, one bird here, two fish there, three mice away, four owls"), (5, ""), (6, "a  blue e  c the  end")]
    rows.append((3, rows[0][1] + " end"))
    at = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at, dict(rows)


def found(spark, name, at):
    return [tuple(r) for r in QUERIES[name](spark, at).collect()]


def test_shingles_of_whole_texts(spark, texts):
    at, rows = texts
    s = {i: {t.lower()[k : k + 5] for k in range(len(t) - 4)} for i, t in rows.items()}
    want = [(a, b, round(len(s[a] & s[b]) / len(s[a] | s[b]), 4)) for a in s for b in s if a < b and s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    assert sorted(found(spark, "shingle_pairs_whole", at)) == sorted(want) and [w[:2] for w in want] == [(1, 3)]
    assert sorted(found(spark, "shingle_pairs", at)) == sorted(want)


def test_ids_terms_and_slugs_of_whole_texts(spark, texts):
    at, rows = texts
    assert dict(found(spark, "vector_ids_whole", at)) == {i: hashlib.sha256(f"m:documents:{i}:{t}".encode()).hexdigest()[:32] for i, t in rows.items()}
    terms = lambda t: list(dict.fromkeys(x for x in re.findall("[a-z0-9]+", t.lower()) if x not in EN))[:6]
    assert dict(found(spark, "query_terms_whole", at)) == {i: " ".join(terms(t)) for i, t in rows.items()}
    assert {i: s for i, _, s in found(spark, "accent_filter_and_slug_whole", at)} == {i: re.sub("[^a-z0-9]+", "_", t.lower()).strip("_") for i, t in rows.items()}


def test_boundaries_of_whole_texts(spark, texts):
    at, rows = texts

    def ends(parts):
        out, n = set(), 0
        for x in parts:
            n += len(x)
            out.add(n)
        return out

    for i, precision, recall, exact in found(spark, "boundary_scores_whole", at):
        g, p = ends(rows[i].split(" ")), ends(rows[i].split("e "))
        assert (precision, recall, exact) == (round(len(g & p) / len(p), 4), round(len(g & p) / len(g), 4), rows[i].split(" ") == rows[i].split("e "))


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("orders"))
    o = [(k, k % 300) for k in range(1500, 2600, 100)]
    li = [(k, n, (k * 7 + n * 3) % 40, (k + n) % 20, "ANR"[n % 3]) for k, _ in o for n in range(1, 6)]
    spark.createDataFrame(o, "o_orderkey long, o_custkey long").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(li, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{at}/lineitem.parquet")
    return at, dict(o), li


def test_all_orders_are_counted(spark, orders):
    at, o, li = orders
    want = Counter((min(o[k], s), max(o[k], s)) for k, _, _, s, _ in li if o[k] != s)
    assert {(a, b): n for a, b, n in found(spark, "unordered_pair_counts_whole", at)} == want and max(o.values()) >= 100
    keys = sorted((k, hashlib.md5(f"{k}|{p}|{f}".encode()).hexdigest()) for k, _, p, _, f in li)
    assert sorted(found(spark, "composite_key_hash_whole", at)) == keys


def test_context_of_all_orders(spark, orders):
    at, _, li = orders
    first = {}
    for k, n, p, _, _ in li:
        first[k, p] = min(n, first.get((k, p), n))
    near = lambda k, n: [q for (j, q), m in first.items() if j == k and n - 2 <= m <= n - 1]
    want = sorted((k, n, len(near(k, n)), sum(near(k, n))) for (k, _), n in first.items())
    assert sorted(found(spark, "range_context_window_whole", at)) == want and max(w[0] for w in want) > 2000

"""Near-duplicate vectors against brute force: no false link, recall, exact counts in tight groups, edge cases."""

import numpy as np
import pytest

from heddle.llm import itq
from tests.llm.test_operators import frame

KIND = "vec_id long, embedding array<float>, n_links long, cls string"


def brute(rows, least=0.9):
    """{row: (links, component)} of [(id, vector)], and the cosines."""
    x = np.array([np.asarray(v, np.float32) for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = x @ x.T
    link = cos >= least
    np.fill_diagonal(link, False)
    root = itq._roots(len(rows), *np.nonzero(link))
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids[root[k]] = min(i, ids.get(root[k], i))
    return {i: (int(link[k].sum()), ids[root[k]]) for k, (i, _) in enumerate(rows)}, cos


def found(spark, rows, **more):
    df = frame(spark, [(i, None if v is None else np.asarray(v, float).tolist(), 7, "x") for i, v in rows], KIND).repartition(5)
    out = itq.near_duplicates(df, **more)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    return {r.vec_id: (r.n_links, r.component_id) for r in got}


def at_cosine(rng, x, cos):
    y = rng.normal(size=len(x))
    y -= (y @ x) * x / (x @ x)
    return cos * x / np.linalg.norm(x) + np.sqrt(1 - cos * cos) * y / np.linalg.norm(y)


def test_tight_groups_and_copies_are_exact(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 64))
    vectors = [centres[k % 2] * rng.uniform(0.5, 2) + rng.normal(size=64) * 0.1 for k in range(700)]
    vectors += [centres[2]] * 40 + list(rng.normal(size=(600, 64)))
    vectors += [v * 3.0 for v in vectors[700:705]]
    order = rng.permutation(len(vectors))
    rows = [(int(i), vectors[k]) for i, k in enumerate(order)]
    assert found(spark, rows) == brute(rows)[0]


@pytest.mark.parametrize(("d", "shift"), [(64, 0.0), (64, 0.15), (24, 0.0), (96, 0.05)])
def test_recall_close_to_the_threshold(spark, d, shift):
    """Pairs with cosines of 0.9 to 0.93, also where all vectors lean to one side."""
    rng = np.random.default_rng(d)
    some = rng.normal(size=(500, d)) / np.sqrt(d) + shift
    pairs = [(x, at_cosine(rng, x, rng.uniform(0.9, 0.93))) for x in some]
    rows = [(2 * k + s, p[s]) for k, p in enumerate(pairs) for s in (0, 1)]
    want, cos = brute(rows)
    got = found(spark, rows)
    assert all(n <= want[i][0] for i, (n, _) in got.items())
    all_links = sum(n for n, _ in want.values())
    assert all_links >= 900 and sum(n for n, _ in got.values()) >= 0.93 * all_links


def test_wide_groups_go_through_chunks(spark):
    """A group wider than a cell, in buckets of many chunks: each pair counts once."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    rows = [(k, centre + rng.normal(size=64) * 0.28) for k in range(400)]
    want, _ = brute(rows)
    whole, cut = found(spark, rows), found(spark, rows, chunk=30)
    assert whole == cut and all(n <= want[i][0] for i, (n, _) in whole.items())
    assert sum(n for n, _ in whole.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_cells_and_their_neighbours(spark):
    """Members of a cell, and vectors outside that link with some of them."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=64)
    rows = [(k, x + rng.normal(size=64) * 0.08) for k in range(100)] + [(100 + k, at_cosine(rng, x, c)) for k, c in enumerate(np.linspace(0.85, 0.97, 40))]
    want, _ = brute(rows)
    got = found(spark, rows)
    assert all(n <= want[i][0] for i, (n, _) in got.items())
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())


def test_edge_cases(spark):
    assert found(spark, []) == {}
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0])]
    assert found(spark, bad[:5]) == {i: (0, i) for i in range(1, 6)}
    rows = [*bad, (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [0.0, 1.0]), (10, [-1.0, 0.0])]
    assert found(spark, rows) == {**{i: (0, i) for i in (*range(1, 7), 9, 10)}, 7: (1, 7), 8: (1, 7)}
    df = frame(spark, [(None, [1.0, 0.0], 1, "x"), (5, [1.0, 0.0], 1, "x"), (5, [0.0, 1.0], 1, "x"), (None, [1.0, 1.0], 1, "y")], KIND)
    assert sorted(map(tuple, itq.near_duplicates(df).collect()), key=repr) == sorted([(None, 1, 5, False), (5, 1, 5, True), (5, 0, 5, True), (None, 0, None, True)], key=repr)
    one_sided = [(1, [1.0]), (2, [3.0]), (3, [-1.0])]
    assert found(spark, one_sided) == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
    huge = [(1, [3e38, 3e38]), (2, [1e-40, 1e-40]), (3, [1e-40, -1e-40])]
    assert found(spark, huge) == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_first_meeting_is_one_bucket_of_both():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**63, (300, 2), dtype=np.uint64)
    flips = np.array([[sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(2)] for _ in range(300)], np.uint64)
    b = a ^ flips
    for k, table in enumerate(itq.first_meeting(a, b)):
        shared = set(itq.keys(a[k : k + 1])[0].tolist()) & set(itq.keys(b[k : k + 1])[0].tolist())
        assert (table < 0) == (not shared)
        assert table < 0 or sum(1 for x in shared if x >> 32 == table) == 1

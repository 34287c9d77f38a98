"""Whitening against a dense eigendecomposition, and its edge cases."""

import numpy as np
import pytest

from heddle.llm import queries
from heddle.llm import whitening as W
from tests import oracle
from tests.llm.test_operators import frame

KIND = "vec_id long, embedding array<double>, n long, component string"


def check(rows, got, most=16):
    """rows: (id, vector) that take part; got: the operator's rows."""
    x = np.array([[int(np.floor(64 * c)) + 1000000 for c in v] for _, v in rows], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, sums = len(fit), fit.sum(0)
    centred = ((fit * n - sums) / n).astype(float)
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, x.shape[1])
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        assert (r.n, r.identity_error <= 1e-4) == (n, True)
        by.setdefault(r.component, []).append(r)
    for c in range(1, k + 1):
        mine = sorted(by[c], key=lambda r: r.vec_id)
        order = sorted(range(len(rows)), key=lambda i: rows[i][0])
        assert [r.deviation for r in mine] == [d if (d := sum(int(a) ** 2 for a in x[i] * n - sums)) < 1 << 63 else None for i in order]
        assert all(abs(r.explained - e[c - 1] / e.sum()) <= 1e-9 for r in mine)
        want = np.array([((x[i] * n - sums) / n).astype(float) @ v[:, c - 1] for i in order]) / np.sqrt(e[c - 1])
        mine = np.array([r.whitened for r in mine])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6


@pytest.mark.skipif(not oracle.there(), reason="no fixture tables")
def test_equals_eigendecomposition_on_the_tables(spark):
    t = spark.read.parquet(f"{oracle.SF}/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in t.collect()], queries.op11_whitening(spark, oracle.SF).collect())


def test_copies_count_once_and_bad_vectors_go(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(150, 5)) * [9, 4, 2, 1, 0.5])]
    rows += [(200 + i, rows[0][1]) for i in range(300)] + [(600, [1e6, -2e5, 3.0, 0.0, 1.0])]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [1.0, float("nan"), 1.0, 1.0, 1.0]), (904, [float("inf")] * 5), (905, [1.0, 2.0]), (906, [1e300] * 5)]
    df = frame(spark, [(i, v, 1, "x") for i, v in rows + bad], KIND).repartition(7)
    check(rows, W.whitened_components(df).collect())
    assert {r.component for r in W.whitened_components(df, most=2).collect()} == {1, 2}


def test_jacobi_keeps_small_deviations():
    rng = np.random.default_rng(2)
    u, _ = np.linalg.qr(rng.normal(size=(40, 9)))
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    sizes = 10.0 ** -np.arange(9)
    norms, v = W.jacobi(np.linalg.qr(u * sizes @ q.T, mode="r"))
    assert np.allclose(norms, sizes, rtol=1e-7) and np.allclose(v.T @ v, np.eye(9), atol=1e-13)
    assert np.allclose(np.abs(v.T @ q), np.eye(9), atol=1e-7)


def test_rounds_meet_each_pair_once():
    for d in (1, 2, 5, 8):
        met = [(int(a), int(b)) for p, q in W._rounds(d) for a, b in zip(p, q, strict=True)]
        assert sorted(met) == [(a, b) for a in range(d) for b in range(a + 1, d)]


def test_blocks_fold_to_one_r():
    x = np.random.default_rng(3).normal(size=(3000, 6))
    r = W.folded(iter(np.array_split(x, 17)))
    assert r.shape == (6, 6) and np.allclose(r.T @ r, x.T @ x)


def test_no_variance_and_empty(spark):
    assert W.whitened_components(frame(spark, [], KIND)).collect() == []
    assert W.whitened_components(frame(spark, [(1, None, 1, "x")], KIND)).collect() == []
    got = W.whitened_components(frame(spark, [(1, [1.0, 2.0], 1, "x"), (None, [1.0, 2.0], 2, "y")], KIND)).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in got} == {(i, k, 1, 0, None, 0.0) for i in (1, None) for k in (1, 2)}
    got = W.whitened_components(frame(spark, [(1, [1.0, 7.0], 1, "x"), (2, [3.0, 7.0], 2, "y")], KIND)).collect()
    assert {(r.vec_id, r.component, r.whitened is None) for r in got} == {(1, 1, False), (2, 1, False), (1, 2, True), (2, 2, True)}


def test_exact_where_64_bits_are_too_few():
    m = W._numerators(np.array([[2**60, 5]]), 1000, np.array([7, 2**70], object))
    assert m.tolist() == [[2**60 * 1000 - 7, 5000 - 2**70]] and W._deviation(m) == [None]
    assert W._deviation(np.array([[3_000_000_000, 1]], object)) == [9 * 10**18 + 1]

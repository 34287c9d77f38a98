"""Nearest neighbours where ids have many codes."""

import numpy as np

from heddle.llm import hamming
from tests.llm.test_operators import brute_top_k, frame


def test_ids_with_more_than_k_codes(spark):
    rng = np.random.default_rng(2)
    centre = np.ones(64)
    near = [(i, np.where(np.arange(64) == j, -1.0, centre).tolist()) for i, js in ((1, range(30)), (2, range(20, 50))) for j in js]
    rows = [(0, centre.tolist()), *near, *((k, rng.normal(size=64).tolist()) for k in range(3, 120)), *((20, rng.normal(size=64).tolist()) for _ in range(9))]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    for shard in (32768, 40):
        got = {}
        for r in hamming.top_k(df, df.where("vec_id % 20 = 0"), 5, shard=shard).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.neighbour_id, r.distance))
        assert got == brute_top_k(rows, range(0, 120, 20), 5)

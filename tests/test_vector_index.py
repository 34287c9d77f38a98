"""The stored vector index equals the search of all rows, and reads few parts where vectors lie in groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import search as S
from heddle.operators import vector_index as V
from heddle.sources.versions import Versions

KIND = "vec_id long, embedding array<double>"


def rows(n, groups, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, 24))
    return [(k, (centre[k % groups] + rng.normal(size=24) * 0.15).tolist()) for k in range(n)]


def same(got, want):
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_equals_the_search_of_all_rows(spark, tmp_path):
    df = spark.createDataFrame(rows(900, 12, 1), KIND)
    store = Versions(spark, str(tmp_path / "s"))
    assert V.build(store, df, centroids=12, most=40) == {"version": 1, "left_out": 0, "vectors": 900}
    q = df.where("vec_id % 20 = 0")
    for k, floor in ((10, 0.0), (3, 0.9), (120, 0.2)):
        found, read = V.searched(store, q, k, floor)
        same(found, S.nearest(df, q, k, floor))
        if k < 100:
            assert read.agg(F.avg(F.col("parts_read") / F.col("parts"))).first()[0] < 0.35
    more = spark.createDataFrame([(5000 + k, v) for k, (_, v) in enumerate(rows(200, 15, 2))], KIND)
    assert V.add(store, more)["vectors"] == 1100
    same(V.searched(store, q, 10)[0], S.nearest(df.unionByName(more), q, 10))


def test_edge_cases(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        V.build(store, spark.createDataFrame([(1, None)], KIND))
    bad = [(1, None), (2, [0.0, 0.0]), (3, [1.0]), (None, [1.0, 1.0]), (4, [float("nan"), 1.0])]
    df = spark.createDataFrame([*bad, (5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [-1.0, 0.0])], KIND)
    assert V.build(store, df)["left_out"] == 5
    assert sorted(map(tuple, V.searched(store, df, 2, -1.0)[0].collect())) == [(5, 6, 1.0), (5, 7, -1.0), (6, 5, 1.0), (6, 7, -1.0), (7, 5, -1.0), (7, 6, -1.0)]
    assert V.searched(store, df.where("false"))[0].count() == 0

"""A stored vector index: parts around centroids, read only where the triangle inequality allows an answer.

A bounded sample (`sample` rows, those with the smallest hashes) gives `centroids` centroids by k-means on the sphere; every
vector is stored with its nearest one, in rings of RING degrees around it, and rings above `most` rows in several parts. A
manifest holds vectors, parts and centroids of one version (`sources.versions`); added vectors are new rows of the same parts.

A query's angle to a centroid and a part's least and largest angle to it bound the angle to every vector of the part. First
each query reads the parts with the least bounds that hold k vectors together; then all others whose bound is below the k-th score
found. The result equals the search of all rows; `searched` also says how many parts each query reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.rows import first_per_key
from heddle.operators.search import _best_of_blocks
from heddle.sources.versions import Versions

SAMPLE, CENTROIDS, RING, MOST = 20_000, 256, 3.0, 50_000
#: Queries by parts whose bounds a task holds at once.
BOUNDS = 50_000


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def centroids_of(unit: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by k-means on the sphere, the first ones farthest from each other."""
    centre = [unit[0]]
    near = unit @ centre[0]
    while len(centre) < min(k, len(unit)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-12:
            break
        centre.append(unit[far])
        near = np.maximum(near, unit @ unit[far])
    c = np.array(centre)
    for _ in range(rounds):
        own = (unit @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, unit)
        size = np.sqrt((total * total).sum(1))
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


def _good(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return v.where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")


def _placed(centres: np.ndarray):
    """(id, v, cluster, angle in degrees) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cos = _units(np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1)) @ centres.T
                best = cos.argmax(1)
                angle = np.degrees(np.arccos(np.clip(cos[np.arange(len(best)), best], -1, 1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int32()), pa.array(angle)], names=["id", "v", "cluster", "angle"])

    return run


def _parts(placed: DataFrame, most: int) -> DataFrame:
    """(cluster, ring, n, low, high, pieces)."""
    g = placed.groupBy("cluster", F.floor(F.col("angle") / RING).cast("int").alias("ring")).agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    return g.withColumn("pieces", F.ceil(F.col("n") / most).cast("int"))


def build(store: Versions, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, sample: int = SAMPLE, most: int = MOST) -> dict:
    """Writes the index as a new version. Null, zero and non-finite vectors and those of another than the most frequent length are left out and counted."""
    good = _good(vectors, id_col, vector)
    n = vectors.count()
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        raise ValueError("no vector to index")
    good = good.where(F.size("v") == common.d)
    share = min(1.0, 0.95 * sample / common["count"])
    drawn = good.where((F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))) | F.lit(share == 1)).select("v").limit(sample)
    unit = _units(np.array([r.v for r in drawn.collect()] or [good.first().v], float))
    centres = centroids_of(unit[np.lexsort(unit.T)], centroids)
    placed = good.mapInArrow(_placed(centres), "id long, v array<double>, cluster int, angle double").withColumn("ring", F.floor(F.col("angle") / RING).cast("int"))
    work = store.new_work()
    placed.repartition("cluster", "ring").write.parquet(work)
    placed = store.spark.read.schema(placed.schema).parquet(work)
    parts = _parts(placed, most)
    c = store.spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(centres)], "cluster int, centre array<double>")
    # sorted by part, so that footers let a scan skip what it does not need
    rows = placed.repartition("cluster", "ring").sortWithinPartitions("cluster", "ring")
    m = store.commit({"vectors": rows, "parts": parts, "centroids": c}, {"left_out": n - common["count"], "vectors": common["count"]})
    store.drop_work(work)
    return {"version": m.version, **m.notes}


def add(store: Versions, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = MOST) -> dict:
    """Adds vectors to the centroids that are there; their rows are appended, the parts' bounds renewed."""
    base = store.manifest()
    centres = _centres(store)
    good = _good(vectors, id_col, vector).where(F.size("v") == centres.shape[1])
    placed = good.mapInArrow(_placed(centres), "id long, v array<double>, cluster int, angle double").withColumn("ring", F.floor(F.col("angle") / RING).cast("int"))
    both = store.read("parts").select("cluster", "ring", "n", "low", "high").unionByName(_parts(placed, most).select("cluster", "ring", "n", "low", "high"))
    parts = both.groupBy("cluster", "ring").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).withColumn("pieces", F.ceil(F.col("n") / most).cast("int"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    m = store.commit({"parts": parts}, {**base.notes, "vectors": total}, base.version, append={"vectors": placed})
    return {"version": m.version, **m.notes}


def _centres(store: Versions) -> np.ndarray:
    return np.array([r.centre for r in store.read("centroids").orderBy("cluster").collect()])


def _bounded(centres: np.ndarray, parts: np.ndarray, k: int, floor: float, found: bool):
    """Of queries (id, v, kth) the parts to read: rows (id, v, cluster, ring). parts: cluster, ring, n, low, high.

    First (not `found`) those with the least bounds that hold k vectors; then the rest that could hold a score above the k-th, or as high.
    """
    cluster, ring, n, low, high = parts.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few queries at once: one may have to read every part, with its vector in each of these rows
        step = max(1, BOUNDS // max(len(parts), 1))
        for b in (whole.slice(s, step) for whole in batches for s in range(0, whole.num_rows, step)):
            unit = _units(np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1))
            angle = np.degrees(np.arccos(np.clip(unit @ centres.T, -1, 1)))[:, cluster.astype(int)]
            bound = np.maximum(np.maximum(angle - high, low - angle), 0)
            order = np.lexsort((angle, bound))
            # of the parts in that order those before which fewer than k vectors (and the query itself) stand
            before = np.cumsum(n[order], 1) - n[order]
            first = np.zeros_like(bound, bool)
            np.put_along_axis(first, order, before < k + 1, 1)
            if found:
                kth = np.maximum(np.array([-1.0 if x is None else x for x in b.column(2).to_pylist()]), floor) - 1e-4  # scores have four digits
                first = ~first & (np.cos(np.radians(np.maximum(bound - 1e-6, 0))) >= kth[:, None])
            row, part = np.nonzero(first)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cluster[part], pa.int32()), pa.array(ring[part], pa.int32())], names=["id", "v", "cluster", "ring"])

    return run


def searched(store: Versions, queries: DataFrame, k: int = 10, floor: float = 0.0, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(query_id, neighbour_id, score): the k best vectors of each query by cosine, four digits, no row its own neighbour; and (query_id, parts_read, parts)."""
    spark = store.spark
    centres, work = _centres(store), store.new_work()
    # a row for each part: at most 60 rings a centroid
    pieces = store.read("parts").select("cluster", "ring", "n", "low", "high", "pieces")
    table = np.array([tuple(r)[:5] for r in pieces.orderBy("cluster", "ring").collect()], float).reshape(-1, 5)
    q = _good(queries, id_col, vector).where(F.size("v") == centres.shape[1])
    vectors = store.read("vectors").select("cluster", "ring", "id", "v")

    def best(asked: DataFrame) -> DataFrame:
        # each part's pieces lie in tasks of their own; its queries go to each of them
        piece = F.struct("cluster", "ring", "piece")
        needed = asked.select("cluster", "ring").distinct().join(F.broadcast(pieces.select("cluster", "ring", "pieces")), ["cluster", "ring"])
        v = vectors.join(F.broadcast(needed), ["cluster", "ring"]).select("cluster", "ring", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), F.lit(0).alias("asks"), "id", "v")
        a = asked.join(F.broadcast(pieces.select("cluster", "ring", "pieces")), ["cluster", "ring"]).select("cluster", "ring", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(1).alias("asks"), "id", "v")
        dealt = v.unionByName(a).withColumn("block", F.xxhash64(piece)).repartition("block").sortWithinPartitions("block", "asks").select("block", "asks", "id", "v")
        return dealt.mapInArrow(_best_of_blocks(k, floor), "query_id long, neighbour_id long, score double")

    kind = "id long, v array<double>, cluster int, ring int"
    one = q.select("id", "v", F.lit(None).cast("double").alias("kth")).mapInArrow(_bounded(centres, table, k, floor, False), kind)
    one.write.parquet(f"{work}/one")
    one = spark.read.schema(one.schema).parquet(f"{work}/one")
    near = best(one)
    near.write.parquet(f"{work}/near")
    near = spark.read.schema(near.schema).parquet(f"{work}/near")
    kth = first_per_key(near, ["query_id"], [F.desc("score"), F.asc("neighbour_id")], k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
    rest = q.join(kth, q["id"] == kth["query_id"], "left").select("id", "v", "kth").mapInArrow(_bounded(centres, table, k, floor, True), kind)
    rest.write.parquet(f"{work}/rest")
    rest = spark.read.schema(rest.schema).parquet(f"{work}/rest")
    out = first_per_key(near.unionByName(best(rest)), ["query_id"], [F.desc("score"), F.asc("neighbour_id")], k)
    read = one.select("id").unionByName(rest.select("id")).groupBy(F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("parts_read")).withColumn("parts", F.lit(len(table)).cast("long"))
    return out, read

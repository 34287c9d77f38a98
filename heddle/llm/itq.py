"""Embedding near-duplicates by iterative quantisation, multi-index Hamming tables and a rerank with the vectors.

1. Equal vectors are one class with a weight and a smallest id. A sample of about SAMPLE classes, those with the smallest
   hashes, fits the index; every class is indexed.
2. Iterative quantisation: the sample is centred and turned to its principal axes; then signs and the rotation that fits them
   best (an SVD) are found in turn. A class's code is the signs of its turned vector: 64 bits a word. Below 64 dimensions a
   word holds several rotations. Words are added until pairs with a cosine of exactly `least`, made from the sample's vectors by
   random turns, are found in 96 of 100 cases. If CENTRED_WORDS do not reach that, as where all vectors lie in one group
   around their mean, codes are taken without centring: less balanced, but as near as the angles are.
3. Each word is cut into SEGMENTS. Classes meet in a table's bucket if they agree in a segment but for at most one bit: a class
   is stored under each segment with each of its bits hidden. So a bucket holds whole vectors, and no candidates are shuffled.
4. Rerank: in each bucket cosines are computed in double precision. A pair counts in the first bucket that shows it, told by
   its codes. A bucket gives for each class its number of links there and the smallest class of its component there.
   Above CHUNK classes a bucket is cut into chunks, and each two chunks meet in a task of their own.
5. Tight groups make no pairs: where 8 classes or more of the sample are close to their mean, the mean is the centre of a
   cell. All classes within half the angle of `least` around a centre link with each other, by the triangle inequality, and are counted by a
   sum. Members of a cell enter the tables only if some class outside could reach one of them. At most SAMPLE / 8 centres
   are sent. A group whose share of the rows is too small for the sample, or that is wider than a cell, goes through the tables.
6. Links become components.

Recall against brute force is measured in tests: above 0.9 for cosines just above `least`, 1.0 for closer copies.

Edge cases: vectors that are null, zero, or hold null or non-finite numbers link with nothing; so do those of another than the
most frequent length (the longer of equals). Each row has a row in the result; rows with one id and different vectors are
different vectors. A null id belongs to its class's component, whose id is null if no id is in it. Copies link with each other and
count one by one. An empty table has no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import small_batches, small_side, written
from heddle.llm.components import components

LEAST = 0.9
SAMPLE, SEGMENTS, MOST_WORDS, CENTRED_WORDS, CHUNK = 8192, 5, 8, 2, 2048
#: Classes of the sample that make a cell, and how far inside its edge a member must be, for rounding.
DENSE, MARGIN = 8, 1e-9
_EDGE = [round(64 * s / SEGMENTS) for s in range(SEGMENTS + 1)]


def _unit(m: np.ndarray) -> np.ndarray:
    # first by the largest number, so that squares neither vanish nor overflow
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def rotation(v: np.ndarray, rng: np.random.Generator, bits: int, rounds: int = 30) -> np.ndarray:
    """Columns that turn centred rows v into `bits` balanced signs: principal axes, then iterative quantisation."""
    _, axes = np.linalg.eigh(v.T @ v)
    axes = axes[:, ::-1][:, :bits]
    low = v @ axes
    turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(rounds):
        signs = np.where(low @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ low)
        turn = (left @ right).T
    return axes @ turn


@dataclass(frozen=True)
class Index:
    """mean and axes (one matrix of 64 columns a word) give codes; centres are unit vectors of cells."""

    mean: np.ndarray
    axes: list[np.ndarray]
    centres: np.ndarray
    least: float
    #: Share of made pairs at `least` that the tables show.
    recall: float

    def words(self, unit: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, one unsigned number a word."""
        powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
        return np.stack([((unit - self.mean) @ a > 0).astype(np.uint64) @ powers for a in self.axes], 1)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit vector (-1: none), and for each vector which other cells have members it could link with."""
        if not len(self.centres):
            return np.full(len(unit), -1), np.zeros((len(unit), 0), bool)
        cos = unit @ self.centres.T
        half = np.arccos(self.least) / 2
        best = cos.argmax(1)
        inner = cos[np.arange(len(unit)), best] >= np.cos(half) + MARGIN
        near = cos >= np.cos(min(3 * half, np.pi)) - MARGIN
        near[np.flatnonzero(inner), best[inner]] = False
        return np.where(inner, best, -1), near


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of codes (rows of words) the table (word, segment, hidden bit) that shows them first, as one number; -1 for none."""
    found = np.full(len(a), -1, np.int64)
    for t in range(a.shape[1] - 1, -1, -1):
        apart = a[:, t] ^ b[:, t]
        for s in range(SEGMENTS - 1, -1, -1):
            part = apart >> np.uint64(_EDGE[s]) & np.uint64((1 << _EDGE[s + 1] - _EDGE[s]) - 1)
            n = np.bitwise_count(part)
            # of a power of two the exponent; 0 of 0
            bit = np.bitwise_count(part - np.uint64(1)).astype(np.int64) * (n == 1)
            found = np.where(n <= 1, (t * SEGMENTS + s) << 6 | bit, found)
    return found


def keys(words: np.ndarray) -> np.ndarray:
    """All buckets of each code: (table << 32 | the segment without the hidden bit), one row a code."""
    out = []
    for t in range(words.shape[1]):
        for s in range(SEGMENTS):
            wide = _EDGE[s + 1] - _EDGE[s]
            part = (words[:, t] >> np.uint64(_EDGE[s]) & np.uint64((1 << wide) - 1)).astype(np.int64)
            out += [((t * SEGMENTS + s) << 6 | b) << 32 | part & ~(1 << b) for b in range(wide)]
    return np.stack(out, 1)


def _centres(unit: np.ndarray, least: float) -> np.ndarray:
    """Means of dense groups of the sample, the densest first; each explains members that no earlier one does."""
    half = np.cos(np.arccos(least) / 2)
    small = unit.astype(np.float32)
    crowd = np.concatenate([(small[k : k + 1024] @ small.T >= least).sum(1) for k in range(0, len(small), 1024)])
    free, out = np.ones(len(unit), bool), []
    for i in np.argsort(-crowd, kind="stable"):
        if crowd[i] < DENSE:
            break
        if not free[i]:
            continue
        free_at = np.flatnonzero(free)
        near = free_at[unit[free_at] @ unit[i] >= least]
        free[i] = False
        if len(near) < DENSE:
            continue
        centre = unit[near].mean(0)
        centre /= np.sqrt(centre @ centre)
        inner = free_at[unit[free_at] @ centre >= half]
        if len(inner) >= DENSE:
            free[inner] = False
            out.append(centre)
    return np.array(out).reshape(-1, unit.shape[1])


def fit(unit: np.ndarray, least: float = LEAST, recall: float = 0.96, seed: int = 12) -> Index:
    """The index of unit vectors like those of the sample."""
    rng = np.random.default_rng(seed)
    mean, d = unit.mean(0), unit.shape[1]
    probe = unit[:2048]
    turn = rng.normal(size=probe.shape)
    turn -= (turn * probe).sum(1, keepdims=True) * probe
    size = np.sqrt((turn * turn).sum(1, keepdims=True))
    twin = least * probe + np.sqrt(1 - least * least) * turn / np.where(size > 0, size, 1)
    for middle, most in ((mean, CENTRED_WORDS), (np.zeros(d), MOST_WORDS)):
        axes: list[np.ndarray] = []
        bits, met = min(d, 64), 0.0
        while met < recall and len(axes) < most:
            axes.append(np.hstack([rotation(unit - middle, rng, bits) for _ in range(-(-64 // bits))])[:, :64])
            index = Index(middle, axes, np.zeros((0, d)), least, 0.0)
            met = float((first_meeting(index.words(probe), index.words(twin)) >= 0).mean())
        if met >= recall:
            break
    return Index(middle, axes, _centres(unit, least), least, met)


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return np.asarray(col.flatten(), float).reshape(len(col), d)


def _coded(index, d: int):
    """(cls, weight, words, cell, visits, v) of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = index.value
        for b in batches:
            if b.num_rows:
                unit = _unit(_matrix(b.column(2), d))
                cell, near = model.cells(unit)
                words = model.words(unit).view(np.int64)
                visits = [np.flatnonzero(r) for r in near]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(words), pa.list_(pa.int64())), pa.array(cell, pa.int32()), pa.array(visits, pa.list_(pa.int32())), b.column(2)], names=["cls", "weight", "words", "cell", "visits", "v"])

    return run


def _bucketed(words: int, whole: bool):
    """Each class under each of its buckets: the buckets alone, or all that a bucket needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for k in range(0, whole_batch.num_rows, 256):
                b = whole_batch.slice(k, 256)
                key = keys(np.asarray(b.column(0).flatten()).view(np.uint64).reshape(-1, words))
                at = pa.array(np.repeat(np.arange(len(key)), key.shape[1]))
                own = pa.array(key.ravel())
                yield pa.RecordBatch.from_arrays([own, *(b.column(c).take(at) for c in range(b.num_columns) if whole)], names=["key", *(b.schema.names if whole else [])])

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n can reach by links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bucket_links(table: int, unit: np.ndarray, words: np.ndarray, cell: np.ndarray, least: float, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one bucket's rows that link, are not of one cell, and are shown by this table first; with `left`, only pairs across."""
    rows, cols = (np.arange(len(unit)), np.arange(len(unit))) if left is None else (np.flatnonzero(left), np.flatnonzero(~left))
    found = []
    for k in range(0, len(rows), 512):
        own = rows[k : k + 512]
        i, j = np.nonzero(unit[own] @ unit[cols].T >= least)
        i, j = own[i], cols[j]
        keep = (cell[i] < 0) | (cell[i] != cell[j])
        if left is None:
            keep &= i < j
        i, j = i[keep], j[keep]
        if len(i):
            first = first_meeting(words[i], words[j]) == table
            found.append((i[first], j[first]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def _reranked(least: float, d: int, n_words: int):
    """Rows (key, low, high, chunk, words, cls, weight, cell, v) sorted by (key, low, high); gives (cls, links, root)."""
    schema = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def bucket(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        t = t.combine_chunks()
        unit = _unit(np.asarray(t["v"].chunk(0).flatten(), float).reshape(-1, d))
        words = np.asarray(t["words"].chunk(0).flatten()).view(np.uint64).reshape(-1, n_words)
        cell, cls, weight = t["cell"].to_numpy(), t["cls"].to_numpy(), t["weight"].to_numpy()
        key, low, high = (t[c][0].as_py() for c in ("key", "low", "high"))
        i, j = bucket_links(key >> 32, unit, words, cell, least, None if low == high else t["chunk"].to_numpy() == low)
        if not len(i):
            return None
        links = np.bincount(i, weight[j], len(cls)).astype(np.int64) + np.bincount(j, weight[i], len(cls)).astype(np.int64)
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(links[at]), pa.array(cls[_roots(len(cls), i, j)[at]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            place = np.stack([b.column(k).to_numpy() for k in range(3)])
            cut = np.flatnonzero(np.r_[True, (place[:, 1:] != place[:, :-1]).any(0)])
            for i, j in zip(cut, [*cut[1:], b.num_rows], strict=True):
                if at != (now := tuple(place[:, i])):
                    if rest and (out := bucket(pa.concat_tables(rest))):
                        yield out
                    rest, at = [], now
                rest.append(t.slice(i, j - i))
        if rest and (out := bucket(pa.concat_tables(rest))):
            yield out

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors."""
    if not 0 < least < 1:
        raise ValueError("the least cosine lies between 0 and 1")
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(f"`{vector_col}`")
    good = F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(F.coalesce(good, F.lit(False)), v).alias("v"))
    common = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    alone = rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if common is None:
        return alone
    d = common.d
    rows = rows.withColumn("v", F.expr(f"if(size(v) = {d}, v, null)"))
    classes = rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least")).withColumn("cls", F.monotonically_increasing_id())
    classes = written(classes, "vector-classes")
    n = classes.count()
    share = min(1.0, 0.95 * sample / n)
    drawn = classes.where((F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))) | F.lit(share == 1)).select("v").limit(sample)
    unit = _unit(np.array([r.v for r in drawn.collect()] or [classes.first().v], float))
    model = fit(unit[np.lexsort(unit.T)], least)
    n_words = len(model.axes)
    index = spark.sparkContext.broadcast(model)
    kind = classes.schema["v"].dataType.simpleString()
    coded = written(classes.select("cls", "weight", "v").mapInArrow(_coded(index, d), f"cls long, weight long, words array<long>, cell int, visits array<int>, v {kind}"), "vector-codes")
    # at most sample / 8 cells
    visited = [r.c for r in coded.select(F.explode("visits").alias("c")).distinct().collect()]
    open_ = (F.col("cell") < 0) | (F.size("visits") > 0)
    if visited:
        open_ = open_ | F.col("cell").isin(visited)
    stored = coded.where(open_)
    crowded = stored.select("words").mapInArrow(_bucketed(n_words, False), "key long").groupBy("key").count().where(F.col("count") > chunk)
    crowded = small_side(written(crowded.select(F.col("key").alias("hot"), F.ceil(F.col("count") / chunk).alias("chunks")), "crowded-buckets"), "hot")
    held = stored.select("words", "cls", "weight", "cell", "v").mapInArrow(_bucketed(n_words, True), f"key long, words array<long>, cls long, weight long, cell int, v {kind}")
    held = held.join(crowded, F.col("key") == F.col("hot"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    held = held.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "words", "cls", "weight", "cell", "v")
    met = held.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    links = written(met.mapInArrow(_reranked(least, d, n_words), "cls long, links long, root long"), "vector-links")
    inner = coded.where("cell >= 0")
    cells = inner.groupBy("cell").agg(F.sum("weight").alias("all"), F.min("cls").alias("head"))
    inner = inner.select("cls", "weight", "cell").join(F.broadcast(cells), "cell")
    edges = links.select("cls", F.col("root").alias("to")).unionByName(inner.select("cls", F.col("head").alias("to")))
    groups = components(edges, "cls", "to").select(F.col("node").alias("cls"), "component").distinct()
    degree = links.select("cls", "links").unionByName(inner.select("cls", (F.col("all") - F.col("weight")).alias("links"))).groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.select("cls", "v", "weight", "least").join(degree, "cls", "left").join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    known = written(known, "vector-groups")
    first = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(first, "component").select(F.col("v").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.join(known, F.col("v") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))

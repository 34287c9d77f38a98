"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit for each of its first 64 numbers, set where the number is above zero. Codes lie in shards of about
`shard` codes; a shard indexes its codes in `segments` equal parts (by its size: 4, or 8 below 4096 codes). A query looks up its own value of each part, then all
values at Hamming distance 1, 2, ... from it; once radius r is done in every part, every code within segments * (r + 1) - 1
bits has been met, and the query ends as soon as its k-th verified distance is not above that. A code is taken at the
smallest (radius, part) that shows it, so it comes once. Where a radius has more values than the shard has codes, the codes
themselves are all verified. The nearest of all shards are ranked at last.

Equal codes are one class: shards hold each code once, with its k + 1 smallest ids, which suffice because ties are ordered by
id. Queries with one code are answered together. Each block of queries meets each shard in one task, whose memory is bounded
by the sizes of both; it gives `most` rows for a query at most. Shards and blocks are large, so that few copies of either are
sent: for n codes and m queries n * m / block + n * m / shard rows.

An id with several codes may be met in several classes. So `most` is one more than the k largest numbers of codes per id
together, which are counted first: that many pairs of id and code hold more than k ids. It is k + 1 where ids are unique.

Edge cases: a null vector or id is neither indexed nor asked; numbers beyond the 64th are ignored, missing or null ones count
as not above zero, so an empty vector has code 0. Rows with one id and one code count once; an id with several codes counts
by its nearest. If fewer than k others exist, all of them are returned. A query is never its own neighbour. Empty tables give
no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import written

BITS = 64
SHARD, BLOCK = 32_768, 32_768


def codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code) of each row, distinct."""
    bits = "aggregate(sequence(1, 64), 0L, (a, i) -> a | if(coalesce(try_element_at(v, i), 0) > 0, shiftleft(1L, i - 1), 0L))"
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v")).where("id is not null and v is not null")
    return v.select("id", F.expr(bits).alias("code")).distinct()


class Shard:
    """A multi-index over distinct codes; held: how many ids each code stands for."""

    def __init__(self, code: np.ndarray, first_id: np.ndarray, held: np.ndarray, segments: int | None = None):
        segments = segments or (4 if len(code) >= 4096 else 8)  # parts of about log2(codes) bits, so that radii grow instead of a scan
        self.code, self.first_id, self.held = code.astype(np.uint64), first_id, held
        self.segments, self.width = segments, BITS // segments
        self.low = np.uint64((1 << self.width) - 1)
        self.order, self.begin = [], []
        for s in range(segments):
            value = self.part(self.code, s)
            self.order.append(np.argsort(value, kind="stable"))
            self.begin.append(np.searchsorted(value[self.order[-1]], np.arange((1 << self.width) + 1)))

    def part(self, code: np.ndarray, s: int) -> np.ndarray:
        return ((code >> np.uint64(s * self.width)) & self.low).astype(np.int64)

    def nearest(self, q: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index, distance) of the k nearest classes, by distance and first id: all that are not farther than the k-th id."""
        q = np.uint64(q & (2**64 - 1))
        at, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for radius in range(self.width + 1):
            masks = _masks(self.width, radius)
            if len(masks) * self.segments >= len(self.code):
                at, far, covered = [np.arange(len(self.code))], [np.bitwise_count(self.code ^ q).astype(np.int64)], BITS
            else:
                for s in range(self.segments):
                    value = self.part(q, s) ^ masks
                    start, stop = self.begin[s][value], self.begin[s][value + 1]
                    n = stop - start
                    if not n.any():
                        continue
                    found = self.order[s][np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                    apart = self.code[found] ^ q
                    by_part = np.stack([np.bitwise_count((apart >> np.uint64(t * self.width)) & self.low) for t in range(self.segments)])
                    here = (by_part >= radius).all(0) & (by_part[:s] > radius).all(0)
                    at.append(found[here])
                    far.append(by_part[:, here].sum(0, dtype=np.int64))
                covered = self.segments * (radius + 1) - 1
            index, distance = np.concatenate(at), np.concatenate(far)
            if covered >= BITS or self.held[index[distance <= covered]].sum() >= k:
                break
        best = np.lexsort((self.first_id[index], distance))[:k]
        return index[best], distance[best]


def _masks(width: int, radius: int, known: dict = {}) -> np.ndarray:  # noqa: B006  kept by each worker, at most 2^width numbers
    """All numbers of `width` bits with `radius` bits set."""
    if (width, radius) not in known:
        known[width, radius] = np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)
    return known[width, radius]


def _searched(k: int, segments: int | None):
    """Rows (shard, block, asks, code, first_id, held) arrive by (shard, block), codes before queries."""
    schema = pa.schema([("q", pa.int64()), ("code", pa.int64()), ("distance", pa.int32()), ("first_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for b in batches:
            place = np.asarray(b.column(0)) << 32 | np.asarray(b.column(1))
            asks = np.asarray(b.column(2))
            cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (asks[1:] != asks[:-1])]) if b.num_rows else []
            for i, j in zip(cut, [*cut[1:], b.num_rows], strict=True):
                if place[i] != at:
                    at, parts, shard = place[i], [], None
                if not asks[i]:
                    parts.append([np.asarray(b.column(c))[i:j] for c in (3, 4, 5)])
                    continue
                if shard is None and parts:
                    shard = Shard(*(np.concatenate(c) for c in zip(*parts, strict=True)), segments)
                if shard is None:
                    continue
                rows = [(q, *shard.nearest(int(q), k)) for q in np.asarray(b.column(3))[i:j]]
                index = np.concatenate([r[1] for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]), pa.int64()), pa.array(shard.code[index].view(np.int64)), pa.array(np.concatenate([r[2] for r in rows]).astype(np.int32)), pa.array(shard.first_id[index])], schema=schema)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", segments: int | None = None, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest of vectors for each of queries, by distance, then id."""
    entries = written(codes(vectors, id_col, vector_col), "codes")
    asked = written(codes(queries, id_col, vector_col), "asked-codes")
    most = 1 + sum(r["count"] for r in entries.groupBy("id").count().orderBy(F.desc("count")).limit(k).collect())
    # a query may own one id of each class, so k + 1 ids always leave k others
    by_code = Window.partitionBy("code").orderBy("id")
    index = entries.withColumn("r", F.row_number().over(by_code)).where(F.col("r") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    index = written(index, "code-index")
    q = written(asked.select(F.col("code").alias("q")).distinct(), "query-codes")
    shards, asking = -(-index.count() // shard) or 1, q.count()
    # at most `block` queries meet a shard in one task; where cores would be idle, fewer
    blocks = max(-(-asking // block), min(-(-2 * vectors.sparkSession.sparkContext.defaultParallelism // shards), asking)) or 1
    stored = index.select(F.expr(f"pmod(xxhash64(code), {shards})").alias("shard"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), F.lit(False).alias("asks"), "code", F.expr("ids[0]").alias("first_id"), F.size("ids").cast("long").alias("held"))
    sent = q.select(F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), F.expr(f"pmod(xxhash64(q, 1), {blocks})").alias("block"), F.lit(True).alias("asks"), F.col("q").alias("code"), F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("long").alias("held"))
    dealt = stored.unionByName(sent).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "asks")
    found = dealt.mapInArrow(_searched(most, segments), "q long, code long, distance int, first_id long")
    rank = Window.partitionBy("q").orderBy("distance", "first_id")
    best = found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= most)
    ids = best.join(index, "code").select("q", "distance", F.explode("ids").alias("neighbour_id"))
    near = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(ids, "q").where("neighbour_id <> query_id")
    near = near.groupBy("query_id", "neighbour_id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")

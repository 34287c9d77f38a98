"""Retrieval: lexical passes, BM25, vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators.rows import first_per_key

#: Scores of queries by vectors that a task holds at once.
CELLS = 2_000_000


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, length): an inverted index over (doc_id, tokens)."""
    size = F.size("tokens").alias("length")
    return docs.select("doc_id", size, F.explode("tokens").alias("term")).groupBy("term", "doc_id", "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score): the k best rows of (doc_id, tokens) for each of (query_id, term), four digits."""
    totals = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avg_length"))
    # only terms that are asked for leave the scan
    hit = docs.select("doc_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(queries.select("term").distinct(), "term", "left_semi")
    tf = hit.groupBy("term", "doc_id", "length").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(df, "term").join(F.broadcast(totals))  # one row
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    s = scored.withColumn("part", part).join(queries, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 4).alias("score"))
    return first_per_key(s, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def lexical(df: DataFrame, query: str, column: str, id_col: str, limit: int = 10) -> DataFrame:
    """(id, score, pass): exact 1.0, prefix .9, contained .7, any term .6; the first pass that meets a row fixes its score."""
    q, low = query.lower(), F.lower(column)
    any_term = F.lit(False)
    for term in q.split():
        any_term = any_term | low.contains(term)
    passes: list[tuple[float, Column]] = [(1.0, low == q), (0.9, low.startswith(q)), (0.7, low.contains(q)), (0.6, any_term)]
    number = F.coalesce(*[F.when(c, n) for n, (_, c) in enumerate(passes, 1)])
    score = F.coalesce(*[F.when(c, s) for s, c in passes])
    return df.select(F.col(id_col).alias("id"), score.alias("score"), number.alias("pass")).where("score is not null").orderBy(F.desc("score"), "pass", "id").limit(limit)


#: Vectors of one block, which one task holds while all queries stream past.
BLOCK = 50_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, floor: float = 0.0, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, neighbour_id, score): cosine top-k of a stated query set against all rows, four digits; ties by id, no row is its own neighbour.

    Vectors are dealt into blocks of about `block` rows and stay in their task. The queries are sent to each block, which gives
    its k best rows for each of them, so that k rows for each query and block are shuffled and no pair of rows is.
    """
    blocks = -(-vectors.count() // block) or 1
    unit = lambda c: F.transform(F.col(c), lambda x: x.cast("double"))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), unit(vector).alias("v")).where("id is not null and v is not null")
    q = queries.select(F.col(id_col).cast("long").alias("id"), unit(vector).alias("v")).where("id is not null and v is not null")
    sent = v.select(F.expr(f"pmod(xxhash64(id), {blocks})").alias("block"), F.lit(0).alias("asks"), "id", "v").unionByName(q.select(F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), F.lit(1).alias("asks"), "id", "v"))
    found = sent.repartition(blocks, "block").sortWithinPartitions("block", "asks").mapInArrow(_best_of_blocks(k, floor), "query_id long, neighbour_id long, score double")
    return first_per_key(found, ["query_id"], [F.desc("score"), F.asc("neighbour_id")], k)


def _best_of_blocks(k: int, floor: float):
    """Rows (block, asks, id, v) arrive by block, vectors before queries."""
    schema = pa.schema([("query_id", pa.int64()), ("neighbour_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for b in batches:
            place, asks, ids = (np.asarray(b.column(c)) for c in range(3))
            cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (asks[1:] != asks[:-1])]) if b.num_rows else []
            for i, j in zip(cut, [*cut[1:], b.num_rows], strict=True):
                if place[i] != at:
                    at, parts, block = place[i], [], None
                x = b.column(3).slice(i, j - i)
                x = np.asarray(x.flatten(), float).reshape(j - i, -1)
                if not asks[i]:
                    parts.append((ids[i:j], x))
                    continue
                if block is None:
                    block = tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else ()
                step = min(256, max(1, CELLS // len(block[0]))) if block else 1
                for start in range(0, (j - i) if block else 0, step):  # a matrix of some queries by one block
                    some = slice(start, start + step)
                    yield _best(ids[i:j][some], x[some], *block, k, floor, schema)

    return run


def _best(asked, q, ids, v, k, floor, schema) -> pa.RecordBatch:
    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))
    score = np.round(np.divide(q @ v.T, norm, out=np.zeros((len(q), len(v))), where=norm > 0), 4)
    score[(score < floor) | (asked[:, None] == ids)] = -np.inf
    least = -np.partition(-score, k - 1, 1)[:, k - 1 : k] if score.shape[1] > k else np.full((len(q), 1), -np.inf)
    row, col = np.nonzero((score >= least) & (score > -np.inf))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, col = row[kept], col[kept]
    return pa.RecordBatch.from_arrays([pa.array(asked[row], pa.int64()), pa.array(ids[col], pa.int64()), pa.array(score[row, col])], schema=schema)


def analogy(vectors: DataFrame, a: int, b: int, c: int, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(neighbour_id, score): nearest to b - a + c without the three."""
    pick = lambda n, i: F.max(F.when(F.col(id_col) == i, F.transform(F.col(vector), lambda x: x.cast("double")))).alias(n)
    three = vectors.where(F.col(id_col).isin(a, b, c)).agg(pick("a", a), pick("b", b), pick("c", c))
    goal = three.select(F.zip_with(F.zip_with("b", "a", lambda x, y: x - y), "c", lambda x, y: x + y).alias("goal"))
    s = vectors.where(~F.col(id_col).isin(a, b, c)).join(F.broadcast(goal))  # one row
    return s.select(F.col(id_col).alias("neighbour_id"), F.round(T.cosine(F.col(vector), F.col("goal")), 4).alias("score")).orderBy(F.desc("score"), "neighbour_id").limit(k)


#: Share of a score that a match of one query word keeps.
WORD_SHARE = 0.95


def hybrid(tables: dict[str, tuple[DataFrame, str, str, str]], query: str, k: int = 10, stop: list[str] = (), text: DataFrame | None = None, dense: DataFrame | None = None, pass_limit: int = 20) -> DataFrame:
    """(table_name, id, score, way): lexical ways, full text and vectors in one ranking.

    Each table is (rows, id, first column, second column). Ways in order, each for the whole query and then for its words at
    WORD_SHARE: first column equal 1.0, second equal 1.0, first starts with it .9, contains it .7; any word in either column .6. `text` is (table_name, id,
    score) by BM25: its best `pass_limit` rows score .75 + .2 * their share of the best. `dense` is (table_name, id, score) by cosine; it joins in for a query of
    two words or more, or where no other way reaches .9. Of several ways to one row the first in this order counts; then the
    best k by score, table and id.
    """
    q = query.lower()
    words = list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", q) if w not in stop))[:6]
    asked = [(q, 1.0), *((w, WORD_SHARE) for w in words if w != q)]
    hits = None
    for name, (df, id_col, first, second) in tables.items():
        low, other = F.lower(first), F.lower(second)
        ways = [("exact", low == t, d) for t, d in asked] + [("second", other == t, d) for t, d in asked] + [("prefix", low.startswith(t), 0.9 * d) for t, d in asked] + [("contains", low.contains(t), 0.7 * d) for t, d in asked]
        ways.append(("any", reduce(or_, [low.contains(w) | other.contains(w) for w in words], F.lit(False)), 0.6))
        way = F.coalesce(*[F.when(c, F.struct(F.lit(n).alias("rank"), F.lit(w).alias("way"), F.lit(round(s, 4)).alias("score"))) for n, (w, c, s) in enumerate(ways)])
        found = df.select(F.lit(name).alias("table_name"), F.col(id_col).cast("long").alias("id"), way.alias("x")).where("x is not null").select("table_name", "id", "x.*")
        hits = found if hits is None else hits.unionByName(found)
    if text is not None:
        near = text.orderBy(F.desc("score"), "table_name", "id").limit(pass_limit)
        best = near.agg(F.max("score").alias("most"))  # one row
        ranked = near.join(F.broadcast(best)).select("table_name", "id", F.lit(1000).alias("rank"), F.lit("text").alias("way"), F.round(0.75 + 0.2 * F.col("score") / F.col("most"), 4).alias("score"))
        hits = hits.unionByName(ranked)
    if dense is not None:
        rows = dense.select("table_name", "id", F.lit(1001).alias("rank"), F.lit("vector").alias("way"), "score")
        if len(words) < 2:
            reached = hits.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("reached"))  # one row
            rows = rows.join(F.broadcast(reached)).where("reached < 0.9").drop("reached")
        hits = hits.unionByName(rows)
    first = hits.groupBy("table_name", "id").agg(F.min(F.struct("rank", "way", "score")).alias("x"))
    return first.select("table_name", "id", F.col("x.score").alias("score"), F.col("x.way").alias("way")).orderBy(F.desc("score"), "table_name", "id").limit(k)


def tiered(queries: DataFrame, tiers: list[tuple[str, DataFrame, float]], enough: int = 1, per_word: int = 3) -> DataFrame:
    """(query_id, tier, word, item, evidence, confidence): evidence for queries (query_id, words) from tiers (name, rows (word, item, evidence), confidence), best first.

    A tier is asked only for queries that the earlier ones left with fewer than `enough` rows, and gives `per_word` rows a word, by
    item. Each tier keeps its `per_word` first rows of a word before it meets the queries, so that a frequent word makes no large join.
    """
    open_ = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    found = None
    for name, rows, confidence in tiers:
        top = first_per_key(rows.select("word", "item", "evidence"), ["word"], ["item", "evidence"], per_word)
        hit = open_.join(top, "word").select("query_id", F.lit(name).alias("tier"), "word", "item", "evidence", F.lit(confidence).alias("confidence"))
        found = hit if found is None else found.unionByName(hit)
        closed = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough)
        open_ = open_.join(closed.select("query_id"), "query_id", "left_anti")
    return found


def completion_chain(bigrams: DataFrame, start: str, most: int = 20) -> list[str]:
    """The greedy chain of likeliest next words from (word, next, n), up to `most` words or the first repeated one; one bounded lookup a step."""
    chain = [start]
    best = first_per_key(bigrams, ["word"], [F.desc("n"), F.asc("next")])
    while len(chain) < most:
        hit = best.where(F.col("word") == chain[-1]).select("next").head()
        if hit is None or hit[0] in chain:
            break
        chain.append(hit[0])
    return chain


def evidence_pack(ranked: DataFrame, group: str, order: list, item: Column, most: int = 5) -> DataFrame:
    """(group, n, items): the `most` first rows of each group as numbered structs, and how many there are in all."""
    n = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    top = first_per_key(ranked.withColumn("__item", item), [group], order, most)
    packed = top.groupBy(group).agg(F.array_sort(F.collect_list("__item")).alias("items"))
    return n.join(packed, group)


def context_blocks(pack: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, context): the items as numbered blocks."""
    return pack.select(group, F.array_join(F.transform("items", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x[text])), "\n").alias("context"))


def vector_rows(docs: DataFrame, stored: DataFrame, template: Column, chunk: Column, model: str, embed) -> DataFrame:
    """(vector_id, doc_id, at, chunk, embedding): chunks whose id (of model, row, place and content) is not stored yet, embedded by `embed`, a column function."""
    c = docs.withColumn("__text", template).select("doc_id", F.posexplode(chunk).alias("at", "chunk"))
    c = c.withColumn("vector_id", F.substring(F.sha2(F.concat_ws(":", F.lit(model), F.col("doc_id").cast("string"), F.col("at").cast("string"), "chunk"), 256), 1, 32))
    return c.join(stored.select("vector_id"), "vector_id", "left_anti").withColumn("embedding", embed(F.col("chunk")))


def node_upsert(nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """nodes (type, label, source, source_id, version) after an upsert: null keys equal empty ones, met nodes count one version up, others start at 1."""
    keys = ["type", "label", "source", "source_id"]
    even = lambda df: df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in keys], *[c for c in df.columns if c not in keys])
    old, new = even(nodes), even(incoming).select(*keys).distinct().withColumn("__met", F.lit(1))
    j = old.join(new, keys, "full")
    return j.select(*keys, (F.coalesce("version", F.lit(0)) + F.coalesce("__met", F.lit(0))).cast("int").alias("version"))


def triples(docs: DataFrame, verbs: list[str]) -> DataFrame:
    """(doc_id, subject, predicate, object): the words beside each verb in (doc_id, tokens)."""
    known = F.array(*map(F.lit, verbs))
    at = F.filter(F.sequence(F.lit(2), F.size("tokens") - 1), lambda i: F.array_contains(known, F.element_at("tokens", i)))
    e = docs.where(F.size("tokens") >= 3).select("doc_id", "tokens", F.explode(at).alias("i"))
    return e.select("doc_id", *[F.element_at("tokens", F.col("i") + d).alias(n) for d, n in ((-1, "subject"), (0, "predicate"), (1, "object"))]).distinct()


def key_terms(messages: DataFrame, stop: list[str], k: int = 20, id_col: str = "conv_id", text: str = "text") -> DataFrame:
    """(id, term, n): the k most frequent words of four letters a-z or more of each discussion, ties by word."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z]{4,}$"))
    n = messages.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).where(~F.col("term").isin(*stop)).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))
    return first_per_key(n, ["id"], [F.desc("n"), F.asc("term")], k)


def like_discussion(messages: DataFrame, asked: int, stop: list[str], k: int = 20, id_col: str = "conv_id", who: str = "role") -> DataFrame:
    """(id, topic_similarity, participant_overlap, shared): every other discussion against the asked one: Jaccard of key terms and of participants, and the common terms in order."""
    terms = key_terms(messages, stop, k, id_col)
    gather = lambda df, c: df.groupBy("id").agg(F.collect_set(c).alias(c))
    # a row a discussion: at most k terms and its participants
    people = gather(messages.select(F.col(id_col).alias("id"), who), who)
    every = people.join(gather(terms, "term"), "id", "left").withColumn("term", F.coalesce("term", F.array().cast("array<string>")))
    one = every.where(F.col("id") == asked).select(F.col("term").alias("t"), F.col(who).alias("p"))
    share = lambda a, b: F.coalesce(F.round(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), 4), F.lit(0.0))
    j = every.where(F.col("id") != asked).join(F.broadcast(one))  # one row
    return j.select("id", share("term", "t").alias("topic_similarity"), share(who, "p").alias("participant_overlap"), F.array_join(F.array_sort(F.array_intersect("term", "t")), " ").alias("shared"))


def cross_lingual(books: dict[str, DataFrame], query: str, source_lang: str, limit: int = 10) -> DataFrame:
    """(id, source_term, target_term, relevance) from the dictionary (id, headword, meaning) of the source language: headwords that hold the query, best relevance first, then id."""
    if source_lang not in books:
        raise ValueError(f"no dictionary for {source_lang}")
    hit = books[source_lang].where(F.lower("headword").contains(query.lower()))
    scored = hit.select("id", F.col("headword").alias("source_term"), F.col("meaning").alias("target_term"), T.relevance(query, F.col("headword")).alias("relevance"))
    return scored.orderBy(F.desc("relevance"), "id").limit(limit)


def topical(df: DataFrame, theme: str, id_col: str, columns: list[str], limit: int = 10) -> DataFrame:
    """(id, relevance): rows of which a text column holds a word of the theme, by the theme's relevance to the columns read as one text, then id. An empty theme takes every row."""
    low = [F.coalesce(F.lower(c), F.lit("")) for c in columns]
    hit = reduce(or_, [c.contains(w) for w in theme.lower().split() for c in low]) if theme.split() else F.lit(True)
    return df.where(hit).select(F.col(id_col).alias("id"), T.relevance(theme, F.concat_ws(" ", *columns)).alias("relevance")).orderBy(F.desc("relevance"), "id").limit(limit)

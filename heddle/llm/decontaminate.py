"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone.

A window is `width` consecutive words of an item (a shorter item is one window). As a token of the join serves a
shingle of three consecutive words (shorter windows have one token of their own length). A window occurs in a document
only if *all* of its tokens do, so the necessary prefix of a window, its tokens ordered by rarity in the documents, is
its rarest token. The plan:

1. one pass over the documents keeps (row, position) of every token that any window has, and the word count of each row;
2. tokens are counted there, and each window keeps its rarest one (ties: by text, then by offset);
3. the rarest tokens join the kept positions; a start before the text or an end beyond it is cut off (length and position);
4. all remaining tokens of a candidate are looked up at their positions: exact containment of the window.

Every join is on a token or on (row, position); a passage that a third of all documents share gives rows in proportion to
its occurrences. The tokens of the benchmark are broadcast only if at most `BROADCAST_TOKENS` are counted first.

Edge cases: a null or empty text has no words, is hit by nothing and is not contaminated. Items without words are ignored.
Repeated rows are judged each for itself. Empty tables give empty results (documents) or no hits (items). Other columns of
either table are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import keyed, without_ids, written

#: More tokens of the benchmark than these are joined by shuffle; so many take less than 64 MB.
BROADCAST_TOKENS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = 3


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z alone."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows_of(items: DataFrame, item_id: str, item_text: str, width: int) -> DataFrame:
    """Distinct (item_id, window, n_words): the windows of each item as text."""
    i = items.select(F.col(f"`{item_id}`").alias("item_id"), words_of(F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit(""))).alias("w"))
    i = i.where("size(w) > 0").withColumn("n", F.expr(f"least(size(w), {width})"))
    return i.select("item_id", "n", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), s -> array_join(slice(w, s, n), ' '))")).alias("window")).distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (start, stop in words of each occurring window), n_hit, item_ids (distinct, sorted as strings)."""
    by_item = written(windows_of(items, item_id, item_text, width), "windows")
    w = by_item.select("window", "n").distinct().withColumn("w", F.split("window", " "))
    tokens = w.select("window", "n", F.explode(F.expr(_largest_shingles("w", TOKEN, 2, 1))).alias("t")).select("window", "n", F.col("t.at").alias("offset"), F.col("t.token").alias("token"))
    tokens = written(tokens, "window-tokens")
    distinct = tokens.select("token").distinct()
    sizes = sorted(r[0] for r in tokens.select(F.least("n", F.lit(TOKEN)).alias("k")).distinct().collect())  # at most three numbers
    few = distinct.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS

    d = keyed(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), words_of(F.col("text")).alias("w"))
    shingles = [_shingles("w", k) for k in sizes]
    d = d.select("doc_id", "row", F.size("w").alias("n_words"), F.explode(F.expr("concat(" + ", ".join(["array(struct(-1 as at, cast(null as string) as token))", *shingles]) + ")")).alias("t"))
    d = d.select("doc_id", "row", "n_words", "t.at", "t.token")
    known = distinct.select(F.col("token").alias("known"))
    d = d.join(F.broadcast(known) if few else known, F.col("token") == F.col("known"), "left").where("at < 0 or known is not null").drop("known")
    found = written(d, "positions")
    rows, hits = found.where("at < 0").select("doc_id", "row", "n_words"), found.where("at >= 0")

    rarity = hits.groupBy("token").count()
    rarest = tokens.join(rarity, "token").groupBy("window", "n").agg(F.count(F.lit(1)).alias("there"), F.min(F.struct("count", "token", "offset")).alias("r"))
    rarest = rarest.where(F.col("there") == F.expr(f"greatest(n - {TOKEN} + 1, 1)")).select("window", "n", "r.token", "r.offset")
    candidates = hits.join(rarest, "token").select("row", "window", "n", (F.col("at") - F.col("offset")).alias("start"), "n_words").where("start >= 0 and start + n <= n_words")
    wanted = candidates.join(tokens.select("window", "offset", "token"), "window").select("row", "window", "n", "start", (F.col("start") + F.col("offset")).alias("at"), "token")
    met = wanted.join(hits.select("row", "at", "token"), ["row", "at", "token"]).groupBy("row", "window", "n", "start").count()
    met = written(met.where(F.col("count") == F.expr(f"greatest(n - {TOKEN} + 1, 1)")).select("row", "window", F.col("start"), (F.col("start") + F.col("n")).alias("stop")), "occurrences")

    spans = met.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    which = met.select("row", "window").distinct().join(by_item.select("window", "item_id"), "window").groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    out = rows.join(spans, "row", "left").join(which, "row", "left")
    covered = "aggregate(spans, struct(0 as n, 0 as upto), (a, s) -> struct(a.n + greatest(s.stop - greatest(s.start, a.upto), 0) as n, greatest(a.upto, s.stop) as upto), a -> a.n)"
    empty_spans = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("spans", empty_spans).alias("spans"), F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"))


def _largest_shingles(words: str, *sizes: int) -> str:
    """SQL: the shingles of the largest of `sizes` that the array has words for."""
    cases = " ".join(f"when size({words}) >= {k} then {_shingles(words, k)}" for k in sizes)
    return f"case {cases} else cast(array() as array<struct<at:int,token:string>>) end"


def _shingles(words: str, n: int) -> str:
    """SQL: all n-word shingles of an array of words as structs (at, token), positions from 0."""
    joined = " || ' ' || ".join(f"{words}[i + {k}]" if k else f"{words}[i]" for k in range(n))
    return f"if(size({words}) >= {n}, transform(sequence(0, size({words}) - {n}), i -> struct(i as at, {joined} as token)), cast(array() as array<struct<at:int,token:string>>))"


def is_contaminated(least_share: int = 20) -> Column:
    """At least one word in `least_share` is hit."""
    return F.expr(f"n_hit > 0 and {least_share} * n_hit >= n_words")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    bad = contamination(docs, items, id_col, text_col).where(is_contaminated()).select("doc_id").distinct()
    return without_ids(docs, id_col, bad)

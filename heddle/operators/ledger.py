"""Raw to staging to canonical, changesets with watermarks, provenance, audit rows, remaps, Bloom filters, promotion gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.rows import content_hash, missing_from


def staged(raw: DataFrame, staging: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Raw rows whose content hash is not in staging yet, once for each hash (the smallest key), with that hash as `hash`."""
    new = missing_from(raw.withColumn("hash", content_hash(*columns)), staging.select("hash"), ["hash"])
    first = new.groupBy("hash").agg(F.min(key).alias(key))
    return new.join(first, ["hash", key], "left_semi").dropDuplicates(["hash"])


def canonical(staging: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """(key, value, share, target): the value that most rows of a key agree on; `canonical` at the threshold, else `review`."""
    n = staging.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy(key).agg(F.sum("n").alias("all"), F.max(F.struct("n", F.col(value).alias("v"))).alias("top"))
    share = F.round(F.col("top.n") / F.col("all"), 4)
    return g.select(key, F.col("top.v").alias(value), share.alias("share"), F.when(share >= threshold, "canonical").otherwise("review").alias("target"))


def changeset(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str], stamp: str, watermark: Column) -> DataFrame:
    """(key, kind): inserted and updated rows among the incoming ones beyond the watermark; what has equal content is left out."""
    fresh = incoming.where(F.col(stamp) > watermark).select(key, content_hash(*columns).alias("new"))
    both = fresh.join(stored.select(key, content_hash(*columns).alias("old")), key, "left").where(~F.col("new").eqNullSafe(F.col("old")))
    return both.select(key, F.when(F.col("old").isNull(), "inserted").otherwise("updated").alias("kind"))


def applied(stored: DataFrame, incoming: DataFrame, changes: DataFrame, key: str, dry_run: bool = False) -> DataFrame:
    """The stored table with the changed rows taken from the incoming one; unchanged in a dry run."""
    if dry_run:
        return stored
    new = incoming.join(changes.select(key), key, "left_semi").select(*stored.columns)
    return missing_from(stored, new, [key]).unionByName(new)


def vector_work(rows: DataFrame, vectors: DataFrame, failed: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, reason): rows to embed, those that failed before first, then changed, then missing ones; `limit` bounds one batch."""
    have = vectors.select(key, F.col("hash").alias("old"))
    j = rows.join(have, key, "left").join(failed.select(key, F.lit(True).alias("bad")).distinct(), key, "left")
    reason = F.when(F.col("bad"), "failed").when(F.col("old").isNull(), "missing").when(F.col("old") != F.col("hash"), "changed")
    order = F.when(F.col("reason") == "failed", 0).when(F.col("reason") == "changed", 1).otherwise(2)
    return j.select(key, reason.alias("reason")).where("reason is not null").orderBy(order, key).limit(limit)


def provenance(before: DataFrame, now: DataFrame) -> DataFrame:
    """(name, state) of two manifests (name, n, hash): missing, new, rows, hash or same."""
    b, a = before.select("name", F.col("n").alias("n0"), F.col("hash").alias("h0")), now.select("name", F.col("n").alias("n1"), F.col("hash").alias("h1"))
    state = F.when(F.col("n1").isNull(), "missing").when(F.col("n0").isNull(), "new").when(F.col("n0") != F.col("n1"), "rows").when(F.col("h0") != F.col("h1"), "hash").otherwise("same")
    return b.join(a, "name", "full").select("name", state.alias("state"))


def audit(before: DataFrame, now: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column_name, old, new): one row for each changed cell, as text."""
    b = before.select(key, *[F.col(c).cast("string").alias(f"__{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__{c}").alias("old"), F.col(c).cast("string").alias("new")) for c in columns])
    return now.join(b, key).select(key, F.explode(F.filter(pairs, lambda p: ~p.old.eqNullSafe(p.new))).alias("p")).select(key, "p.*")


def remapped(df: DataFrame, column: str, archived: DataFrame) -> DataFrame:
    """df with references to archived rows (old, new) rewritten to their successors; others stay."""
    return df.join(archived.select(F.col("old").alias("__old"), F.col("new").alias("__new")), F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def reference_audit(df: DataFrame, key: str, structure: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, state): unknown (not in the structural table), silent (there without a text), or fine."""
    s, t = structure.select(key, F.lit(True).alias("there")).distinct(), texts.select(key, F.lit(True).alias("said")).distinct()
    j = df.select(key).join(s, key, "left").join(t, key, "left")
    return j.select(key, F.when(F.col("there").isNull(), "unknown").when(F.col("said").isNull(), "silent").otherwise("fine").alias("state"))


def _places(c: Column, size: int, hashes: int) -> Column:
    h1, h2 = F.xxhash64(c, F.lit(1)), F.xxhash64(c, F.lit(2))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.pmod(h1, F.lit(1 << 40)) + F.pmod(h2, F.lit(1 << 30)) * i.cast("long"), F.lit(size)))


def bloom(members: DataFrame, key: str, rate: float = 0.01, expected: int = 1 << 20) -> DataFrame:
    """(place): the set bits of a Bloom filter for `expected` members at the false-positive rate, with its size and hashes in every row."""
    size = math.ceil(-expected * math.log(rate) / math.log(2) ** 2)
    hashes = max(1, round(size / expected * math.log(2)))
    return members.select(F.explode(_places(F.col(key), size, hashes)).alias("place")).distinct().withColumns({"size": F.lit(size), "hashes": F.lit(hashes)})


def maybe_in(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Rows whose bits are all set: every member, and few others. The bits are joined by place, so a filter of any size does."""
    one = bits.limit(1).collect()
    if not one:
        return df.limit(0)
    size, hashes = one[0]["size"], one[0]["hashes"]
    keys = df.select(key).distinct()
    met = keys.select(key, F.explode(F.array_distinct(_places(F.col(key), size, hashes))).alias("place"))
    full = met.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hit = met.join(bits.select("place"), "place").groupBy(key).agg(F.count(F.lit(1)).alias("hit"))
    return df.join(full.join(hit, key).where("n = hit").select(key), key, "left_semi")


def promoted(hypotheses: DataFrame, evidence: DataFrame, known: DataFrame, least: int, confidence: float) -> DataFrame:
    """(hypothesis, outcome): promoted with enough evidence and mean confidence, duplicate if its expression is known, else waiting."""
    g = evidence.groupBy("hypothesis").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"))
    j = hypotheses.join(g, "hypothesis", "left").join(known.select("expression", F.lit(True).alias("known")).distinct(), "expression", "left")
    return j.select("hypothesis", F.when(F.col("known"), "duplicate").when((F.col("n") >= least) & (F.col("c") >= confidence), "promoted").otherwise("waiting").alias("outcome"))


def column_audit(df: DataFrame, columns: list[str], checks: dict[str, str]) -> DataFrame:
    """(column_name, cells, *checks): how many cells there are and how many each check (SQL over x) would mend, in one pass; nothing is written."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("x")) for c in columns])).alias("c")
    return df.select(cells).select("c.*").where("x is not null").groupBy("column_name").agg(F.count(F.lit(1)).alias("cells"), *[F.count_if(F.expr(sql)).alias(n) for n, sql in checks.items()])


def verdict(failed: Column) -> Column:
    """Three or more failed checks are critical, one or two a warning."""
    return F.when(failed >= 3, "critical").when(failed >= 1, "warning").otherwise("ok")


def reconciled(log: DataFrame, live: DataFrame) -> DataFrame:
    """(table_name, claimed, live, difference, outcome): what completed imports (table_name, rows_imported, status) claim against the rows that are there (table_name, rows): ok, mismatch, or no table."""
    claimed = log.where("status = 'completed' and table_name is not null").groupBy("table_name").agg(F.sum("rows_imported").alias("claimed"))
    j = claimed.join(live.select("table_name", F.col("rows").alias("live")), "table_name", "left")
    outcome = F.when(F.col("live").isNull(), "no table").when(F.col("live") == F.col("claimed"), "ok").otherwise("mismatch")
    return j.select("table_name", "claimed", "live", (F.col("live") - F.coalesce("claimed", F.lit(0))).alias("difference"), outcome.alias("outcome"))

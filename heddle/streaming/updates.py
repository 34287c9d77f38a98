"""Change-driven update: micro-batches of records change a table and what is derived from it, each batch exactly once.

A batch is compared with the live records of its own keys; new, changed and removed ones are appended to a log, and the words
that they gain and lose to a log of differences, so that a batch costs what it changes. Readers take the newest entry of each
key, and sums of differences. Both logs and the number of the batch appear in one manifest: a batch that Spark replays after
a failure finds its number in the ledger and does nothing. `compact` rewrites the logs as one entry a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators.rows import first_per_key
from heddle.sources.versions import Versions

#: Columns of a source that say nothing about its content.
UNHASHED = ("id", "import_batch_id", "source_file", "version", "imported_at", "created_at", "updated_at", "content_hash", "row_version")


class Regression(RuntimeError):
    """A batch would change the number of live records by more than is allowed."""


def content_hash(columns: list[str], key: str):
    """A digest of the columns by name, without the key and those that say nothing about content."""
    kept = sorted(c for c in columns if c != key and c not in UNHASHED and c != "deleted")
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept]), {"ignoreNullFields": "false"}), 256)


def changes(incoming: DataFrame, current: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """(key, status, old_hash, old_text, and the incoming columns) of rows with `content_hash` against current (key, content_hash, text).

    Status is new, changed, unchanged, removed (a row that says `deleted`, or, with `whole`, a current key that did not come) or ignored (deleted, but never there).
    """
    now = current.select(F.col(key).alias("__key"), F.col("content_hash").alias("old_hash"), F.col("text").alias("old_text"))
    j = incoming.join(now, F.col(key) == F.col("__key"), "full" if whole else "left")
    gone = F.coalesce("deleted", F.lit(False)) | F.col(key).isNull()
    status = F.when(gone, F.when(F.col("__key").isNull(), "ignored").otherwise("removed")).when(F.col("__key").isNull(), "new").when(F.col("old_hash") != F.col("content_hash"), "changed").otherwise("unchanged")
    return j.withColumn("status", status).withColumn(key, F.coalesce(key, "__key")).drop("__key")


def records(store: Versions, key: str = "id") -> DataFrame | None:
    """The live records: each key's newest entry, unless it says that the key is gone."""
    log = store.read("records")
    if log is None:
        return None
    newest = log.groupBy(key).agg(F.max_by(F.struct("deleted", "content_hash", "text", "seq"), "seq").alias("r"))
    return newest.where("not r.deleted").select(key, "r.content_hash", "r.text", "r.seq")


def words(store: Versions) -> DataFrame | None:
    """(word, n, n_records) over the live records."""
    log = store.read("word_differences")
    return None if log is None else log.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_records").alias("n_records")).where("n <> 0")


def _word_differences(affected: DataFrame) -> DataFrame:
    def of(text: str, sign: int) -> DataFrame:
        # a row for each token and one for each distinct token: work grows with a text's length, not with its square
        one = lambda n, n_records: lambda w: F.struct(w.alias("word"), F.lit(n).cast("long").alias("n"), F.lit(n_records).cast("long").alias("n_records"))
        t = affected.where(F.col(text).isNotNull()).select(T.tokens(F.col(text)).alias("t"))
        return t.select(F.explode(F.concat(F.transform("t", one(sign, 0)), F.transform(F.array_distinct("t"), one(0, sign)))).alias("e")).select("e.*")

    both = of("new_text", 1).unionByName(of("old_text", -1))
    return both.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_records").alias("n_records")).where("n <> 0 or n_records <> 0")


def apply_batch(store: Versions, batch: DataFrame, batch_id: int, stream: str = "main", key: str = "id", order: str | None = None, most_change: float | None = None, tag: str | None = None) -> dict:
    """Applies one micro-batch (key, text, deleted) and returns its counts, or {"replayed": True}.

    Of several rows of one key in the batch the last by `order` (then by content) counts; rows without a key are counted as `unkeyed` and left out.
    With `most_change`, a batch that would change the number of live records by more than that share is refused. `tag` names the version.
    """
    base = store.manifest()
    ledger = dict(base.notes.get("ledger", {})) if base else {}
    if batch_id <= ledger.get(stream, -1):
        return {"replayed": True}
    work = store.new_work()
    b = batch.withColumn("content_hash", content_hash(batch.columns, key))
    if "deleted" not in batch.columns:
        b = b.withColumn("deleted", F.lit(False))
    first = [F.desc(order)] if order else []
    last = first_per_key(b.where(F.col(key).isNotNull()), [key], [*first, F.desc("content_hash")])
    last = last.select(key, "text", F.coalesce("deleted", F.lit(False)).alias("deleted"), "content_hash")
    log = store.read("records")
    if log is None:
        current = store.spark.createDataFrame([], f"{key} {dict(last.dtypes)[key]}, content_hash string, text string")
    else:
        own = log.join(batch.select(key).distinct(), key, "left_semi")  # the log's rows of the batch's keys alone are compared
        newest = own.groupBy(key).agg(F.max_by(F.struct("deleted", "content_hash", "text"), "seq").alias("r"))
        current = newest.where("not r.deleted").select(key, "r.content_hash", "r.text")
    compared = changes(last, current, key)
    moved = F.col("status") != "unchanged"  # unchanged rows are counted alone
    compared = compared.withColumns({c: F.when(moved, F.col(c)) for c in ("text", "old_text")})
    compared.write.parquet(f"{work}/compared")
    compared = store.spark.read.schema(compared.schema).parquet(f"{work}/compared")
    n = {r.status: r["count"] for r in compared.groupBy("status").count().collect()}
    counts = {s: n.get(s, 0) for s in ("new", "changed", "unchanged", "removed", "ignored")}
    counts["unkeyed"] = batch.where(F.col(key).isNull()).count()
    live = base.notes.get("live", 0) if base else 0
    after = live + counts["new"] - counts["removed"]
    if most_change is not None and live and abs(after - live) / live > most_change:
        store.drop_work(work)
        raise Regression(f"{live} live records would become {after}")
    affected = compared.where("status in ('new', 'changed', 'removed')")
    seq = F.lit((base.version if base else 0) + 1).cast("long").alias("seq")
    entries = affected.select(key, seq, (F.col("status") == "removed").alias("deleted"), "content_hash", F.when(F.col("status") != "removed", F.col("text")).alias("text"))
    differences = _word_differences(affected.select(F.when(F.col("status") != "removed", F.col("text")).alias("new_text"), "old_text")).withColumn("seq", seq)
    ledger[stream] = batch_id
    m = store.commit({}, {"ledger": ledger, "live": after, "counts": counts, "tag": tag}, base.version if base else None, append={"records": entries, "word_differences": differences})
    store.drop_work(work)
    return {**counts, "live": after, "version": m.version}


def compact(store: Versions, key: str = "id") -> None:
    """Rewrites both logs as their sums; the ledger stays."""
    base = store.manifest()
    if base is None:
        return
    live = records(store, key).select(key, "seq", F.lit(False).alias("deleted"), "content_hash", "text")
    seq = F.lit(base.version + 1).cast("long").alias("seq")
    store.commit({"records": live, "word_differences": words(store).select("word", "n", "n_records", seq)}, {**base.notes, "tag": None}, base.version)


def follow(stream: DataFrame, store: Versions, checkpoint: str, after: Callable[[int, dict], None] = lambda i, said: None, **how) -> None:
    """Applies every micro-batch of what is there now; `after` hears of each. The checkpoint makes it go on where it stopped."""

    def each(batch: DataFrame, batch_id: int) -> None:
        after(batch_id, apply_batch(store, batch, batch_id, **how))

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

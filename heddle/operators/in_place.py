"""Cleaning a stored table in place: in batches that can be stopped and resumed, with an audit row for each changed cell.

The table lies in a store with versions. A run starts from one version and fixes there, for the whole table, which rows may not be
rewritten: a row is refused if another row held its new unique key when the run began, or if an earlier row (by id) gets it.
So the result is the same in whatever batches and after whatever stops. Each batch, a share of the ids by hash, is one
commit: its cleaned rows, its audit rows and its number in the progress notes appear together. The last commit puts the cleaned
rows in the table's place, without writing them again. Cells are never emptied: such a rewrite is blocked and counted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.sources.versions import Versions

Cleaners = dict[str, Callable[[Column], Column]]


def _planned(rows: DataFrame, cleaners: Cleaners) -> DataFrame:
    """rows with __new_<column> (the old value where the new one is empty or null) and __blocked (columns whose rewrite is blocked)."""
    new = {c: f(F.col(c)) for c, f in cleaners.items()}
    empty = {c: F.col(c).isNotNull() & (F.trim(F.coalesce(v, F.lit(""))) == "") & (F.col(c) != "") for c, v in new.items()}
    out = rows.withColumns({f"__new_{c}": F.when(empty[c], F.col(c)).otherwise(v) for c, v in new.items()})
    return out.withColumn("__blocked", F.filter(F.array(*[F.when(e, F.lit(c)) for c, e in empty.items()]), lambda x: x.isNotNull()))


def refusals(rows: DataFrame, key: str, cleaners: Cleaners, unique: list[list[str]]) -> DataFrame:
    """(key, unique): rows that may not get their new key, by the place of the unique key in the list. Keys with nulls never collide."""
    p = _planned(rows, cleaners)
    out = None
    for k, columns in enumerate(unique):
        news = [f"__new_{c}" if c in cleaners else c for c in columns]
        digest = lambda cs: F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cs)])), 256)
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        held = p.where(whole).select(digest(columns).alias("__digest")).groupBy("__digest").agg(F.lit(True).alias("__held"))
        moved = p.where(whole & (digest(columns) != digest(news))).select(key, digest(news).alias("__digest"))
        first = moved.groupBy("__digest").agg(F.min(key).alias("__first"))
        bad = moved.join(first, "__digest").join(held, "__digest", "left").where(F.col("__held") | (F.col(key) != F.col("__first"))).select(key, F.lit(k).alias("unique"))
        out = bad if out is None else out.unionByName(bad)
    return out if out is not None else rows.select(key, F.lit(0).alias("unique")).where("false")


def clean(store: Versions, table: str, key: str, cleaners: Cleaners, unique: list[list[str]] = (), batches: int = 16, reason: str = "clean", stop_after: int | None = None) -> dict:
    """Cleans columns of a table, or goes on with the run that was stopped. With `stop_after`, ends after so many batches.

    Returns counts of the run so far: changed cells, blocked and refused ones, batches done and in all. `<table>_audit` keeps (key, field, old_value,
    new_value, reason) of all runs. Rows with a null key stay as they are. A commit by another writer to the table since the run began ends in Conflict.
    """
    rows_name, refused_name, audit_name, mine = f"{table}__cleaned", f"{table}__refused", f"{table}_audit", f"clean:{table}"
    base = store.manifest()
    run = base.notes.get(mine)
    if not run or run["finished"]:
        refused = refusals(store.read(table), key, cleaners, list(unique))
        run = {"base": base.version, "batches": batches, "done": [], "finished": False, "cells": 0, "blocked": 0, "refused": 0}
        base = store.commit({refused_name: refused, rows_name: store.read(table).where("false")}, {**base.notes, mine: run}, base.version)
    source = store.read(table, run["base"])
    begun = len(run["done"])
    for b in range(run["batches"]):
        if b in run["done"]:
            continue
        if stop_after is not None and len(run["done"]) - begun >= stop_after:
            return run
        part = _planned(source.where(F.pmod(F.xxhash64(key), F.lit(run["batches"])) == b), cleaners)
        bad = store.read(refused_name).groupBy(F.col(key).alias("__id")).agg(F.collect_set("unique").alias("__unique"))  # a set of few numbers
        part = part.join(bad, F.col(key) == F.col("__id"), "left")
        final, cells, refused_cells = {}, [], []
        for c in cleaners:
            mine_in = [k for k, columns in enumerate(unique) if c in columns]
            stops = reduce(or_, [F.array_contains("__unique", k) for k in mine_in], F.lit(False)) if mine_in else F.lit(False)
            stops = F.coalesce(stops, F.lit(False)) | F.col(key).isNull()
            changed = ~F.col(c).eqNullSafe(F.col(f"__new_{c}"))
            final[c] = F.when(changed & ~stops, F.col(f"__new_{c}")).otherwise(F.col(c))
            cells.append(F.when(changed & ~stops, F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("old_value"), F.col(f"__new_{c}").cast("string").alias("new_value"))))
            refused_cells.append((changed & stops).cast("int"))
        work = store.new_work()
        done = part.select(*[final.get(c, F.col(c)).alias(c) for c in source.columns], F.filter(F.array(*cells), lambda x: x.isNotNull()).alias("__cells"), F.size("__blocked").alias("__n_blocked"), sum(refused_cells, F.lit(0)).alias("__n_refused"))
        done.write.parquet(work)
        done = store.spark.read.schema(done.schema).parquet(work)
        n = done.agg(F.coalesce(F.sum(F.size("__cells")), F.lit(0)), F.coalesce(F.sum("__n_blocked"), F.lit(0)), F.coalesce(F.sum("__n_refused"), F.lit(0))).first()
        run = {**run, "done": [*run["done"], b], "cells": run["cells"] + n[0], "blocked": run["blocked"] + n[1], "refused": run["refused"] + n[2]}
        audit = done.select(key, F.explode("__cells").alias("x")).select(key, "x.*", F.lit(reason).alias("reason"), F.lit(run["base"]).cast("long").alias("run"))
        base = store.commit({}, {**base.notes, mine: run}, base.version, append={rows_name: done.select(*source.columns), audit_name: audit})
        store.drop_work(work)
    run = {**run, "finished": True}
    store.replace(table, rows_name, {**base.notes, mine: run}, base.version)
    return run

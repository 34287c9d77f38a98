"""Row operators over any table: choosing rows by key, comparing tables, merging, counting what is wrong.

Each takes and returns DataFrames. Where the first of several rows counts, the order is an argument.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions.text import is_blank


def first_per_key(df: DataFrame, keys: list, order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in the given order; `rank` names a column for their places from 1."""
    place = rank or "__r"
    first = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)
    return first if rank else first.drop(place)


def completeness(*columns: str) -> Column:
    """How many of the columns are filled."""
    return sum((F.when(is_blank(F.col(c)), 0).otherwise(1) for c in columns), F.lit(0))


def most_complete(df: DataFrame, keys: list[str], score_columns: list[str], then: list) -> DataFrame:
    """Per key the row with most filled columns, then by the given order."""
    return first_per_key(df, keys, [completeness(*score_columns).desc(), *then])


def collapse_identical(df: DataFrame, keys: list[str], data: list[str], id_col: str) -> DataFrame:
    """Key groups whose data columns are all equal keep their smallest id; other groups stay whole."""
    groups = df.groupBy(*keys).agg(F.min(F.struct(*data)).alias("__a"), F.max(F.struct(*data)).alias("__b"), F.min(id_col).alias("__least"))
    joined = df.join(groups, keys)
    return joined.where(~F.col("__a").eqNullSafe(F.col("__b")) | (F.col(id_col) == F.col("__least"))).drop("__a", "__b", "__least")


def missing_from(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left without a partner in right; nulls in right do not matter, unlike NOT IN."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def compare_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, only left, only right."""
    a, b = (df.select(key).distinct().withColumn(name, F.lit(1)) for df, name in ((left, "l"), (right, "r")))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as text; null and empty differ."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)


def changes(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): new, changed, unchanged or removed, by content hash."""
    a = stored.select(key, content_hash(*columns).alias("__old"))
    b = incoming.select(key, content_hash(*columns).alias("__new"))
    kind = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "removed").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Incoming rows replace stored ones with their keys; the version counts up, new rows start at 1. Incoming keys are unique."""
    old = stored.select(*keys, F.col(version).alias("__v"))
    new = incoming.join(old, keys, "left").withColumn(version, F.coalesce(F.col("__v") + 1, F.lit(1).cast(stored.schema[version].dataType))).drop("__v")
    return missing_from(stored, incoming, keys).unionByName(new.select(*stored.columns))


def soft_delete(df: DataFrame, ids: DataFrame, id_col: str, flag: str = "deleted") -> DataFrame:
    """Sets the flag of the rows whose ids are listed."""
    mark = ids.select(id_col).distinct().withColumn("__gone", F.lit(True))
    return df.drop(flag).join(mark, id_col, "left").withColumn(flag, F.coalesce("__gone", F.lit(False))).drop("__gone")


def restore_as_of(audit: DataFrame, id_col: str, value: str, ts: str, moment: Column) -> DataFrame:
    """Per id the value of the last audit row not after the moment; of rows at one time the largest value."""
    return audit.where(F.col(ts) <= moment).groupBy(id_col).agg(F.max_by(value, F.struct(ts, value)).alias(value))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, blank): nulls and blanks per column, in one pass."""
    one = df.agg(*[F.count_if(is_blank(F.col(c))).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("blank")) for c in columns])).alias("x")).select("x.*")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with several rows and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplication_ratio(df: DataFrame, key: Column) -> DataFrame:
    """One row: rows over distinct keys, four digits."""
    return df.agg(F.round(F.count(F.lit(1)) / F.count_distinct(key), 4).alias("ratio"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of several tables as one plan."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose filled key has no parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def page(df: DataFrame, filters: dict, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Equality filters, order by columns ('-name' descending), one page."""
    for name, value in filters.items():
        df = df.where(F.col(name) == F.lit(value))
    keys = [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]
    return df.orderBy(*keys).offset(offset).limit(limit)


def fallback_lookup(df: DataFrame, stages: list[Column], limit: int, order: list) -> DataFrame:
    """Rows of the first stage that matches anything, with its number; later stages count only if earlier are empty."""
    stage = F.coalesce(*[F.when(s, n) for n, s in enumerate(stages, 1)])
    hit = df.withColumn("stage", stage).where("stage is not null")
    least = hit.agg(F.min("stage").alias("__least"))
    return hit.join(F.broadcast(least), F.col("stage") == F.col("__least")).drop("__least").orderBy(*order).limit(limit)


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """(table_name, n, hash): row count and an order-free hash of all rows."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("hash")).select(F.lit(name).alias("table_name"), "n", "hash")


def compare_reports(before: DataFrame, now: DataFrame, key: str = "metric", value: str = "value", status: str = "status") -> DataFrame:
    """(metric, delta, transition): what changed between two reports; a red after a green is a regression."""
    a = before.select(key, F.col(value).alias("v0"), F.col(status).alias("s0"))
    b = now.select(key, F.col(value).alias("v1"), F.col(status).alias("s1"))
    kind = F.when(F.col("s0").isNull(), "new").when((F.col("s0") == "green") & (F.col("s1") == "red"), "regression").when(F.col("s0") != F.col("s1"), "changed").otherwise("same")
    return b.join(a, key, "left").select(key, F.round(F.col("v1") - F.col("v0"), 4).alias("delta"), kind.alias("transition"))

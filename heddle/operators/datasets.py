"""Training-set assembly: splits, leakage, pairs, merges, reject chains. Order comes from hashes, never from chance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import text as T


def hash_split(df: DataFrame, key: str, train: int = 90, val: int = 5) -> DataFrame:
    """Adds `split` by percent of the key's hash; stable when rows are added."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(bucket < train, "train").when(bucket < train + val, "val").otherwise("test"))


def group_split(df: DataFrame, key: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(key, split): whole groups in hash order fill train, then val, then test by row targets.

    The running total needs no sort in one task: groups are summed by the first two hex digits of the hash, and only those
    256 sums are accumulated; within a digit pair the order is by hash.
    """
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.md5(F.col(key).cast("string"))).withColumn("part", F.substring("h", 1, 2))
    parts = g.groupBy("part").agg(F.sum("n").alias("rows"))
    before = parts.withColumn("base", F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).withColumn("total", F.sum("rows").over(Window.partitionBy()))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("h", key)) - F.col("n")
    placed = g.withColumn("inside", inside).join(F.broadcast(before.select("part", "base", "total")), "part").withColumn("at", F.col("base") + F.col("inside"))  # 256 rows
    return placed.select(key, F.when(F.col("at") < train * F.col("total"), "train").when(F.col("at") < (train + val) * F.col("total"), "val").otherwise("test").alias("split"))


def leakage(df: DataFrame, text: str) -> DataFrame:
    """(split_a, split_b, shared): distinct texts that two splits share; each text is first reduced to its set of splits."""
    f = df.select(F.sha2(T.collapse(F.lower(text)), 256).alias("f"), "split").groupBy("f").agg(F.collect_set("split").alias("s")).where(F.size("s") > 1)
    pairs = f.select("f", F.explode("s").alias("split_a"), "s").select("f", "split_a", F.explode("s").alias("split_b")).where("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))


def instruction_pairs(turns: DataFrame, least: int = 5) -> DataFrame:
    """(conv_id, turn, instruction, output): a user's turn and the assistant's answer behind it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("output", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return t.where((F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.length("output") >= least)).select("conv_id", "turn", F.col("text").alias("instruction"), "output")


def chat_json(turns: list[tuple[str, Column]]) -> Column:
    """A chat record as JSON: {"messages": [{"role", "content"}, ...]}."""
    return F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns]).alias("messages")))


def unify(sources: list[DataFrame], order: str, text: str = "text", least: int = 10) -> DataFrame:
    """Rows of all sources with `least` characters or more; of equal texts the one of the first source stays."""
    parts = [df.withColumn("__p", F.lit(k)) for k, df in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).where(F.length(text) >= least)
    w = Window.partitionBy(F.sha2(text, 256)).orderBy("__p", order)
    return every.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__p", "__r")


def reject_chain(df: DataFrame, gates: list[tuple[str, Column]], order: str, text: str) -> DataFrame:
    """Adds `rejected`: the first gate that a row fails, `duplicate` for later equal texts among the rest, else `kept`."""
    first = F.coalesce(*[F.when(c, name) for name, c in gates])
    marked = df.withColumn("__g", first)
    w = Window.partitionBy(F.col("__g").isNull(), F.md5(text)).orderBy(order)
    return marked.withColumn("rejected", F.coalesce("__g", F.when(F.row_number().over(w) > 1, "duplicate"), F.lit("kept"))).drop("__g")


def translation_pairs(df: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """Two directed rows for each pair, unique in lower case, the first `most` pairs in hash order (the size of the set asked for)."""
    once = df.groupBy(F.lower(a).alias("x"), F.lower(b).alias("y")).agg(F.min(F.struct(a, b)).alias("p"))
    chosen = once.orderBy(F.md5(F.concat_ws("\u0001", "x", "y")), "x", "y").limit(most)
    return chosen.select(F.explode(F.array(F.struct(F.col(f"p.{a}").alias("source"), F.col(f"p.{b}").alias("target")), F.struct(F.col(f"p.{b}").alias("source"), F.col(f"p.{a}").alias("target")))).alias("x")).select("x.*")

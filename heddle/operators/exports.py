"""Training records and exports: prompts, question and answer, plain texts, vocabularies, aligned pairs, preferences, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompt(instruction: Column, context: Column, response: Column) -> Column:
    """One text of three fields; a blank context leaves its part out."""
    middle = F.when(F.trim(F.coalesce(context, F.lit(""))) == "", "").otherwise(F.concat(F.lit("### Input:\n"), context, F.lit("\n\n")))
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n"), middle, F.lit("### Response:\n"), response)


def question_answer(a: Column, b: Column, head: int = 100) -> Column:
    """(kind, question, answer): a translation pair where both sides are there, else the completion of the first `head` characters of one."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    one = F.when(blank(a), b).otherwise(a)
    q = F.struct(F.lit("translate").alias("kind"), a.alias("question"), b.alias("answer"))
    c = F.struct(F.lit("complete").alias("kind"), F.substring(one, 1, head).alias("question"), one.alias("answer"))
    return F.when(blank(a) & blank(b), None).when(~blank(a) & ~blank(b), q).otherwise(c)


def plain_texts(df: DataFrame, text: str, least: int = 10) -> DataFrame:
    """(text): trimmed texts above `least` characters."""
    return df.select(F.trim(text).alias("text")).where(F.length("text") > least)


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, at, n, share): the words in order with their place, for an index file; places are counted within first letters, then summed."""
    from pyspark.sql.window import Window

    n = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("head", F.substring("word", 1, 1))
    heads = n.groupBy("head").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    before = heads.select("head", F.coalesce(F.sum("c").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = heads.agg(F.sum("s").alias("total"))
    at = F.row_number().over(Window.partitionBy("head").orderBy("word")) - 1
    return n.withColumn("k", at).join(before, "head").join(F.broadcast(total)).select("word", (F.col("k") + F.col("before")).alias("at"), "n", F.round(F.col("n") / F.col("total"), 8).alias("share"))


def aligned(left: DataFrame, right: DataFrame, ref: str, text: str) -> DataFrame:
    """(ref, a, b) of two tables of texts by reference; of several texts for one reference the last in order stands."""
    last = lambda df, n: df.groupBy(ref).agg(F.max(F.col(text)).alias(n))
    return last(left, "a").join(last(right, "b"), ref)


def group_key(*columns: Column, text: Column) -> Column:
    """The first filled of the columns, else the text: what must stay in one split."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns], text)


def preferences(df: DataFrame, prompt_col: str, first: str, second: str, chosen: str) -> DataFrame:
    """(prompt, chosen, rejected) of rows whose choice is `a` or `b` and whose sides differ."""
    c = F.lower(F.trim(chosen))
    kept = df.where(c.isin("a", "b") & (F.col(first) != F.col(second)))
    return kept.select(F.col(prompt_col).alias("prompt"), F.when(c == "a", F.col(first)).otherwise(F.col(second)).alias("chosen"), F.when(c == "a", F.col(second)).otherwise(F.col(first)).alias("rejected"))


def feedback(signals: DataFrame, least: float) -> DataFrame:
    """(line): approved signals (id, status, confidence, text) with enough confidence as JSON."""
    return signals.where((F.col("status") == "approved") & (F.col("confidence") >= least)).select("id", F.to_json(F.struct("id", "text")).alias("line"))


def training_batches(df: DataFrame, order: str, size: int, share: float) -> DataFrame:
    """df with `split` by hash (train below `share`) and `batch`, numbered by hash within a split: batches of about `size` rows without a global sort."""
    split = F.when(F.expr(f"pmod(conv(substring(md5(cast({order} as string)), 1, 8), 16, 10), 1000)") < int(share * 1000), "train").otherwise("validation")
    s = df.withColumn("split", split)
    n = s.groupBy("split").agg(F.ceil(F.count(F.lit(1)) / size).alias("batches"))
    return s.join(F.broadcast(n), "split").withColumn("batch", F.expr(f"pmod(conv(substring(md5(cast({order} as string)), 9, 8), 16, 10), batches)").cast("long")).drop("batches")

"""Words by parts: longest-match syllables, compounds of known words, tags with confidences, subword pieces of a public vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.linguistic import Syllables
from heddle.operators.rows import first_per_key


def max_munch(words: DataFrame, rule: Syllables, word_col: str = "word") -> DataFrame:
    """words with `syllables` by longest match; meant for distinct words."""

    @F.arrow_udf("array<string>")
    def split(col: pa.Array) -> pa.Array:
        return pa.array([None if w is None else rule.split(w) for w in col.to_pylist()], pa.list_(pa.string()))

    return words.withColumn("syllables", split(F.col(word_col)))


def compounds(words: DataFrame, roots: DataFrame, least: int = 3, most_parts: int = 6) -> DataFrame:
    """(word, parts): words that are two or more roots in a row, the longest root taken first at each place; at most `most_parts`, each of `least` letters or more.

    A word is not its own part. Each round sends the beginnings of what is left of a word, a few rows a word, and joins the roots.
    """
    r = roots.select(F.col("word").alias("part")).where(F.length("part") >= least).distinct()
    left = words.select("word", F.col("word").alias("rest"), F.array().cast("array<string>").alias("parts")).where(F.length("word") >= 2 * least)
    done = None
    for _ in range(most_parts):
        begun = left.select("*", F.explode(F.sequence(F.lit(least), F.length("rest"))).alias("n")).where((F.col("n") < F.length("word")) & (F.length("rest") >= least))
        hit = begun.withColumn("part", F.expr("left(rest, n)")).join(r, "part")
        best = first_per_key(hit, ["word"], [F.desc("n")])
        left = best.select("word", F.expr("substring(rest, n + 1)").alias("rest"), F.concat("parts", F.array("part")).alias("parts"))
        whole = left.where("rest = ''").select("word", "parts")
        done = whole if done is None else done.unionByName(whole)
        left = left.where(F.length("rest") >= least)
    return done


def tags(tokens: Column, closed: dict[str, str], lexicon: dict[str, str], suffixes: dict[str, str], default: str = "NOUN") -> Column:
    """(tag, confidence) of each token as written: closed classes .95, lexicon .9, capitals after the first token PROPN .8, the longest suffix .6, else the default .3. The lists are small."""

    def one(x: Column, i: Column) -> Column:
        low = F.lower(x)
        pair = lambda t, c: F.struct(F.lit(t).alias("tag"), F.lit(c).alias("confidence"))
        out = F.when(low.isin(list(closed)), F.struct(F.create_map(*[F.lit(v) for p in closed.items() for v in p])[low].alias("tag"), F.lit(0.95).alias("confidence")))
        out = out.when(low.isin(list(lexicon)), F.struct(F.create_map(*[F.lit(v) for p in lexicon.items() for v in p])[low].alias("tag"), F.lit(0.9).alias("confidence")))
        out = out.when((i > 0) & F.substring(x, 1, 1).rlike("^\\p{Lu}"), pair("PROPN", 0.8))
        for s in sorted(suffixes, key=len, reverse=True):
            out = out.when(low.endswith(s), pair(suffixes[s], 0.6))
        return out.otherwise(pair(default, 0.3))

    return F.transform(tokens, one)


def subwords(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", batch: int = 200) -> DataFrame:
    """(id, ids, coverage): pieces of a sentencepiece vocabulary, and the share that is not unknown; without pieces coverage is 0. A null text counts as empty.

    The file is sent to each executor once; tokenizers are read, never trained.
    """
    spark = docs.sparkSession
    name = model_path.rsplit("/", 1)[-1]
    spark.sparkContext.addFile(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        from pyspark import SparkFiles

        sp = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(name))
        for b in batches:
            for k in range(0, b.num_rows, batch):
                own = b.slice(k, batch)
                ids = sp.encode([t or "" for t in own.column(1).to_pylist()], num_threads=1)
                known = [sum(i != sp.unk_id() for i in x) / len(x) if x else 0.0 for x in ids]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(known)], names=["id", "ids", "coverage"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, ids array<int>, coverage double")

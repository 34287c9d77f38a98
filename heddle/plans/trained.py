"""Queries of models that are trained on the tables; they have no SQL."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions.linguistic import Syllables
from heddle.operators import crf, lid
from heddle.plans.folders import checkpoints
from heddle.plans.registry import query
from heddle.tables import load

_HELD = "crc32(cast(cast({} as string) as binary)) % 5 = 0"


@query()
def trained_language_id(spark, sf):
    """Every document's language by a model that learnt from the labels of four fifths of them."""
    d = load(spark, sf, "documents").select("doc_id", "lang", F.expr(_HELD.format("doc_id")).alias("held_out"), "text")
    path = f"{checkpoints(spark)}/letters-{uuid.uuid4().hex}"
    f = lid.featured(d)
    f.write.parquet(path)  # read in every round
    f = spark.read.schema(f.schema).parquet(path)
    return lid.identified(f, lid.train(f.where("not held_out"), "lang"))


#: Sound patterns of the fixture languages, as the rule segmenter takes them.
_RULE = Syllables(frozenset(["", *"bcdfghjklmnpqrstvwxz", "th", "sh", "wh", "ch", "st", "bl", "tr", "cr", "pr", "fr", "gr"]), frozenset([*"aeiouyäöüéèàêç", "ea", "ou", "io", "ie", "ei", "au", "ai", "oi", "ue"]), frozenset(["", *"lmnrstdg", "nd", "ng", "st", "rst", "nt"]))


@query()
def trained_syllables(spark, sf):
    """Every distinct word's syllables by a random field that learnt the rule segmenter's cuts on four fifths of the words, beside the rule's."""

    @F.arrow_udf("array<string>")
    def ruled(words: pa.Array) -> pa.Array:
        return pa.array([_RULE.split(w) for w in words.to_pylist()], pa.list_(pa.string()))

    w = load(spark, sf, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).distinct().where("word rlike '^[a-zà-ɏ]+$'")
    path = f"{checkpoints(spark)}/syllables-{uuid.uuid4().hex}"
    w.select("word", ruled("word").alias("gold"), F.expr(_HELD.format("word")).alias("held_out")).repartition(2 * spark.sparkContext.defaultParallelism, "word").write.parquet(path)  # each round uses all cores
    w = spark.read.parquet(path)
    model = crf.train(w.where("not held_out").select("word", F.col("gold").alias("syllables")))
    return crf.segmented(w, model).select("word", "held_out", F.array_join("syllables", "-").alias("syllables"), F.array_join("gold", "-").alias("rule"))

"""A corpus pipeline of five stages; each works on all rows that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. `n_chars`
follows the text where a stage rewrites it. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.bpe import encoded
from heddle.llm.common import written
from heddle.llm.decontaminate import decontaminated
from heddle.llm.jaccard import one_of_each
from heddle.llm.line_dedup import line_dedup
from heddle.llm.toxicity import not_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; the model learns from the labelled ones among docs."""
    return not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; a document that loses all its text so goes as well."""
    done = line_dedup(docs, extended=True)
    kept = done.where((F.col("__n_deleted") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return kept.withColumn("n_chars", F.when(F.col("__n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of each text."""
    return encoded(docs).select("doc_id", "n_tokens", "ids")


STAGES = [("toxicity", toxicity), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_documents), ("benchmark decontamination", decontaminate), ("BPE encoding and decoding", tokens)]

#: A trained classifier has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

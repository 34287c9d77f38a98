"""One query for each corpus operator: it applies the operator to its whole table and returns the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.bpe import encoded
from heddle.llm.collocations import collocations
from heddle.llm.ctw import scores
from heddle.llm.decontaminate import contamination, is_contaminated
from heddle.llm.hamming import top_k
from heddle.llm.itq import near_duplicates
from heddle.llm.jaccard import jaccard_components
from heddle.llm.line_dedup import line_dedup
from heddle.llm.quality import quality_scores
from heddle.llm.secrets import secrets
from heddle.llm.suffixes import without_repeats
from heddle.llm.toxicity import THRESHOLD, toxicity_scores
from heddle.llm.whitening import whitened_components


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text's digest after line deduplication and the number of deleted lines."""
    done = line_dedup(table(spark, sf_dir, "documents"), extended=True)
    return done.select("doc_id", F.col("__n_deleted").cast("long").alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), digests=True)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


QUERIES = {"op4_line_dedup": op4_line_dedup, "op6_bpe": op6_bpe, "op7_secrets": op7_secrets, "op10_decontaminate": op10_decontaminate}


def _judged(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), THRESHOLD)


QUERIES |= {"op2_quality": op2_quality, "op9_toxicity": op9_toxicity}


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


QUERIES |= {"op1_ctw": op1_ctw}


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents"))
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return done.select("doc_id", n.alias("n_bytes"), (n - F.length("__kept")).alias("n_removed"), F.size("__spans").cast("long").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


QUERIES |= {"op8_suffix_array": op8_suffix_array}


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES |= {"op5_jaccard_join": op5_jaccard_join}


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES |= {"op3_hamming_top_k": op3_hamming_top_k}


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES |= {"op13_collocations": op13_collocations}


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


QUERIES |= {"op11_whitening": op11_whitening}


def op12_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES |= {"op12_itq_near_dedup": op12_itq_near_dedup}

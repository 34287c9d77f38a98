"""The fixture tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; filters and columns chosen later are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

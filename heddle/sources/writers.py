"""Writers: JSON lines, CSV, text, split folders, chat and instruction records, metrics text, artifact manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.rows import fingerprint


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, quotes doubled, missing values empty."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    text.write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def write_text(df: DataFrame, path: str, column: str = "text", spaces: bool = True) -> None:
    """One line for each text; without spaces on request."""
    c = F.regexp_replace(F.col(column), r"[\r\n]+", " ")
    df.select(c if spaces else F.replace(c, F.lit(" "), F.lit(""))).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split, JSON lines."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def verified_round_trip(df: DataFrame, path: str) -> bool:
    """Writes JSON lines, reads them with the same schema and compares the rows both ways."""
    write_jsonl(df, path)
    back = df.sparkSession.read.schema(df.schema).json(path)
    return df.exceptAll(back).isEmpty() and back.exceptAll(df).isEmpty()


def chat_record(first: list[Column], system: str, least: int = 5) -> Column:
    """Messages of system, user (the first 200 characters) and assistant from the first filled column; null if it is too short."""
    text = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in first])
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.when(F.length(text) >= least, F.array(turn("system", F.lit(system)), turn("user", F.substring(text, 1, 200)), turn("assistant", text)))


def instruction_record(df: DataFrame, instruction: str, text: str = "text", source: str = "source") -> DataFrame:
    """(instruction, input, output, source): input is the first 150 characters."""
    return df.select(F.lit(instruction).alias("instruction"), F.substring(text, 1, 150).alias("input"), F.col(text).alias("output"), F.col(source).alias("source"))


def line_protocol(metrics: DataFrame) -> DataFrame:
    """(line): measurement,tag=value field=value timestamp of (name, label, value, ts)."""
    return metrics.select(F.format_string("%s,label=%s value=%s %s", F.regexp_replace("name", " ", "\\\\ "), "label", F.col("value").cast("string"), F.unix_micros("ts").cast("string")).alias("line"))


def exposition(metrics: DataFrame) -> DataFrame:
    """(line): name{label="..."} value."""
    return metrics.select(F.concat(F.regexp_replace("name", "[^a-zA-Z0-9_]", "_"), F.lit('{label="'), "label", F.lit('"} '), F.col("value").cast("string")).alias("line"))


def artifact(tables: dict[str, DataFrame], path: str, version: str, spark: SparkSession) -> DataFrame:
    """Writes each table as JSON lines and returns the manifest (version, table_name, n, hash), written beside them."""
    parts = None
    for name, df in tables.items():
        write_jsonl(df, f"{path}/{name}")
        f = fingerprint(df, name)
        parts = f if parts is None else parts.unionByName(f)
    manifest = parts.select(F.lit(version).alias("version"), "table_name", "n", "hash")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")

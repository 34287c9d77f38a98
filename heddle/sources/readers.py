"""Readers: JSON lines, JSON, text, TSV, XML, HTML and log files as DataFrames. Paths go to Spark's own readers alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import text as T

#: The text record: one schema for all typed scans.
RECORD = "text string, source string, url string, lang string, quality double, meta map<string,string>"


def jsonl_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """One record a line; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def jsonl(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """One object a line with inferred columns over all files; a key that appears later adds a column."""
    r = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return (r.option("pathGlobFilter", pattern) if pattern else r).json(path)


def jsonl_with_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The schema's columns with `line` (as read), `file`, `line_number` (from 1) and `broken`: true where a line is no object of this schema.

    Rows of a block of a file are numbered as they are read; the blocks' sizes, a small table, place them within the file.
    """
    read = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"), F.input_file_block_start().alias("__block"), F.monotonically_increasing_id().alias("__at"))
    blocks = read.groupBy("file", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "__block", (before - F.col("__first")).alias("__shift"))
    lines = read.join(blocks, ["file", "__block"]).select("line", "file", (F.col("__at") + F.col("__shift") + 1).alias("line_number")).where(~T.is_blank(F.col("line")))
    parsed = lines.withColumn("__r", F.from_json("line", schema + ", __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"}))
    return parsed.select("line", "file", "line_number", (F.col("__r").isNull() | F.col("__r.__corrupt").isNotNull()).alias("broken"), "__r.*").drop("__corrupt")


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def whole_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file, text): each file as one row, all folders below the path."""
    t = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    return t.select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def any_texts(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(text, source) by suffix: .jsonl, .json (list or object), else plain text split into sentences."""
    if path.endswith(".jsonl"):
        df = spark.read.json(path)
    elif path.endswith(".json"):
        df = spark.read.option("multiLine", "true").json(path)
    else:
        df = whole_texts(spark, path, "*").select(F.explode(T.sentences(F.col("text"))).alias("text"))
    return df.select(F.col("text"), F.lit(source).alias("source")).where(~T.is_blank(F.col("text")))


def tsv_pairs(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(a, b): two columns behind tabs or two blanks, quotes stripped, a header left out, pairs already known left out."""
    parts = F.split(F.trim("value"), r"\t+|\s{2,}")
    strip = lambda c: F.regexp_replace(F.trim(c), "^\"|\"$", "")
    rows = spark.read.text(path).where(F.size(parts) >= 2).select(strip(parts[0]).alias("a"), strip(parts[1]).alias("b"))
    rows = rows.where(~F.lower("a").isin("word", "headword", "source") & (F.col("a") != "") & (F.col("b") != ""))
    rows = rows.withColumn("ka", F.lower("a")).withColumn("kb", F.lower("b"))
    if known is not None:
        rows = rows.join(known.select(F.lower("a").alias("ka"), F.lower("b").alias("kb")).distinct(), ["ka", "kb"], "left_anti")
    return rows.groupBy("ka", "kb").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")


def xml_rows(spark: SparkSession, path: str, row_tag: str, reference: Column, text: Column) -> DataFrame:
    """(ref, text) of XML elements; reference and text are expressions over the element's columns."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path).select(reference.alias("ref"), F.trim(text.cast("string")).alias("text")).where(~T.is_blank(F.col("text")))


def nested_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """(book, chapter, verse, text) from a JSON object book -> chapter -> verse -> text."""
    whole = spark.read.option("wholetext", "true").text(path)
    books = whole.select(F.explode(F.from_json("value", "map<string,map<string,map<string,string>>>")).alias("book", "chapters"))
    chapters = books.select("book", F.explode("chapters").alias("chapter", "verses"))
    return chapters.select("book", "chapter", F.explode("verses").alias("verse", "text"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ts, level, line): the first timestamp of each line and the first of critical, error, warning, else info."""
    low = F.lower("value")
    level = F.when(low.contains("critical"), "critical").when(low.contains("error"), "error").when(low.contains("warning"), "warning").otherwise("info")
    stamp = F.regexp_extract("value", r"([0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
    return spark.read.text(path).select(F.try_to_timestamp(F.nullif(F.replace(stamp, F.lit("T"), F.lit(" ")), F.lit(""))).alias("ts"), level.alias("level"), F.col("value").alias("line"))


@dataclass(frozen=True)
class Source:
    """One table of a corpus: how its rows become sentences."""

    name: str
    table: str
    text: str
    document: str
    where: str = "true"


def select_sources(known: list[Source], names: list[str] | None) -> list[Source]:
    """The named sources in the order of declaration; an unknown name is an error."""
    if names is None:
        return known
    if missing := set(names) - {s.name for s in known}:
        raise ValueError(f"unknown sources: {', '.join(sorted(missing))}")
    return [s for s in known if s.name in names]


def availability(spark: SparkSession, sf_dir: str, tables: list[str]) -> DataFrame:
    """(table_name, there, n): the rows of each wanted table (from the files' footers), 0 where there is none."""
    out = None
    for t in tables:
        try:
            df = spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), F.lit(True).alias("there"), "n")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            df = spark.createDataFrame([(t, False, 0)], "table_name string, there boolean, n long")
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], "table_name string, there boolean, n long")


def sentences_of(spark: SparkSession, sf_dir: str, sources: list[Source]) -> DataFrame:
    """(source_id, document_id, text) of all sources; blank texts are left out."""
    out = None
    for s in sources:
        df = spark.read.parquet(f"{sf_dir}/{s.table}.parquet").where(s.where)
        df = df.select(F.lit(s.name).alias("source_id"), F.expr(s.document).cast("string").alias("document_id"), F.expr(s.text).alias("text")).where(~T.is_blank(F.col("text")))
        out = df if out is None else out.unionByName(df)
    return out

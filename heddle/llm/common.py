"""What the corpus operators share: the shared folder, written tables, bounded Arrow batches, batch views."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark expression for the share of training rows is built from this: crc32 of the id written as text.
ID_CRC = "crc32(cast(cast({id} as string) as binary))"

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a fresh one on a local master (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="heddle-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that this driver has written so far; for a caller whose results are stored. Returns how many."""
    jvm = spark.sparkContext._jvm
    for path in _WRITTEN:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    n = len(_WRITTEN)
    _WRITTEN.clear()
    return n


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keeps an Arrow batch small even where texts are long; a session that asks for less keeps its own."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def keyed(df: DataFrame, id_col: str, text_col: str, also: list[str] = ()) -> DataFrame:
    """Two columns (id, text) under fixed names; the text is never null."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *[F.col(f"`{c}`") for c in also])


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch's texts in one array, and the n + 1 offsets; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts (column `text`) hold about `most` bytes; one text is never cut."""
    for b in batches:
        _, offsets = text_bytes(b.column(b.schema.get_field_index("text")))
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield b.slice(start, stop - start)
            start = stop


def arrow_rows(cols: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def training_sql(id_sql: str, modulus: int, held: int) -> str:
    return f"coalesce({ID_CRC.format(id=id_sql)} % {modulus} <> {held}, false)"


def training_rows(id_sql: str, modulus: int, held: int):
    """True for rows that a model may learn from: crc32(id as text) mod `modulus` is not `held`; a null id never teaches."""
    return F.expr(training_sql(id_sql, modulus, held))


def held_out(id_sql: str, modulus: int, held: int):
    return F.expr(f"coalesce({ID_CRC.format(id=id_sql)} % {modulus} = {held}, false)")


def small_side(df: DataFrame, payload: str, most_bytes: int = 32 << 20) -> DataFrame:
    """df (a written table) with a broadcast hint if `payload`, its widest column, and 64 bytes a row are proven to be under most_bytes; else df as it is, for a shuffled join."""
    size = df.agg(F.coalesce(F.sum(F.expr(f"octet_length(cast({payload} as string)) + 64L")), F.lit(0)).alias("b")).first().b
    return F.broadcast(df) if size <= most_bytes else df


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores put before it until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id is among `gone` (its one column; nulls are equal), with all their columns."""
    name = free_name(docs, "__gone")
    gone = small_side(written(gone.toDF(name), "gone-ids"), name)
    return docs.join(gone, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(f"`{name}`")), "left_anti")

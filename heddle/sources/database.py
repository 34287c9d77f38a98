"""Databases as sources and sinks through Python's database interface: format "database".

Writing: each task puts its rows into a staging table of its own, in one transaction, and reports its name; the commit on the driver
moves all reported stages into the target in a single transaction, so that a failed write leaves the target as it was. Stages that a
lost or repeated task left behind are never read, and go with the commit or the abort. Reading: ranges of a whole-number
key are read by as many tasks.

Options: `driver` (module, default sqlite3), `dsn` (its address; for a file, one that all executors reach), `table`, and for
writing `key` and `updated_at` (column names), `batch` (rows sent at once); for reading `key` and `parts`. With both key and updated_at the write is an upsert in
which the newer row stays, the new one of equals; a null time is the oldest; of several incoming rows of a key the newest counts. Otherwise
mode "overwrite" replaces all rows, "append" adds them. Arrays, maps and structs are stored as JSON text, booleans as 0 and 1, decimals, dates and
times as text.
"""

from __future__ import annotations

import datetime as dt
import decimal
import importlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

_WHOLE = (ByteType, ShortType, IntegerType, LongType, BooleanType)


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def _plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (decimal.Decimal, dt.date, dt.datetime)):
        return str(v)
    if isinstance(v, (list, dict, tuple)):
        return json.dumps(v.asDict(True) if hasattr(v, "asDict") else v, ensure_ascii=False, default=str)
    return bytes(v) if isinstance(v, bytearray) else v


class _Database:
    def __init__(self, options: dict):
        self.driver, self.dsn, self.table = options.get("driver", "sqlite3"), options["dsn"], options["table"]
        self.key, self.updated = options.get("key"), options.get("updated_at")
        self.batch = int(options.get("batch", "1000"))

    def open(self):
        module = importlib.import_module(self.driver)
        c = module.connect(self.dsn, timeout=3600, isolation_level=None) if self.driver == "sqlite3" else module.connect(self.dsn)
        return c, "?" if getattr(module, "paramstyle", "qmark") == "qmark" else "%s"

    def begin(self, cur) -> None:
        """Tables made in a transaction go with it; other drivers begin by themselves."""
        if self.driver == "sqlite3":
            cur.execute("BEGIN IMMEDIATE")

    def tables(self, c) -> list[str]:
        cur = c.cursor()
        cur.execute("SELECT name FROM sqlite_master WHERE type = 'table'" if self.driver == "sqlite3" else "SELECT table_name FROM information_schema.tables")
        return [r[0] for r in cur.fetchall()]

    @staticmethod
    def columns(schema: StructType) -> str:
        kind = lambda t: "BIGINT" if isinstance(t, _WHOLE) else "DOUBLE PRECISION" if isinstance(t, (DoubleType, FloatType)) else "TEXT"
        return ", ".join(f"{_name(f.name)} {kind(f.dataType)}" for f in schema)


@dataclass
class Stage(WriterCommitMessage):
    table: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, db: _Database, schema: StructType, overwrite: bool):
        self.db, self.schema, self.overwrite = db, schema, overwrite
        self.run = f"stage_{uuid.uuid4().hex}"
        c, _ = db.open()
        try:
            # a table that says that the write goes on; tasks that end after it is gone leave nothing
            c.cursor().execute(f"CREATE TABLE {_name(self.run)} (open BIGINT)")
            c.commit()
        finally:
            c.close()

    def write(self, iterator: Iterator) -> Stage:
        name = f"{self.run}_{uuid.uuid4().hex}"  # another one for each attempt
        c, mark = self.db.open()
        try:
            cur = c.cursor()
            self.db.begin(cur)
            cur.execute(f"CREATE TABLE {_name(name)} ({self.db.columns(self.schema)})")
            put, held, n = f"INSERT INTO {_name(name)} VALUES ({', '.join([mark] * len(self.schema))})", [], 0
            for row in iterator:
                held.append(tuple(map(_plain, row)))
                n += 1
                if len(held) >= self.db.batch:
                    cur.executemany(put, held)
                    held = []
            if held:
                cur.executemany(put, held)
            cur.execute(f"SELECT count(*) FROM {_name(self.run)}")  # fails after an abort
            c.commit()
        finally:
            c.close()
        return Stage(name, n)

    def commit(self, messages: list) -> None:
        c, _ = self.db.open()
        names = [f.name for f in self.schema]
        listed, target = ", ".join(map(_name, names)), _name(self.db.table)
        try:
            cur = c.cursor()
            self.db.begin(cur)
            if self.db.table not in self.db.tables(c):
                unique = f", UNIQUE ({_name(self.db.key)})" if self.db.key else ""
                cur.execute(f"CREATE TABLE {target} ({self.db.columns(self.schema)}{unique})")
            stages = [m.table for m in messages if m is not None]
            if self.db.key and self.db.updated:
                k, t = _name(self.db.key), _name(self.db.updated)
                for s in stages:
                    # newest of the stage, then only where it is not older than what is there
                    newest = f"SELECT {listed} FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {t} IS NULL, {t} DESC, {', '.join(_name(n) for n in names)}) AS place_ FROM {_name(s)}) AS x WHERE place_ = 1"
                    sets = ", ".join(f"{_name(n)} = excluded.{_name(n)}" for n in names if n != self.db.key)
                    cur.execute(f"INSERT INTO {target} ({listed}) SELECT * FROM ({newest}) AS y WHERE true ON CONFLICT ({k}) DO UPDATE SET {sets} WHERE {target}.{t} IS NULL OR excluded.{t} >= {target}.{t}")
            else:
                if self.overwrite:
                    cur.execute(f"DELETE FROM {target}")
                for s in stages:
                    cur.execute(f"INSERT INTO {target} ({listed}) SELECT {listed} FROM {_name(s)}")
            c.commit()
        except BaseException:
            c.rollback()
            raise
        finally:
            c.close()
        self._drop_stages()

    def abort(self, messages: list) -> None:
        self._drop_stages()

    def _drop_stages(self) -> None:
        """All stages of this write, those of lost attempts too."""
        c, _ = self.db.open()
        try:
            cur = c.cursor()
            self.db.begin(cur)
            for t in self.db.tables(c):
                if t.startswith(self.run):
                    cur.execute(f"DROP TABLE {_name(t)}")
            c.commit()
        finally:
            c.close()


@dataclass
class Range(InputPartition):
    low: int | None
    high: int | None


class _Reader(DataSourceReader):
    def __init__(self, db: _Database, schema: StructType, parts: int):
        self.db, self.schema, self.parts = db, schema, parts

    def partitions(self) -> list[Range]:
        if not self.db.key or self.parts < 2:
            return [Range(None, None)]
        c, _ = self.db.open()
        try:
            cur = c.cursor()
            cur.execute(f"SELECT min({_name(self.db.key)}), max({_name(self.db.key)}) FROM {_name(self.db.table)}")
            low, high = cur.fetchone()
        finally:
            c.close()
        if low is None:
            return [Range(None, None)]
        cuts = sorted({low + (high - low) * k // self.parts for k in range(1, self.parts)})
        return [Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: Range) -> Iterator[tuple]:
        c, _ = self.db.open()
        try:
            cur = c.cursor()
            k = _name(self.db.key) if self.db.key else "NULL"
            low, high = (None if x is None else int(x) for x in (partition.low, partition.high))
            parts = [f"{k} >= {low}" if low is not None else "", f"{k} < {high}" if high is not None else ""]
            where = " AND ".join(p for p in parts if p)
            if where and low is None:
                where = f"({where} OR {k} IS NULL)"
            cur.execute(f"SELECT {', '.join(_name(f.name) for f in self.schema)} FROM {_name(self.db.table)}" + (f" WHERE {where}" if where else ""))
            while rows := cur.fetchmany(self.db.batch):
                for row in rows:
                    yield tuple(bool(v) if isinstance(f.dataType, BooleanType) and v is not None else v for v, f in zip(row, self.schema, strict=True))
        finally:
            c.close()


class DatabaseSource(DataSource):
    """The data source; the reader needs a schema."""

    @classmethod
    def name(cls) -> str:
        return "database"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Database(self.options), schema, int(self.options.get("parts", "8")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(_Database(self.options), schema, overwrite)


def _options(**given) -> dict:
    return {k: str(v) for k, v in given.items() if v is not None}


def write(df: DataFrame, dsn: str, table: str, key: str | None = None, updated_at: str | None = None, mode: str = "overwrite", driver: str = "sqlite3") -> None:
    """Synchronises df into a table: an upsert where key and updated_at are given, else a reload or an append.

    For an upsert the rows of a key meet in one task, so that no two stages hold the same key.
    """
    df.sparkSession.dataSource.register(DatabaseSource)
    if key and updated_at:
        df, mode = df.repartition(key), "append"
    df.write.format("database").options(**_options(dsn=dsn, table=table, key=key, updated_at=updated_at, driver=driver)).mode(mode).save()


def read(spark: SparkSession, dsn: str, table: str, schema: StructType | str, key: str | None = None, parts: int = 8, driver: str = "sqlite3") -> DataFrame:
    spark.dataSource.register(DatabaseSource)
    return spark.read.format("database").schema(schema).options(**_options(dsn=dsn, table=table, key=key, parts=parts, driver=driver)).load()

"""The state of a crawl: what was fetched, what changed, what is due, which texts were saved; kept by Structured Streaming.

Fetches (url, at, status, text) are keyed by their normal address. A key's state holds its last fetch and when it is due again: after an
interval that doubles while its text stays and halves when it changes. A timer gives a `due` row when the watermark passes
that time. Texts are keyed by their digest, so that one saved under another address is known. State lies in RocksDB, is
checkpointed with the stream and survives a restart; `state_table` reads it as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds until a page is due: first, least, most.
FIRST, LEAST, MOST = 86_400, 3_600, 30 * 86_400
#: How late a fetch may be told.
LATE = "1 hour"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "address string, kind string, at timestamp, digest string, visits long, due timestamp"
_STATE = "url string, status int, digest string, size long, visits long, changes long, at_ms long, interval_s long, due_ms long"


def address(url: Column) -> Column:
    """An address without scheme, fragment, tracking parameters, default index and closing slash, its host in lower case."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(F.regexp_replace(u, "(?<=[?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*(&|$)", ""), "[?&]$", "")
    host = F.lower(F.regexp_extract(u, "^[^/?]*", 0))
    return F.regexp_replace(F.concat(host, F.substr(u, F.length(host) + 1)), "/+$", "")


def fetches(pages: DataFrame, url: str = "url", text: str = "text", at: str = "at", status: str | None = None) -> DataFrame:
    """(address, url, at, status, digest, size) of fetched pages; rows without an address or a time are left out."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return pages.select(address(F.col(url)).alias("address"), F.col(url).alias("url"), F.col(at).alias("at"), (F.col(status).cast("int") if status else F.lit(200)).alias("status"), F.sha2(t, 256).alias("digest"), F.octet_length(t).cast("long").alias("size")).where("address <> '' and at is not null")


class Address(StatefulProcessor):
    """One address: its last fetch, its visits and changes, and when it is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = pd.concat(rows)
        told = told.assign(at_ms=told["at"].astype("datetime64[ms]").astype("int64")).sort_values(["at_ms", "digest", "url"])
        state = self.seen.get() if self.seen.exists() else None
        out = []
        for r in told.itertuples():
            if state is None:
                state, kind = (r.url, r.status, r.digest, r.size, 1, 0, r.at_ms, FIRST, 0), "new"
            else:
                changed = state[2] != r.digest
                interval = max(LEAST, state[7] // 2) if changed else min(MOST, state[7] * 2)
                state, kind = (r.url, r.status, r.digest, r.size, state[4] + 1, state[5] + changed, max(r.at_ms, state[6]), interval, state[8]), "changed" if changed else "unchanged"
            due = state[6] + state[7] * 1000
            state = (*state[:8], due)
            out.append((key[0], kind, pd.Timestamp(r.at_ms, unit="ms"), r.digest, state[4], pd.Timestamp(due, unit="ms")))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(state[8])
        self.seen.update(tuple(int(x) if k not in (0, 2) else x for k, x in enumerate(state)))
        yield pd.DataFrame(out, columns=["address", "kind", "at", "digest", "visits", "due"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self.seen.get()
        due = pd.Timestamp(s[8], unit="ms")
        yield pd.DataFrame([(key[0], "due", due, s[2], s[4], due)], columns=["address", "kind", "at", "digest", "visits", "due"])

    def close(self) -> None:
        pass


class Saved(StatefulProcessor):
    """One text: the first address that brought it, by time and then address within a micro-batch, and how many did."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "address string, at_ms long, times long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = pd.concat(rows)
        told = told.assign(at_ms=told["at"].astype("datetime64[ms]").astype("int64")).sort_values(["at_ms", "address"])
        known = self.first.get() if self.first.exists() else None
        first = known or (told["address"].iloc[0], int(told["at_ms"].iloc[0]), 0)
        self.first.update((first[0], int(first[1]), int(first[2]) + len(told)))
        yield pd.DataFrame([(key[0], first[0], known is None, int(first[2]) + len(told))], columns=["digest", "address", "saved", "times"])

    def close(self) -> None:
        pass


def frontier(fetched: DataFrame) -> DataFrame:
    """What each fetch of a stream tells (new, changed, unchanged), and what falls due."""
    _state_store(fetched.sparkSession)
    return fetched.withWatermark("at", LATE).groupBy("address").transformWithStateInPandas(Address(), EVENTS, "Append", "EventTime")


def saved_texts(fetched: DataFrame) -> DataFrame:
    """(digest, address, saved, times): for each micro-batch whether a text is to be saved, and who brought it first."""
    _state_store(fetched.sparkSession)
    return fetched.groupBy("digest").transformWithStateInPandas(Saved(), "digest string, address string, saved boolean, times long", "Update", "None")


def _state_store(spark: SparkSession) -> None:
    # the operator needs this store; a session with another one keeps no state of it
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def state_table(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The state of a stream as rows (key, value)."""
    s = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    return s.select("key.*", "value.*")


def run(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs a stream over what is there now into Parquet files of a folder."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

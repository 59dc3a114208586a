"""Incremental ingest: landed feed files become change records once each, by URL.

What has been seen is state of the stream, a value for each URL in a key-value store beside its checkpoint; no batch reads the
table it adds to. Rows of an older table can be given as the first state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import feeds

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Feed files under ``path`` as a stream: source (file name), kind, xml."""
    rows = spark.readStream.format("text").option("wholetext", True).schema("value string").load(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[a-z]+)?\z", 1).alias("source"), F.lit(kind).alias("kind"), F.col("value").alias("xml"))


class FirstOfUrl(StatefulProcessor):
    """The first row of a URL, by arrival, if the URL has not been seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, first = self.seen.exists(), None
        for frame in rows:
            if not known:
                frame = frame if first is None else pd.concat([first, frame])
                first = frame.sort_values(["source_repo", "position"], kind="stable").head(1)
        if first is not None:
            self.seen.update((True,))
            yield first

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def fresh(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Of a stream of change records those whose ``source_url`` is new to it. The state survives restarts with the checkpoint."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = None if stored is None else stored.select("source_url").distinct().groupBy("source_url")
    return rows.groupBy("source_url").transformWithStateInPandas(FirstOfUrl(), outputStructType=rows.schema, outputMode="Append", timeMode="None", initialState=known)


def start(stream: DataFrame, providers: DataFrame, table: str, checkpoint: str, now: str, stored: DataFrame | None = None):
    """Append new changes to the Parquet table at ``table``. Files are committed by batch, so one that is run again adds nothing."""
    found = feeds.changes(feeds.entries(stream), providers, now)
    return fresh(found, stored).writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def broken(stream: DataFrame, table: str, checkpoint: str):
    """Append the feeds of a stream that give no entries, with the reason, to the table at ``table``."""
    return feeds.failures(stream).writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts of events (ts without zone, event_type, value) by window, for streams and tables alike."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("at", late) if events.isStreaming else rows
    return rows.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")

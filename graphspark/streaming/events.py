"""Streams of events as temporal edges and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
OPEN_EDGES = "src long, edge_type string, valid_from long, valid_to long"


def read_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of Parquet files of events, with ts as a timestamp."""
    reader = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their value by type and window; repeated event_ids count once, and events later than `late` are dropped."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def validity_edges(events: DataFrame) -> DataFrame:
    """Temporal edges as they close: each event of a user holds until that user's next.

    State is one open event a user. Events of a user that come late by more than one batch close at the time they bring.
    """
    rows = events.select("user_id", "event_type", F.unix_millis("ts").alias("ms"), "event_id")

    def close(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames)).sort_values(["ms", "event_id"])
        rows = list(zip(new["event_type"], new["ms"], strict=True))
        if state.exists:
            rows.insert(0, tuple(state.get))
        rows.sort(key=lambda r: r[1])
        state.update((str(rows[-1][0]), int(rows[-1][1])))
        yield pd.DataFrame({"src": [key[0]] * (len(rows) - 1), "edge_type": [r[0] for r in rows[:-1]], "valid_from": [r[1] for r in rows[:-1]], "valid_to": [r[1] for r in rows[1:]]})

    return rows.groupBy("user_id").applyInPandasWithState(close, OPEN_EDGES, "edge_type string, valid_from long", "append", GroupStateTimeout.NoTimeout)

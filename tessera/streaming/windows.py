"""Streaming extension: windowed counts and sessions over events, equal to their batch results on bounded input.

The batch inventory has no streaming operators; these run the interval analytics on unbounded input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of events as they arrive."""
    schema = T.StructType([T.StructField(f.name, T.TimestampNTZType() if f.name == "ts" else f.dataType) for f in EVENTS.fields])
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling (or sliding) window and type; partial sums are made before the shuffle."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


SPAN = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("n", T.LongType())])
OPEN = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("n", T.LongType())])


def open_spans(events: DataFrame, gap_seconds: float, late: str = "10 minutes") -> DataFrame:
    """Spans of activity per user, each emitted once it is closed by a gap or by the watermark; state is one open span."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            a, b, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], a, b, n)], columns=SPAN.names)
            return
        times = sorted(t for part in batches for t in part["sec"])
        span = list(state.get) if state.exists else None
        closed = []
        for t in times:
            if span and t - span[1] < gap_seconds:
                span = [min(span[0], t), max(span[1], t), span[2] + 1]
            else:
                if span:
                    closed.append((key[0], *span))
                span = [t, t, 1]
        if span:
            state.update(tuple(span))
            state.setTimeoutTimestamp(max(int((span[1] + gap_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        if closed:
            yield pd.DataFrame(closed, columns=SPAN.names)

    rows = events.withWatermark("ts", late).select("user_id", "ts", (F.unix_micros("ts") / 1e6).alias("sec"))
    return rows.groupBy("user_id").applyInPandasWithState(step, SPAN, OPEN, "append", GroupStateTimeout.EventTimeTimeout)

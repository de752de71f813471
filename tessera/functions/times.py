"""Event time in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp, with or without time zone, as a double."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp"), ts.cast("timestamp")) / F.lit(1e6)

"""Event time and watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How late records may be
STOCK_LATENESS = "20 seconds"
NEWS_LATENESS = "1 minute"


def with_bounded_lateness(stream: DataFrame, delay=STOCK_LATENESS, time="record") -> DataFrame:
    """Watermark on ``timestamp``.

    Record time makes a stream and a batch agree. ``time="ingest"`` stamps
    rows with the time they are processed instead, so that nothing is late.
    """
    if time == "ingest":
        stream = stream.withColumn("timestamp", F.current_timestamp())
    elif time == "record":
        stream = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    else:
        raise ValueError("time must be 'record' or 'ingest'")
    return stream.withWatermark("timestamp", delay)


def late_rows(query) -> int:
    """Rows that the last hundred finished batches of a query dropped as too late, which is all that Spark keeps. For
    counts over all batches see `quotelake.streaming.counters`."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0))
        for progress in query.recentProgress for op in progress["stateOperators"])

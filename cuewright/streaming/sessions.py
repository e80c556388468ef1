"""Silence sessions on a stream of intervals: session windows with a gap of each row's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(intervals: DataFrame, key: str, start: str, end: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(key, session_start, session_end, n) of intervals less than a gap apart, from a stream or a table.

    start and end are timestamps. A row keeps its session open until its end and the gap have passed, so rows
    exactly a gap apart are one session; on streams rows later than ``late`` behind the newest are dropped.
    """
    rows = intervals.withWatermark(start, late) if intervals.isStreaming else intervals
    wait = F.concat(F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("string"), F.lit(f" milliseconds {gap}"))
    window = F.session_window(start, wait)
    found = rows.groupBy(window.alias("w"), key).agg(F.max(end).alias("session_end"), F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("session_start"), "session_end", "n")

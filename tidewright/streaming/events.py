"""Streaming forms: the stateless projections unchanged, and event-time state with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import mask, normalize


def masked_stream(messages: DataFrame, text: str) -> DataFrame:
    """Normalized and masked text of every message; works on streams and tables alike."""
    return messages.withColumn("normalized_text", normalize(F.col(text))).withColumn("model_text", mask(F.col("normalized_text")))


def distinct_messages(messages: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Each key once; a repeat within the delay is dropped and the state before the watermark is let go."""
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, user: str, at: str, gap: str = "30 minutes", delay: str = "1 hour", value: str | None = None) -> DataFrame:
    """(user, session_start, session_end, events, value): runs of events without a pause of `gap`."""
    aggs = [F.count("*").alias("events")] + ([F.sum(value).alias("value")] if value else [])
    s = events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("s"), user).agg(*aggs)
    return s.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *[a for a in ("events", "value") if a in s.columns])


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("events"))
    return w.select(F.col("w.start").alias("start"), by, "events")

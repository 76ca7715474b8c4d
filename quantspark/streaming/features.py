"""Streams: incremental upserts of bars, event windows, live scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import split_valid
from ..sources.ingest import BarStore


def stream_bars(bars: DataFrame, store: BarStore, checkpoint: str) -> StreamingQuery:
    """Upsert a stream of bars; broken bars stay out, and a repeated micro-batch writes the same rows again."""

    def upsert(batch: DataFrame, _: int) -> None:
        good, _bad = split_valid(batch)
        store.upsert_bars(good)

    return bars.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean value per event type and tumbling window; batch or stream, late events up to ``late``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: events with less than ``gap`` between them."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    agg = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("ts").alias("last_ts"))
    return agg.select("user_id", F.col("w.start").alias("session_start"), "last_ts", "n", "total")

"""Streaming forms of the counters, an extension: tallies of judged events under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tallies(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events a window and type with value statistics; late rows beyond the delay are left out by the watermark."""
    marked = events.withWatermark("ts", delay) if events.isStreaming else events
    g = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"), "most")


def confusion_stream(judged: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Confusion counts a window of rows (ts, target, answer)."""
    marked = judged.withWatermark("ts", delay) if judged.isStreaming else judged
    t, a = F.col("target"), F.col("answer")
    g = marked.where(t.isNotNull()).groupBy(F.window("ts", width).alias("w"))
    out = g.agg(F.count("*").alias("n"), F.count_if(t & a).alias("tp"), F.count_if(~t & a).alias("fp"), F.count_if(t & ~a).alias("fn"), F.count_if(~t & ~a).alias("tn"), F.count_if(a.isNull()).alias("abstained"))
    return out.select(F.col("w.start").alias("start"), "n", "tp", "fp", "fn", "tn", "abstained")

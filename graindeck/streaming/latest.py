"""Structured Streaming extensions (the batch operators have no streaming counterpart to match): the latest observation per subject
kept up to date, and windowed counts with late data."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(obs: DataFrame, subject: str, at: str, row: str, keep: list[str]) -> DataFrame:
    """A streaming aggregate (output mode update or complete): the row of the latest time per subject, ties by row id ascending. State is
    one row per subject, whatever the number of observations."""
    order = F.struct(-F.unix_micros(F.col(at).cast("timestamp")), F.col(row))
    return obs.where(F.col(subject).isNotNull() & F.col(at).isNotNull()).groupBy(subject).agg(F.min_by(F.struct(at, row, *keep), order).alias("b")).select(subject, "b.*")


def windowed_counts(events: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and kind; events later than ``late`` behind the newest are dropped and the window is closed (append mode)."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    g = e.groupBy(F.window(at, window), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), kind, "n", F.round("total", 6).alias("total"))

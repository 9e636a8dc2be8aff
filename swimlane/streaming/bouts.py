"""Bouts as a stream: joined to finished trials, and counted as they come.

The operators are those of batch tables; what a stream adds is a watermark, after
which late bouts no longer count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.joins import contained


def attach_trials(bouts: DataFrame, trials: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Streaming bouts inside static trials."""
    return contained(bouts, trials, keys, start, stop, "start", "stop")


def counts(bouts: DataFrame, time: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Bouts by window of event time and by columns; a window closes when the watermark passes it."""
    w = F.window(time, window)
    n = bouts.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n")

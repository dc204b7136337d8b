"""Sliding rate windows over a stream of calls, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_rates(calls: DataFrame, key: str, at: str, amount: str, length: str = "60 seconds", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """(key, window_start, window_end, calls, amount) of each sliding window; works on streams and on plain frames.

    Calls that come later than ``late`` after the newest one are left out of a stream's windows; state older than that goes.
    """
    own = calls.withWatermark(at, late) if calls.isStreaming else calls
    sums = own.groupBy(F.col(key), F.window(at, length, slide).alias("w")).agg(F.count("*").alias("calls"), F.sum(amount).alias("amount"))
    return sums.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "calls", "amount")


def over_limit(rates: DataFrame, most_calls: int, most_amount: float) -> DataFrame:
    """The windows in which a key went beyond one of its limits."""
    return rates.where((F.col("calls") > most_calls) | (F.col("amount") > most_amount))

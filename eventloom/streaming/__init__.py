"""Prices as a stream: latest price per market, and prices at the twice-daily cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_prices(trades: DataFrame, key: Column, time: str, price: str, late: str = "1 hour", window: str = "12 hours", start: str = "5 hours") -> DataFrame:
    """(key, window_end, time, price): the last trade of each key in windows that end at the cutoffs, from a stream or a table.

    Trades later than ``late`` behind the newest seen are dropped by the stream, and a window's state goes once
    the watermark has passed it. Of trades at one instant the greatest price counts; null times and keys are passed over.
    """
    t = trades.where(F.col(time).isNotNull()).withColumn("key", key).where("key IS NOT NULL")
    if trades.isStreaming:
        t = t.withWatermark(time, late)
    grouped = t.groupBy("key", F.window(time, window, startTime=start))
    return grouped.agg(F.max(F.struct(F.col(time).alias("t"), F.col(price).alias("p"))).alias("x")).select("key", F.col("window.end").alias("window_end"), F.col("x.t").alias("time"), F.col("x.p").alias("price"))

"""A panel's cells from a stream of trades: sums by day and code that late records still reach until the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_cells(trades: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, code, h, l, vol, amt) of a stream or table of (ts, code, price, quantity)."""
    rows = trades.withWatermark("ts", late) if trades.isStreaming else trades
    out = rows.groupBy(F.window("ts", "1 day").alias("w"), "code").agg(
        F.max("price").alias("h"), F.min("price").alias("l"), F.sum("quantity").alias("vol"), F.sum(F.col("price") * F.col("quantity")).alias("amt")
    )
    return out.select(F.col("w.start").cast("date").alias("day"), "code", "h", "l", "vol", "amt")

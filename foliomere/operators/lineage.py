"""Symbols over time: chains of ticker changes and the segments in which each is valid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segments(changes: DataFrame) -> DataFrame:
    """root, symbol, valid_from, valid_to for every symbol of a chain; ``changes``: old, new, day.

    A chain neither branches nor loops, so roots walk forward, one link a round for all chains."""
    olds, news = changes.select(F.col("old").alias("symbol")), changes.select(F.col("new").alias("symbol"))
    front = olds.join(news, "symbol", "left_anti").distinct().select(F.col("symbol").alias("root"), "symbol", F.lit(None).cast("date").alias("valid_from"))
    out = front
    while not front.isEmpty():
        front = front.join(changes, F.col("symbol") == F.col("old")).select("root", F.col("new").alias("symbol"), F.col("day").alias("valid_from"))
        out = out.unionByName(front)
    ends = changes.select(F.col("old").alias("symbol"), F.col("day").alias("valid_to"))
    return out.join(ends, "symbol", "left").select("root", "symbol", "valid_from", "valid_to")


def valid_prices(prices: DataFrame, segs: DataFrame) -> DataFrame:
    """Prices of each chain by the symbol valid on the day: from inclusive, to exclusive."""
    rows = prices.join(F.broadcast(segs), "symbol")
    inside = (F.col("valid_from").isNull() | (F.col("trade_date") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("trade_date") < F.col("valid_to")))
    return rows.filter(inside)

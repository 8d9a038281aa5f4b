"""Time series of prices and values: resampling, rolling means, fills, returns, relative rotation.

Windows are partitioned by symbol, so a series is one task's work and the number of symbols
spreads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_mean(x: str, n: int, keys: list[str], order: str) -> Column:
    """Mean of n rows; null until the window is full of values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))


def forward_fill(x: str, limit: int, keys: list[str], order: str) -> Column:
    return F.last(x, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-limit, 0))


def pct_change(x: str, keys: list[str], order: str) -> Column:
    return F.try_divide(F.col(x), F.lag(x).over(Window.partitionBy(*keys).orderBy(order))) - 1


def rebase(x: str, keys: list[str], order: str) -> Column:
    """Percent off the first value; a first value of 0 counts as 1."""
    first = F.first(x).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    base = F.when((first == 0) | first.isNull(), F.lit(1.0)).otherwise(first)
    return (F.col(x) / base - 1) * 100


def bucket(day: Column, freq: str) -> Column:
    """Label of a bucket: W ends on Sunday, M is the month's first day."""
    if freq == "W":
        # Sunday is 1
        return F.date_add(day, F.pmod(F.lit(8) - F.dayofweek(day), F.lit(7)))
    return F.trunc(day, "month") if freq == "M" else day


def resample(prices: DataFrame, freq: str) -> DataFrame:
    """First, highest, lowest and last close and total volume by bucket; empty buckets stay, with volume 0."""
    rows = prices.withColumn("bucket", bucket(F.col("trade_date"), freq))
    agg = rows.groupBy("instrument_id", "bucket").agg(
        F.min_by("close_cents", "trade_date").alias("open"), F.max("close_cents").alias("high"),
        F.min("close_cents").alias("low"), F.max_by("close_cents", "trade_date").alias("close"), F.sum("volume").alias("volume"),
    )
    step = {"W": "interval 7 days", "M": "interval 1 month"}.get(freq, "interval 1 day")
    span = agg.groupBy("instrument_id").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    grid = span.select("instrument_id", F.explode(F.sequence("a", "b", F.expr(step))).alias("bucket"))
    return grid.join(agg, ["instrument_id", "bucket"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def correlation(returns: DataFrame) -> DataFrame:
    """Pearson correlation of each pair of symbols over their common days; 0 where undefined."""
    a, b = returns.alias("a"), returns.alias("b")
    pairs = a.join(b, F.col("a.trade_date") == F.col("b.trade_date")).select(
        F.col("a.instrument_id").alias("left_id"), F.col("b.instrument_id").alias("right_id"), F.col("a.r").alias("x"), F.col("b.r").alias("y")
    )
    spread = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    out = pairs.groupBy("left_id", "right_id").agg(F.when(spread, F.covar_pop("x", "y") / (F.stddev_pop("x") * F.stddev_pop("y"))).alias("c"))
    return out.select("left_id", "right_id", F.round(F.coalesce("c", F.lit(0.0)), 4).alias("correlation"))


def relative_rotation(prices: DataFrame, benchmark: int, window: int) -> DataFrame:
    """x: strength against the benchmark off its own rolling mean, 100 is neutral; y: its change over the window."""
    days = prices.filter(F.col("instrument_id") == benchmark).select("trade_date", F.col("close_cents").alias("bench"))
    ids = prices.select("instrument_id").distinct()
    # the grid has one row for each symbol on each day of the benchmark
    grid = ids.withColumn("_k", F.lit(1)).join(F.broadcast(days.withColumn("_k", F.lit(1))), "_k").drop("_k")
    rows = grid.join(prices.select("instrument_id", "trade_date", "close_cents"), ["instrument_id", "trade_date"], "left")
    rows = rows.withColumn("p", forward_fill("close_cents", 5, ["instrument_id"], "trade_date"))
    rows = rows.withColumn("rs", F.col("p") / F.col("bench"))
    rows = rows.withColumn("x", 100 * F.col("rs") / rolling_mean("rs", window, ["instrument_id"], "trade_date"))
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    rows = rows.withColumn("y", F.col("x") - F.lag("x", window).over(w))
    out = rows.filter("instrument_id != %d and x is not null and y is not null" % benchmark)
    return out.select("instrument_id", "trade_date", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))

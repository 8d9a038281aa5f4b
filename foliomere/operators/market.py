"""Market tables: merging of providers and printed statements, returns, currency conversion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import latest_at


def first_provider(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all frames; of rows with equal keys that of the earliest frame."""
    ranked = reduce(DataFrame.unionByName, (f.withColumn("_rank", F.lit(k)) for k, f in enumerate(frames)))
    values = [c for c in ranked.columns if c not in keys and c != "_rank"]
    best = F.min_by(F.struct(*values), F.col("_rank")).alias("v")
    return ranked.groupBy(*keys).agg(best).select(*keys, "v.*")


def merged_fields(frames: list[DataFrame], keys: list[str], fields: list[str]) -> DataFrame:
    """One row for each key of any frame; each field is that of the last frame in which it is set.

    One shuffle on the keys, however many frames there are."""
    ranked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.withColumn("_rank", F.lit(k)) for k, f in enumerate(frames)))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in fields]
    return ranked.groupBy(*keys).agg(*last)


def period_start(day: Column, code: Column) -> Column:
    """First day of the look-back named by ``code``; any other code means the year's first day."""
    days = F.when(code == "1d", 1).when(code == "1w", 7).when(code == "1m", 30).when(code == "3m", 90).when(code == "6m", 180).when(code == "1y", 365)
    return F.coalesce(F.date_sub(day, days), F.trunc(day, "year").cast("date"))


def period_return(prices: DataFrame, start: Column, end: Column) -> DataFrame:
    """instrument_id, change: relative change from the last price by ``start`` to the last by ``end``."""
    at = lambda day, name: latest_at(prices, ["instrument_id"], "trade_date", ["close_cents"], day).select("instrument_id", F.col("close_cents").alias(name))
    both = at(start, "first").join(at(end, "last"), "instrument_id").filter("first > 0")
    return both.select("instrument_id", (F.col("last") / F.col("first") - 1).alias("change"))


def combined(totals: DataFrame, rates: DataFrame, target: str, at: Column) -> DataFrame:
    """``totals`` with their value in ``target`` by a direct or else an inverse rate; null without a rate.

    ``rates``: base, quote, rate_date, rate_cents; only the last by ``at`` counts."""
    last = latest_at(rates, ["base", "quote"], "rate_date", ["rate_cents"], at)
    direct = last.filter(F.col("quote") == target).select(F.col("base").alias("currency"), F.col("rate_cents").alias("_direct"))
    inverse = last.filter(F.col("base") == target).select(F.col("quote").alias("currency"), F.col("rate_cents").alias("_inverse"))
    rows = totals.join(F.broadcast(direct), "currency", "left").join(F.broadcast(inverse), "currency", "left")  # a row for each currency pair
    value = F.col("value_cents")
    out = F.when(F.col("currency") == target, value.cast("double")).when(F.col("_direct").isNotNull(), value * F.col("_direct") / 100)
    out = out.otherwise(value * 100 / F.nullif("_inverse", F.lit(0)))
    return rows.withColumn("target", F.lit(target)).withColumn("combined_cents", F.round(out).cast("long")).drop("_direct", "_inverse")

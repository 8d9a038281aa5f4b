"""Canonical statements, anchors, holdings at a date and their value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import latest_at

#: What a checkpoint covers: the anchor of one scope says nothing of another.
SCOPE = ["account_id", "currency"]


def canonical(statements: DataFrame) -> DataFrame:
    """Of statements reissued for one account and period, the newest."""
    return statements.groupBy(*SCOPE, "period_start", "period_end").agg(F.max("statement_id").alias("statement_id"))


def anchors(statements: DataFrame, at: Column) -> DataFrame:
    """Latest complete checkpoint of each account and currency at a date."""
    rows = statements.filter(F.col("completeness") == "complete")
    return latest_at(rows, SCOPE, "period_end", ["statement_id"], at)


def latest_observed(statements: DataFrame, at: Column) -> DataFrame:
    """Latest checkpoint of any completeness."""
    return latest_at(statements, SCOPE, "period_end", ["statement_id", "completeness"], at)


def of_statement(positions: DataFrame, chosen: DataFrame) -> DataFrame:
    """``positions`` of the statements ``chosen`` (SCOPE, statement_id and others), few of each scope.

    Both sides lie by scope, so the statement is a condition and no key: as a key it would have all positions dealt anew."""
    rows = chosen.withColumnRenamed("statement_id", "_own")
    return positions.join(rows, SCOPE).filter((F.col("statement_id") >= F.col("_own")) & (F.col("statement_id") <= F.col("_own"))).drop("_own")


def holdings_at(statements: DataFrame, positions: DataFrame, moves: DataFrame, at: Column) -> DataFrame:
    """Quantity of each instrument: the anchor's, plus later movements up to the date.

    An instrument that a complete anchor omits is cleared. A movement without a known effect
    marks the holding incomplete. Holdings of nothing are left out."""
    anchor = anchors(statements, at).withColumnRenamed("period_end", "anchor_date")
    base = of_statement(positions, anchor.select(*SCOPE, "statement_id", "anchor_date")).select("account_id", "currency", "instrument_id", F.col("quantity").alias("q"), F.lit(0).alias("moved"), F.lit(0).alias("unknown"))
    later = moves.filter(F.col("trade_date") <= at).join(anchor.select(*SCOPE, "anchor_date"), SCOPE, "left")
    later = later.filter(F.col("anchor_date").isNull() | (F.col("trade_date") > F.col("anchor_date")))
    step = later.select("account_id", "currency", "instrument_id", F.coalesce("position_delta", F.lit(0.0)).alias("q"), F.lit(1).alias("moved"), F.col("position_delta").isNull().cast("int").alias("unknown"))
    total = base.unionByName(step).groupBy("account_id", "currency", "instrument_id").agg(F.sum("q").alias("quantity"), F.sum("moved").alias("movements"), F.max("unknown").alias("unknown"))
    rows = total.filter(F.abs("quantity") > 1e-9).join(anchor.select(*SCOPE, "anchor_date"), SCOPE, "left")
    state = F.when(F.col("unknown") > 0, "incomplete").when(F.col("anchor_date") == at, "reported").when(F.col("anchor_date").isNull(), "movements_only").otherwise("reconstructed")
    return rows.select("account_id", "currency", "instrument_id", "quantity", "movements", "anchor_date", state.alias("state"))


def quality_flags(holdings: DataFrame, statements: DataFrame, at: Column) -> DataFrame:
    """Holdings with a warning where a later checkpoint than the anchor is incomplete."""
    seen = latest_observed(statements, at).select(*SCOPE, F.col("period_end").alias("seen_date"), F.col("completeness").alias("seen"))
    rows = holdings.join(seen, SCOPE, "left")
    stale = (F.col("seen") != "complete") & (F.coalesce(F.col("seen_date") >= F.col("anchor_date"), F.lit(True)))
    return rows.select(*SCOPE, "instrument_id", "state", F.coalesce(stale, F.lit(False)).alias("incomplete_scope"), (F.col("movements") > 0).alias("cost_stale"))


def priced(holdings: DataFrame, prices: DataFrame, at: Column) -> DataFrame:
    """Value in hundredths by the last price at or before the date; null where there is none."""
    last = latest_at(prices, ["instrument_id"], "trade_date", ["close_cents"], at).withColumnRenamed("trade_date", "price_date")
    rows = holdings.join(last, "instrument_id", "left")
    status = F.when(F.col("close_cents").isNull(), "unpriced").when(F.datediff(at, F.col("price_date")) > 7, "market_price_stale").otherwise("market")
    return rows.withColumn("value_cents", F.round(F.col("quantity") * F.col("close_cents")).cast("long")).withColumn("price_status", status)


def native_totals(valued: DataFrame) -> DataFrame:
    """Totals by currency; a total with an unpriced part says how many."""
    return valued.groupBy("currency").agg(F.sum("value_cents").alias("value_cents"), F.count("*").alias("holdings"), F.count_if(F.col("value_cents").isNull()).alias("unpriced"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Change of quantity between two holdings, both ways; absent is 0, equal is left out."""
    keys = ["account_id", "currency", "instrument_id"]
    both = a.select(*keys, F.col("quantity").alias("before")).join(b.select(*keys, F.col("quantity").alias("after")), keys, "full_outer")
    both = both.fillna(0.0, ["before", "after"]).withColumn("change", F.col("after") - F.col("before"))
    return both.filter(F.abs("change") >= 1e-9)

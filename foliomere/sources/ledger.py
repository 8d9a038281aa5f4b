"""Ledger tables over the driver's star schema.

Every table is a projection of its source, so filters and columns reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomere.functions.movements import position_delta

#: Instruments are parts below this key; a line's instrument is its part key modulo it.
INSTRUMENTS = 50
#: Lines of the source for each task of a join or a group; a larger source makes more tasks, not larger ones.
#: A scope's positions on all their dates are some twenty times its lines and are summed where they lie.
TASK_LINES = 200_000


@dataclass
class Ledger:
    """Lazily defined tables of one folder."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tasks(self) -> int | None:
        """How many tasks joins and groups of movements are dealt to; None where Spark's own number is large enough.

        Left to itself Spark makes as many tasks as there are cores until 64 MB compressed, and such rows pack well, so a task's memory would grow with the source."""
        n = -(-self.raw("lineitem").count() // TASK_LINES)
        return n if n > self.spark.sparkContext.defaultParallelism else None

    def dealt(self, rows: DataFrame, *keys: str, times: int = 1) -> DataFrame:
        """``rows`` dealt by keys to ``tasks`` (``times`` as many where rows are so many more than lines); as they are where Spark's own number will do."""
        return rows.repartition(self.tasks * times, *keys) if self.tasks else rows

    def institutions(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("institution_id"), F.col("n_name").alias("institution"))

    def accounts(self) -> DataFrame:
        currency = F.when(F.col("c_custkey") % 2 == 0, "CAD").otherwise("USD")
        return self.raw("customer").select(
            F.col("c_custkey").alias("account_id"), F.col("c_name").alias("account_number"), F.col("c_nationkey").alias("institution_id"), currency.alias("currency")
        )

    def instruments(self) -> DataFrame:
        kind = F.element_at(F.array(*map(F.lit, ("equity", "etf", "bond", "mutual_fund"))), F.col("p_size") % 4 + 1)
        return self.raw("part").filter(F.col("p_partkey") < INSTRUMENTS).select(
            F.col("p_partkey").alias("instrument_id"),
            F.concat(F.lit("S"), F.col("p_partkey")).alias("symbol"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("sector"),
            kind.alias("asset_type"),
        )

    def transactions(self) -> DataFrame:
        flags = F.concat("l_returnflag", "l_linestatus")
        kind = (
            F.when(flags == "AF", "buy").when(flags == "AO", "sell").when(flags == "NF", "transfer_in")
            .when(flags == "NO", "dividend").when(flags == "RF", "journal").otherwise("stock_split")
        )
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        rows = self.dealt(self.raw("lineitem"), "l_orderkey").join(self.dealt(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        rows = rows.withColumn("txn_type", kind)
        amount = F.round("l_extendedprice", 2).cast("decimal(18,2)")
        sign = F.when(F.col("txn_type").isin("buy"), -1).when(F.col("txn_type").isin("sell", "dividend"), 1).otherwise(0)
        rows = rows.select(
            F.col("o_custkey").alias("account_id"),
            (F.col("l_partkey") % INSTRUMENTS).alias("instrument_id"),
            F.col("o_orderdate").cast("date").alias("trade_date"),
            F.col("l_shipdate").cast("date").alias("cash_effective_date"),
            "txn_type",
            F.col("l_quantity").alias("quantity"),
            (amount * sign).cast("decimal(18,2)").alias("net_amount"),
            F.concat_ws("-", F.lit("transaction:"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
            position_delta(F.col("txn_type"), F.col("l_quantity")).alias("position_delta"),
        )
        # every account holds instruments of both currencies
        currency = F.when((F.col("account_id") + F.col("instrument_id")) % 2 == 0, "CAD").otherwise("USD")
        return rows.withColumn("currency", currency)

    def effects(self) -> DataFrame:
        """What movements do to positions: account_id, currency, instrument_id, trade_date, position_delta.

        Dealt by scope once: sums, windows and joins of a scope need no further exchange, and all that read these share it."""
        rows = self.transactions().select("account_id", "currency", "instrument_id", "trade_date", "position_delta")
        return self.dealt(rows, "account_id", "currency") if self.tasks else rows.repartition("account_id", "currency")

    def statements(self) -> DataFrame:
        """One for each account, currency and month with a trade."""
        month = F.trunc("trade_date", "month")
        rows = self.dealt(self.transactions().select("account_id", "currency", month.alias("period_start")), "account_id", "currency").distinct()
        number = (F.col("account_id") * 1000 + (F.year("period_start") - 1990) * 12 + F.month("period_start")) * 2 + (F.col("currency") == "USD").cast("int")
        return rows.select(
            number.alias("statement_id"), "account_id", "currency", "period_start", F.last_day("period_start").alias("period_end"),
            F.when(number % 11 == 0, "unknown").otherwise("complete").alias("completeness"),
        )

    def positions(self) -> DataFrame:
        """Printed position of each instrument at each statement's end; every seventh statement is off by one.

        A running sum holds from its month to the next one with movements, so a statement meets each instrument once."""
        keys = ["account_id", "currency", "instrument_id"]
        moves = self.effects().groupBy(*keys, F.trunc("trade_date", "month").alias("m")).agg(F.sum(F.coalesce("position_delta", F.lit(0.0))).alias("d"))
        w = Window.partitionBy(*keys).orderBy("m")
        runs = moves.select(*keys, "m", F.sum("d").over(w).alias("q"), F.lead("m").over(w).alias("until"))
        rows = self.statements().join(runs, ["account_id", "currency"])
        rows = rows.filter((F.col("m") <= F.col("period_start")) & (F.col("until").isNull() | (F.col("period_start") < F.col("until"))))
        quantity = F.col("q") + F.when(F.col("statement_id") % 7 == 0, 1.0).otherwise(0.0)
        return rows.select("statement_id", "account_id", "currency", "period_start", "period_end", "completeness", "instrument_id", quantity.alias("quantity"))

    def prices(self) -> DataFrame:
        amount = F.sum(F.round("l_extendedprice", 2).cast("decimal(18,2)"))
        rows = self.raw("lineitem").groupBy((F.col("l_partkey") % INSTRUMENTS).alias("instrument_id"), F.col("l_shipdate").cast("date").alias("trade_date"))
        return rows.agg((amount.cast("double") / F.sum("l_quantity")).alias("raw"), F.sum("l_quantity").alias("volume")).select(
            "instrument_id", "trade_date", F.floor(F.col("raw") * 100).cast("long").alias("close_cents"), "volume"
        )

    def fx(self) -> DataFrame:
        """USD in CAD, in hundredths, on each day with an order."""
        day = self.raw("orders").select(F.col("o_orderdate").cast("date").alias("rate_date")).distinct()
        return day.select("rate_date", (F.lit(120) + F.dayofyear("rate_date") % 10).cast("long").alias("rate_cents"))

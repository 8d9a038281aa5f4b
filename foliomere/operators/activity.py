"""Dated activity lines of statements, parsed by expressions alone.

A line is a month and a day, a verb, a symbol, then a quantity and an amount. Lines that do not
parse are rows of ``rejected``, so nothing is lost silently."""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomere.functions.text import groups, once, parse_money

#: Printed verbs and the movement each stands for; of several that fit the longest decides.
VERBS = {"BOUGHT": "buy", "SOLD": "sell", "SOLD SHORT": "short_sell", "DIVIDEND": "dividend", "TRANSFER IN": "transfer_in", "TRANSFER OUT": "transfer_out"}
_MONEY = r"(\(?-?\$?[0-9][0-9,]*(?:\.[0-9]+)?\)?-?)"
_LINE = rf"^\s*([A-Z][a-z]{{2}})\s?([0-9]{{1,2}})\s+([A-Z][A-Z ]*?)\s+([A-Z0-9.-]+)\s+{_MONEY}\s+{_MONEY}\s*$"


def movement(verb: Column) -> Column:
    """The type of the longest verb that begins ``verb``; null if none does."""
    out = F.lit(None).cast("string")
    for text in sorted(VERBS, key=len):
        out = F.when(F.startswith(F.upper(verb), F.lit(text)), VERBS[text]).otherwise(out)
    return out


def with_year(month: Column, day: Column, period_end: Column) -> Column:
    """A date without a year lies in the period's last year, or the one before if its month is later."""
    # reckoned, as a date form costs a failed parse for each line without a date
    names = F.array(*(F.lit(calendar.month_abbr[k]) for k in range(1, 13)))

    def dated(number: Column) -> Column:
        year = F.year(period_end) - (number > F.month(period_end)).cast("int")
        first = F.when(number > 0, F.make_date(year, number, F.lit(1)))
        return once(F.date_add(first, F.when(F.regexp_like(day, F.lit(r"^0*\d{1,2}$")), day.try_cast("int") - 1)), lambda d: F.when(F.month(d) == number, d))

    return once(F.array_position(names, F.initcap(month)).cast("int"), dated)


def parsed(lines: DataFrame, text: str = "line", period_end: str = "period_end") -> DataFrame:
    """``lines`` with trade_date, txn_type, symbol, quantity, amount; null in lines of another form."""
    part = lambda k: F.get("_parts", F.lit(k - 1))
    return lines.withColumn("_parts", groups(F.col(text), _LINE, 6)).select(
        *lines.columns,
        with_year(part(1), part(2), F.col(period_end)).alias("trade_date"),
        movement(part(3)).alias("txn_type"),
        part(4).alias("symbol"),
        parse_money(part(5)).alias("quantity"),
        parse_money(part(6)).alias("amount"),
    )


def rejected(rows: DataFrame) -> DataFrame:
    """Rows of ``parsed`` that have no date or no known verb."""
    return rows.filter(F.col("trade_date").isNull() | F.col("txn_type").isNull())

"""What a transaction does to a position and to cash, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transaction types by their effect on a position, and those that move no cash.
ADDS = ("buy", "buy_to_cover", "transfer_in", "reinvest_dividend", "stock_split_credit", "option_buy_to_open", "option_buy_to_close")
TAKES = ("sell", "short_sell", "transfer_out", "stock_split_debit", "option_sell_to_open", "option_sell_to_close")
REVERSES = ("option_assignment", "option_exercise", "option_expiration")
UNDERIVABLE = ("stock_split", "name_change", "spinoff", "merger")
NON_CASH = ("reinvest_dividend", "stock_split", "stock_split_credit", "stock_split_debit", "name_change", "spinoff", "merger")
#: Types whose direction follows from the position that they close.
CLOSES = REVERSES


def quantity_delta(kind: Column, q: Column) -> Column:
    """Signed quantity of a movement; a null quantity counts as 0."""
    q = F.coalesce(q, F.lit(0.0))
    return (
        F.when(kind.isin(*ADDS), F.abs(q))
        .when(kind.isin(*TAKES), -F.abs(q))
        .when(kind.isin(*REVERSES), -q)
        .when(kind == "journal", q)
        .otherwise(F.lit(0.0))
    )


def position_delta(kind: Column, q: Column) -> Column:
    """As quantity_delta, but null where the document alone does not tell the effect."""
    return F.when(q.isNotNull() & ~kind.isin(*UNDERIVABLE), quantity_delta(kind, q))


def affects_position(kind: Column) -> Column:
    return kind.isin(*ADDS, *TAKES, *REVERSES, *UNDERIVABLE, "journal")


def position_effect(kind: Column, stored: Column, q: Column) -> Column:
    """The stored effect, unless it is a zero that could not have been derived; else the derived one."""
    hollow = kind.isin(*UNDERIVABLE) & (F.abs(stored) < 1e-9)
    derived = F.coalesce(position_delta(kind, q), F.when(~affects_position(kind), F.lit(0.0)))
    return F.when(stored.isNotNull() & ~hollow, stored).when(hollow, F.lit(None)).otherwise(derived)


def closing_delta(kind: str, q: float | None, held: float, fallback: float | None) -> float | None:
    """Effect of a movement on the position ``held`` before it; None if unknown.

    Brokers print closing option rows with or without a sign, so one that the position can bear
    goes towards zero; all else has its ``fallback``."""
    if kind not in CLOSES or q is None or abs(held) <= 1e-9 or abs(q) > abs(held) + 1e-9:
        return fallback
    return -abs(q) if held > 0 else abs(q)


def cash_transfer_effect(kind: Column, cash: Column) -> Column:
    """Cash of a transfer without an instrument: the type tells its sign."""
    return F.when(kind == "transfer_in", F.abs(cash)).when(kind == "transfer_out", -F.abs(cash)).otherwise(cash)


def with_defaults(parsed_position: Column, kind: Column, q: Column, parsed_cash: Column, net: Column, parsed_date: Column, settle: Column, trade: Column) -> tuple[Column, Column, Column]:
    """Position effect, cash effect and effective date that a row is stored with."""
    position = F.coalesce(parsed_position, position_delta(kind, q)).alias("position_delta")
    return position, F.coalesce(parsed_cash, net).alias("cash_delta"), F.coalesce(parsed_date, settle, trade).alias("cash_effective_date")


def effective_date(effective: Column, trade: Column) -> Column:
    return F.coalesce(effective, trade)


def cash_effect(cash: Column, net: Column) -> Column:
    return F.coalesce(cash, net)

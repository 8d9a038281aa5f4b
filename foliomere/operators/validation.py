"""Named rules over parsed statements: each is a condition that offending rows meet.

A rule set is a mapping of names to conditions, so all rules of one kind of row are one pass over it.
Rules that look at other rows (duplicates, scopes without rows) join or group first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomere.functions.keys import is_iso_date
from foliomere.functions.movements import ADDS, NON_CASH, REVERSES, TAKES, UNDERIVABLE

# What the domains admit.
STATEMENT_TYPES = ("monthly", "quarterly", "annual")
ASSET_TYPES = ("equity", "etf", "mutual_fund", "bond", "option", "cash", "other")
CURRENCIES = ("CAD", "USD")
SECTIONS = ("positions", "cash", "summary")
COMPLETENESS = ("complete", "partial", "unknown", "absent")
CASH_TYPES = ("deposit", "withdrawal", "dividend", "interest", "interest_expense", "fee", "tax", "adjustment")
TYPES = tuple(dict.fromkeys((*ADDS, *TAKES, *REVERSES, *UNDERIVABLE, *NON_CASH, *CASH_TYPES, "journal")))
#: Rules that warn and do not block.
WARNINGS = ("missing_position_raw_line", "cash_source_evidence_unavailable", "snapshot_scope_undeclared")


def blank(x: str) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) == ""


def outside(x: str, domain: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(x).isin(*domain), F.lit(False))


def not_finite(*names: str) -> Column:
    """Whether any of the columns holds a number that is none."""
    tests = [F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False)) for c in names]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def issues(rows: DataFrame, rules: dict[str, Column], subject: str) -> DataFrame:
    """issue, severity, subject for every rule that a row breaks."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    out = rows.select(F.explode(found).alias("issue"), F.col(subject).alias("subject"))
    return out.select("issue", F.when(F.col("issue").isin(*WARNINGS), "warning").otherwise("error").alias("severity"), "subject")


def statement_rules() -> dict[str, Column]:
    """Rows: account_number, statement_type, period_start and period_end as text, pages, page_count, page_method."""
    start, end = is_iso_date(F.col("period_start")), is_iso_date(F.col("period_end"))
    return {
        "missing_statement_pages": F.coalesce(F.size("pages"), F.lit(0)) <= 0,
        "invalid_statement_pages": F.exists("pages", lambda p: p.isNull() | (p < 1)) | (F.size(F.array_distinct("pages")) != F.size("pages")),
        "statement_page_out_of_range": F.exists("pages", lambda p: p > F.col("page_count")),
        "missing_statement_page_method": blank("page_method"),
        "missing_account_number": blank("account_number"),
        "invalid_statement_type": outside("statement_type", STATEMENT_TYPES),
        "invalid_period_start": ~start,
        "invalid_period_end": ~end,
        "reversed_period": start & end & (F.col("period_start") > F.col("period_end")),
    }


def transaction_rules() -> dict[str, Column]:
    """Rows: the period's ends and dates as text, txn_type, instrument, related, ratio, quantity, net_amount, confidence, raw_line."""
    traded = is_iso_date(F.col("trade_date"))
    moves = F.col("txn_type").isin(*ADDS, *TAKES, *REVERSES)
    renamed = F.col("txn_type") == "name_change"
    optional = lambda c: F.col(c).isNotNull() & ~is_iso_date(F.col(c))
    return {
        "invalid_transaction_date": ~traded,
        "transaction_date_outside_period": traded & ~F.col("trade_date").between(F.col("period_start"), F.col("period_end")),
        "invalid_settlement_date": optional("settle_date"),
        "invalid_cash_effective_date": optional("cash_effective_date"),
        "invalid_transaction_type": outside("txn_type", TYPES),
        "position_movement_without_instrument": moves & blank("instrument") & (F.coalesce("quantity", F.lit(0.0)) != 0),
        "unexpected_related_instrument": ~renamed & ~blank("related"),
        "ticker_change_without_old_instrument": renamed & ~blank("related") & blank("instrument"),
        "invalid_ticker_change_pair": renamed & (F.col("related") == F.col("instrument")),
        "invalid_ticker_change_ratio": renamed & ~blank("related") & ~(F.coalesce("ratio", F.lit(0.0)) > 0),
        "invalid_numeric": not_finite("quantity", "net_amount", "ratio"),
        "invalid_resolution_confidence": F.coalesce(~F.col("confidence").between(0, 1), F.lit(False)),
        "missing_raw_line": blank("raw_line"),
    }


def instrument_rules() -> dict[str, Column]:
    """Rows: asset_type, symbol, currency, row_currency, root, expiry as text, strike, option_type, multiplier."""
    option = F.col("asset_type") == "option"
    return {
        "invalid_asset_type": outside("asset_type", ASSET_TYPES),
        "missing_symbol": blank("symbol"),
        "invalid_currency": outside("currency", CURRENCIES),
        "instrument_currency_mismatch": F.coalesce(F.col("currency") != F.col("row_currency"), F.lit(False)),
        "incomplete_option_identity": option & (blank("root") | blank("expiry") | F.col("strike").isNull() | blank("option_type")),
        "invalid_option_type": option & ~blank("option_type") & outside("option_type", ("C", "P", "call", "put")),
        "invalid_option_expiry": option & ~blank("expiry") & ~is_iso_date(F.col("expiry")),
        "invalid_option_multiplier": option & ~(F.coalesce("multiplier", F.lit(0)) > 0),
        "missing_numeric": option & F.col("strike").isNull(),
    }


def scope_rules() -> dict[str, Column]:
    """Rows: section_type, scope_key, completeness, blocking and other (numbers of issues), rows (of the scope)."""
    open_ = F.col("completeness").isin("partial", "unknown")
    return {
        "invalid_snapshot_section_type": outside("section_type", SECTIONS),
        "invalid_snapshot_scope_key": blank("scope_key"),
        "invalid_snapshot_completeness": outside("completeness", COMPLETENESS),
        "complete_scope_has_blocking_issue": (F.col("completeness") == "complete") & (F.col("blocking") > 0),
        "incomplete_scope_without_issue": open_ & (F.col("blocking") + F.col("other") == 0),
        "absent_snapshot_scope_has_rows": (F.col("completeness") == "absent") & (F.col("rows") > 0),
    }


def repeated(rows: DataFrame, keys: list[str], issue: str) -> DataFrame:
    """issue, severity, subject (the keys joined by |) of keys that more than one row has."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return many.select(F.lit(issue).alias("issue"), F.lit("error").alias("severity"), F.concat_ws("|", *keys).alias("subject"))


def undeclared(rows: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Scopes that rows are in but no declaration names."""
    lone = rows.select(*keys).distinct().join(declared.select(*keys).distinct(), keys, "left_anti")
    return lone.select(F.lit("snapshot_scope_undeclared").alias("issue"), F.lit("warning").alias("severity"), F.concat_ws("|", *keys).alias("subject"))


def split_quarantine(rows: DataFrame, start: str, end: str, date: str) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and rows dated outside of their period or without a date, with the reason."""
    bad = F.coalesce(~F.col(date).between(F.col(start), F.col(end)), F.lit(True))
    return rows.filter(~bad), rows.filter(bad).withColumn("reason", F.when(F.col(date).isNull(), "no date").otherwise("date outside period"))

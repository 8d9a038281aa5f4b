"""Cash of statements: activity, continuity, totals and changes against what is printed, and cash held at a date.

Amounts are whole cents. A check names why it can't be made before any difference is looked at,
and only a check that is made has a residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomere.functions.movements import NON_CASH

from .checkpoints import SCOPE, anchors

#: Cents of a difference that rounding explains.
TOLERANCE = 1


def status(residual: Column) -> Column:
    return F.when(residual == 0, "reconciled").when(F.abs(residual) <= TOLERANCE, "within_rounding").otherwise("unexplained_residual")


def checked(rows: DataFrame, reasons: dict[str, tuple[str, Column]], expected: Column, reported: Column) -> DataFrame:
    """``rows`` with expected, reported, residual, status, reason_code.

    ``reasons``: code -> (status, condition), the first that holds wins over the comparison."""
    code, state = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (kind, test) in reversed(reasons.items()):
        code, state = F.when(test, name).otherwise(code), F.when(test, kind).otherwise(state)
    rows = rows.withColumn("_code", code).withColumn("_state", state)
    made = F.col("_code").isNull()
    rows = rows.withColumn("expected", F.when(made, expected)).withColumn("reported", reported).withColumn("residual", F.col("reported") - F.col("expected"))
    final = F.when(made, status(F.col("residual"))).otherwise(F.col("_state"))
    why = F.when(final == "unexplained_residual", "residual_outside_tolerance").otherwise(F.col("_code"))
    return rows.withColumn("status", final).withColumn("reason_code", F.when(final == "not_applicable", F.lit(None)).otherwise(why)).drop("_code", "_state")


def effects(moves: DataFrame) -> DataFrame:
    """SCOPE, day, cents (null if unknown) of the movements that move cash, on the day that they take effect."""
    rows = moves.filter(~F.col("txn_type").isin(*NON_CASH))
    return rows.select(*SCOPE, F.coalesce("cash_effective_date", "trade_date").alias("day"), (F.col("net_amount") * 100).cast("long").alias("cents"))


def activity(statements: DataFrame, balances: DataFrame, moves: DataFrame) -> DataFrame:
    """statement_id, opening, summed, components, expected, reported, residual, status, reason_code.

    What takes effect within a period counts, whichever statement prints it. Periods are whole months here."""
    by = effects(moves).groupBy(*SCOPE, F.last_day("day").alias("period_end"))
    sums = by.agg(F.sum("cents").alias("summed"), F.count("cents").alias("components"), F.count_if(F.col("cents").isNull()).alias("unknown"))
    rows = statements.select("statement_id", *SCOPE, "period_end", "completeness").join(sums, [*SCOPE, "period_end"], "left").join(balances, "statement_id", "left")
    rows = rows.withColumn("summed", F.coalesce("summed", F.lit(0).cast("long"))).withColumn("components", F.coalesce("components", F.lit(0).cast("long")))
    lacking = "incomplete_input"
    reasons = {
        "current_scope_incomplete": (lacking, F.col("completeness") != "complete"),
        "statement_balance_missing": (lacking, F.col("closing").isNull() | F.col("opening").isNull()),
        "movement_value_missing": (lacking, F.coalesce("unknown", F.lit(0)) > 0),
    }
    out = checked(rows, reasons, F.col("opening") + F.col("summed"), F.col("closing"))
    return out.select("statement_id", "opening", "summed", "components", "expected", "reported", "residual", "status", "reason_code")


def continuity(statements: DataFrame, balances: DataFrame) -> DataFrame:
    """statement_id, expected, reported, residual, status, reason_code: each opening against the closing before it."""
    rows = statements.select("statement_id", *SCOPE, "period_start", "period_end", "completeness").join(balances, "statement_id", "left")
    w = Window.partitionBy(*SCOPE).orderBy("period_end", "statement_id")
    rows = rows.select("*", *(F.lag(c).over(w).alias(f"prior_{c}") for c in ("statement_id", "completeness", "period_end", "closing")))
    lacking = "incomplete_input"
    reasons = {
        "current_scope_incomplete": (lacking, F.col("completeness") != "complete"),
        "prior_scope_missing": ("missing_prior_checkpoint", F.col("prior_statement_id").isNull()),
        "prior_scope_incomplete": (lacking, F.col("prior_completeness") != "complete"),
        "statement_period_gap": (lacking, F.datediff("period_start", "prior_period_end") != 1),
        "statement_balance_missing": (lacking, F.col("prior_closing").isNull() | F.col("opening").isNull()),
    }
    return checked(rows, reasons, F.col("prior_closing"), F.col("opening")).select("statement_id", "expected", "reported", "residual", "status", "reason_code")


def totals(statements: DataFrame, printed: DataFrame, values: DataFrame, balances: DataFrame) -> DataFrame:
    """statement_id, section, expected, reported, residual, status, reason_code of every printed total.

    ``printed``: statement_id, section (positions, cash or summary), total; ``values``: statement_id,
    value (null if unknown). A summary is both of its sections."""
    worth = values.groupBy("statement_id").agg(F.sum("value").alias("worth"), F.count_if(F.col("value").isNull()).alias("unvalued"))
    rows = printed.join(statements.select("statement_id", "completeness"), "statement_id").join(worth, "statement_id", "left").join(balances.select("statement_id", "closing"), "statement_id", "left")
    held, cash = F.col("section") != "cash", F.col("section") != "positions"
    lacking, zero = "incomplete_input", F.lit(0).cast("long")
    reasons = {
        "current_scope_incomplete": (lacking, F.col("completeness") != "complete"),
        "statement_value_missing": (lacking, held & (F.coalesce("unvalued", zero) > 0)),
        "statement_balance_missing": (lacking, cash & F.col("closing").isNull()),
    }
    expected = F.when(held, F.coalesce("worth", zero)).otherwise(zero) + F.when(cash, F.col("closing")).otherwise(zero)
    return checked(rows, reasons, expected, F.col("total")).select("statement_id", "section", "expected", "reported", "residual", "status", "reason_code")


def changes(printed: DataFrame) -> DataFrame:
    """statement_id, expected, reported, residual, status of summaries that print an opening value and a change."""
    rows = printed.filter("section = 'summary' and opening_total is not null and change is not null")
    return checked(rows, {}, F.col("opening_total") + F.col("change"), F.col("total")).select("statement_id", "expected", "reported", "residual", "status", "reason_code")


def held_at(statements: DataFrame, balances: DataFrame, moves: DataFrame, at: Column) -> DataFrame:
    """SCOPE, balance, missing, state: the latest complete closing by the date and what took effect after it."""
    anchor = anchors(statements, at).join(balances.select("statement_id", "closing"), "statement_id").filter("closing is not null")
    anchor = anchor.select(*SCOPE, F.col("period_end").alias("anchor_date"), "closing")
    later = effects(moves).filter(F.col("day") <= at).join(anchor.select(*SCOPE, "anchor_date"), SCOPE, "left")
    later = later.filter(F.col("anchor_date").isNull() | (F.col("day") > F.col("anchor_date")))
    sums = later.groupBy(*SCOPE).agg(F.sum("cents").alias("moved"), F.count_if(F.col("cents").isNull()).alias("missing"))
    rows = anchor.join(sums, SCOPE, "full_outer")
    balance = F.coalesce("closing", F.lit(0).cast("long")) + F.coalesce("moved", F.lit(0).cast("long"))
    missing = F.coalesce("missing", F.lit(0).cast("long"))
    state = F.when(missing > 0, "incomplete").when(F.col("anchor_date") == at, "reported").otherwise("reconstructed")
    return rows.select(*SCOPE, balance.alias("balance"), missing.alias("missing"), state.alias("state")).filter("balance != 0")


def inferred_opening(statements: DataFrame, balances: DataFrame, moves: DataFrame) -> DataFrame:
    """SCOPE, as_of, balance: the first complete closing less all that took effect by then, dated the day before."""
    complete = statements.filter("completeness = 'complete'").join(balances.select("statement_id", "closing"), "statement_id").filter("closing is not null")
    first = complete.groupBy(*SCOPE).agg(F.min("period_end").alias("first"), F.min_by("closing", "period_end").alias("closing"))
    moved = effects(moves).join(first.select(*SCOPE, "first"), SCOPE).filter(F.col("day") <= F.col("first")).groupBy(*SCOPE).agg(F.sum("cents").alias("moved"))
    rows = first.join(moved, SCOPE, "left").withColumn("balance", F.col("closing") - F.coalesce("moved", F.lit(0).cast("long")))
    return rows.filter("balance != 0").select(*SCOPE, F.date_sub("first", 1).alias("as_of"), "balance")

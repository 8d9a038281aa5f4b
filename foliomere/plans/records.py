"""Queries over keys, names, statement checks, validation and merges, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomere.functions import identity, names, text
from foliomere.operators import asof, cash, checkpoints, evidence, listing, merge, replay, resolve, statements, validation
from foliomere.sources.ledger import Ledger

from .queries import AS_OF, day, query

_KINDS = "CASE p_partkey % 5 WHEN 0 THEN 'option' WHEN 1 THEN 'etf' ELSE 'equity' END"


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN concat('ik1|OPTION|', url_encode(upper(replace(p_name, ' ', ''))), '|CAD|2024-03-15|', p_size, CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '' END, '|CALL|100')
 ELSE concat('ik1|', upper({_KINDS}), '|', url_encode(upper(replace(p_name, ' ', ''))), '|CAD') END AS instrument_key FROM part""")
def canonical_instrument_keys(t: Ledger) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 5 == 0, "option").when(F.col("p_partkey") % 5 == 1, "etf").otherwise("equity")
    strike = F.col("p_size").cast("decimal(18,4)") + F.when(F.col("p_partkey") % 2 == 0, F.lit("0.5").cast("decimal(18,4)")).otherwise(F.lit(0))
    key = identity.instrument_key(kind, F.col("p_name"), F.lit(" cad "), None, F.lit("2024-03-15"), strike, F.lit("call"))
    return t.raw("part").select("p_partkey", key.alias("instrument_key"))


@query("""SELECT statement_id, concat('sk1:', sha256(concat('{"account":"', account_id, '","institution":"BANK%20ONE","period_end":"', period_end, '","period_start":"', period_start, '","source":"a.txt","statement_type":"MONTHLY"}'))) AS statement_key,
 concat('ev2:', sha256(concat('{"kind":"POSITION","occurrence":', statement_id % 7, ',"raw":"', currency, '","rule":"","source":"a.txt"}'))) AS evidence_key FROM statements""")
def canonical_statement_keys(t: Ledger) -> DataFrame:
    source, none = F.lit(" a.txt "), F.lit(None).cast("string")
    key = identity.statement_key(source, F.lit("Bank  one"), F.col("account_id").cast("string"), F.col("period_start"), F.col("period_end"), F.lit("monthly"))
    evidence = identity.evidence_key(source, F.lit("position"), F.col("statement_id") % 7, F.col("currency"), none)
    return t.statements().select("statement_id", key.alias("statement_key"), evidence.alias("evidence_key"))


@query("""SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]+', '', 'g') AS compact, trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g')) AS spaced,
 regexp_matches(c_mktsegment, '^[A-Z0-9][A-Z0-9.-]{0,8}$') AS explicit FROM customer""")
def identity_terms(t: Ledger) -> DataFrame:
    name = F.col("c_name")
    return t.raw("customer").select("c_custkey", identity.compact_identity(name).alias("compact"), identity.spaced_identity(name).alias("spaced"), identity.explicit_symbol(F.col("c_mktsegment")).alias("explicit"))


_FORMS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in names.SHORT_FORMS.items()) + "}"
_STOPS = ", ".join(f"'{w}'" for w in names.STOP_WORDS)


@query(f"""SELECT p_partkey, array_to_string(list_filter(list_distinct_ordered, lambda w: w NOT IN ({_STOPS}) AND length(w) > 1 AND NOT regexp_matches(w, '^[0-9]{{3,}}$')), ' ') AS words FROM
 (SELECT p_partkey, list_transform(regexp_extract_all(upper(concat(p_name, ' INC RTY')), '[A-Z0-9]+'), lambda w: COALESCE({_FORMS}[w], w)) AS found,
  list_filter(list_transform(found, lambda w, i: CASE WHEN list_position(found, w) = i THEN w END), lambda w: w IS NOT NULL) AS list_distinct_ordered FROM part)""")
def security_words(t: Ledger) -> DataFrame:
    line = F.concat(F.lit("Bought "), "p_name", F.lit(" Inc rty AB-123456 100 $12.50 1,250.00 left"))
    return t.raw("part").select("p_partkey", F.array_join(names.name_words(line), " ").alias("words"))


@query("""SELECT p_partkey, substr(array_to_string(list_slice(list_filter(string_split(trim(regexp_replace(regexp_replace(concat(upper(p_name), ' '), '[^A-Z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> ''), 1, 4), '_'), 1, 24) AS symbol,
 upper(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS line FROM part""")
def made_symbols(t: Ledger) -> DataFrame:
    described = F.concat(F.lit("SOLD  Dividend: "), "p_name", F.lit(" 12,000.5"))
    return t.raw("part").select("p_partkey", names.made_symbol(described).alias("symbol"), names.plain_line(F.concat(F.lit(" "), "p_type", F.lit("  "))).alias("line"))


@query("""SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS worded, CAST(o_orderdate AS DATE) AS slashed, CAST(o_orderdate AS DATE) AS short, CAST(o_orderdate AS DATE) AS hinted FROM orders""")
def printed_dates(t: Ledger) -> DataFrame:
    """Days printed in several forms and read back."""
    d = F.to_date("o_orderdate")
    rows = t.raw("orders").select(d.alias("day")).distinct()
    shown = {"iso": "yyyy/MM/dd", "worded": "MMMM d, yyyy", "slashed": "M/d/yyyy", "short": "MM/dd/yy"}
    read = [text.parse_date(F.upper(F.date_format("day", form))).alias(k) for k, form in shown.items()]
    return rows.select("day", *read, text.parse_date(F.date_format("day", "MMM d"), F.year("day")).alias("hinted"))


@query("""SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month, (date_trunc('month', o_orderdate)::DATE + CAST((12 - isodow(date_trunc('month', o_orderdate))) % 7 + 14 AS INTEGER))::DATE AS year_first,
 (date_trunc('month', o_orderdate)::DATE + CAST((12 - isodow(date_trunc('month', o_orderdate))) % 7 + 14 AS INTEGER))::DATE AS month_first FROM orders WHERE year(o_orderdate) >= 2000""")
def option_expiries(t: Ledger) -> DataFrame:
    """Contract months of this century printed as letters and two digits, and read back as the third Friday."""
    m = F.trunc(F.to_date("o_orderdate"), "month")
    rows = t.raw("orders").filter(F.year("o_orderdate") >= 2000).select(m.alias("month")).distinct()
    name, year = F.upper(F.date_format("month", "MMM")), F.date_format("month", "yy")
    return rows.select("month", text.option_expiry(F.concat_ws(" ", year, name)).alias("year_first"), text.option_expiry(F.concat(name, year)).alias("month_first"))


_BALANCES = """WITH cashed AS (SELECT account_id, currency, last_day(COALESCE(cash_effective_date, trade_date)) AS m, COALESCE(cash_effective_date, trade_date) AS d, CAST(net_amount * 100 AS BIGINT) AS cents FROM transactions WHERE txn_type <> 'stock_split'),
 monthly AS (SELECT account_id, currency, m, SUM(cents) AS cents, COUNT(cents) AS n, COUNT(*) FILTER (cents IS NULL) AS unknown FROM cashed GROUP BY ALL),
 ends AS (SELECT account_id, currency, period_end AS m, statement_id FROM statements),
 along AS (SELECT account_id, currency, m, cents, NULL AS statement_id, 0 AS turn FROM monthly UNION ALL SELECT account_id, currency, m, 0, statement_id, 1 FROM ends),
 sums AS (SELECT statement_id, account_id, currency, m, SUM(cents) OVER (PARTITION BY account_id, currency ORDER BY m, turn) AS total FROM along),
 printed AS (SELECT statement_id, account_id, currency, m, CASE WHEN statement_id % 17 = 0 THEN NULL ELSE CAST(total AS BIGINT) + CASE statement_id % 10 WHEN 3 THEN 1 WHEN 4 THEN 500 ELSE 0 END END AS closing FROM sums WHERE statement_id IS NOT NULL),
 balances AS (SELECT statement_id, lag(closing) OVER (PARTITION BY account_id, currency ORDER BY m) AS opening, closing FROM printed)"""


def balances(t: Ledger) -> DataFrame:
    """statement_id, opening, closing as printed, in cents; some are off, some missing."""
    moved = cash.effects(t.transactions()).groupBy(*cash.SCOPE, F.last_day("day").alias("m")).agg(F.sum("cents").alias("cents"))
    ends = t.statements().select(*cash.SCOPE, F.col("period_end").alias("m"), F.lit(0).cast("long").alias("cents"), "statement_id", F.lit(1).alias("turn"))
    along = moved.withColumn("statement_id", F.lit(None).cast("long")).withColumn("turn", F.lit(0)).unionByName(ends)
    w = Window.partitionBy(*cash.SCOPE).orderBy("m", "turn")
    rows = along.select("*", F.sum("cents").over(w).alias("total")).filter("statement_id is not null")
    off = F.when(F.col("statement_id") % 10 == 3, 1).when(F.col("statement_id") % 10 == 4, 500).otherwise(0)
    rows = rows.withColumn("closing", F.when(F.col("statement_id") % 17 != 0, F.col("total") + off))
    return rows.select("statement_id", F.lag("closing").over(Window.partitionBy(*cash.SCOPE).orderBy("m")).alias("opening"), "closing")


_CHECK = """CASE WHEN reason IS NULL THEN {expected} END AS expected, {reported} AS reported, CASE WHEN reason IS NULL THEN {reported} - ({expected}) END AS residual,
 CASE WHEN reason IS NOT NULL THEN CASE reason WHEN 'prior_scope_missing' THEN 'missing_prior_checkpoint' ELSE 'incomplete_input' END WHEN {reported} - ({expected}) = 0 THEN 'reconciled' WHEN abs({reported} - ({expected})) <= 1 THEN 'within_rounding' ELSE 'unexplained_residual' END AS status,
 CASE WHEN reason IS NOT NULL THEN reason WHEN abs({reported} - ({expected})) > 1 THEN 'residual_outside_tolerance' END AS reason_code"""


@query(_BALANCES + """, c AS (SELECT s.statement_id, opening, closing, CAST(COALESCE(cents, 0) AS BIGINT) AS summed, COALESCE(n, 0) AS components,
 CASE WHEN completeness <> 'complete' THEN 'current_scope_incomplete' WHEN closing IS NULL OR opening IS NULL THEN 'statement_balance_missing' WHEN COALESCE(unknown, 0) > 0 THEN 'movement_value_missing' END AS reason
 FROM statements s LEFT JOIN monthly y ON y.account_id = s.account_id AND y.currency = s.currency AND y.m = s.period_end LEFT JOIN balances b ON b.statement_id = s.statement_id)
 SELECT statement_id, opening, summed, components, """ + _CHECK.format(expected="opening + summed", reported="closing") + " FROM c")
def cash_activity_results(t: Ledger) -> DataFrame:
    return cash.activity(t.statements(), balances(t), t.transactions())


@query(_BALANCES + """, c AS (SELECT s.statement_id, opening, period_start, completeness, lag(s.statement_id) OVER w AS prior, lag(completeness) OVER w AS prior_completeness, lag(period_end) OVER w AS prior_end, lag(closing) OVER w AS prior_closing
  FROM statements s LEFT JOIN balances USING (statement_id) WINDOW w AS (PARTITION BY account_id, currency ORDER BY period_end)),
 r AS (SELECT *, CASE WHEN completeness <> 'complete' THEN 'current_scope_incomplete' WHEN prior IS NULL THEN 'prior_scope_missing' WHEN prior_completeness <> 'complete' THEN 'prior_scope_incomplete'
  WHEN period_start - prior_end <> 1 THEN 'statement_period_gap' WHEN prior_closing IS NULL OR opening IS NULL THEN 'statement_balance_missing' END AS reason FROM c)
 SELECT statement_id, """ + _CHECK.format(expected="prior_closing", reported="opening") + " FROM r")
def cash_continuity_results(t: Ledger) -> DataFrame:
    return cash.continuity(t.statements(), balances(t))


_TOTALS = _BALANCES + """, valued AS (SELECT statement_id, CASE WHEN statement_id % 19 = 0 AND instrument_id % 13 = 0 THEN NULL ELSE CAST(quantity * 1000 AS BIGINT) END AS value FROM positions),
 worth AS (SELECT statement_id, CAST(SUM(value) AS BIGINT) AS worth, COUNT(*) FILTER (value IS NULL) AS unvalued FROM valued GROUP BY 1),
 printed_totals AS (SELECT statement_id, section, CASE section WHEN 'positions' THEN COALESCE(worth, 0) WHEN 'cash' THEN COALESCE(closing, 0) ELSE COALESCE(worth, 0) + COALESCE(closing, 0) END + CASE statement_id % 9 WHEN 2 THEN -1 WHEN 5 THEN 250 ELSE 0 END AS total
  FROM statements LEFT JOIN worth USING (statement_id) LEFT JOIN balances USING (statement_id) CROSS JOIN (VALUES ('positions'), ('cash'), ('summary')) v(section))"""


def _values(t: Ledger) -> DataFrame:
    unknown = (F.col("statement_id") % 19 == 0) & (F.col("instrument_id") % 13 == 0)
    return t.positions().select("statement_id", F.when(~unknown, (F.col("quantity") * 1000).cast("long")).alias("value"))


def _printed(t: Ledger) -> DataFrame:
    zero = F.lit(0).cast("long")
    worth = _values(t).groupBy("statement_id").agg(F.sum("value").alias("worth"))
    rows = t.statements().select("statement_id").join(worth, "statement_id", "left").join(balances(t).select("statement_id", "closing"), "statement_id", "left")
    rows = rows.select("*", F.explode(F.array(*map(F.lit, ("positions", "cash", "summary")))).alias("section"))
    held, closing = F.coalesce("worth", zero), F.coalesce("closing", zero)
    total = F.when(F.col("section") == "positions", held).when(F.col("section") == "cash", closing).otherwise(held + closing)
    off = F.when(F.col("statement_id") % 9 == 2, -1).when(F.col("statement_id") % 9 == 5, 250).otherwise(0)
    return rows.select("statement_id", "section", (total + off).alias("total"))


@query(_TOTALS + """, c AS (SELECT p.statement_id, section, total, CASE WHEN section <> 'cash' THEN COALESCE(worth, 0) ELSE 0 END + CASE WHEN section <> 'positions' THEN closing ELSE 0 END AS sum_of,
 CASE WHEN completeness <> 'complete' THEN 'current_scope_incomplete' WHEN section <> 'cash' AND COALESCE(unvalued, 0) > 0 THEN 'statement_value_missing' WHEN section <> 'positions' AND closing IS NULL THEN 'statement_balance_missing' END AS reason
 FROM printed_totals p JOIN statements USING (statement_id) LEFT JOIN worth USING (statement_id) LEFT JOIN balances USING (statement_id))
 SELECT statement_id, section, """ + _CHECK.format(expected="sum_of", reported="total") + " FROM c")
def statement_total_results(t: Ledger) -> DataFrame:
    return cash.totals(t.statements(), _printed(t), _values(t), balances(t))


@query(_TOTALS + """, c AS (SELECT p.statement_id, total, CAST(NULL AS VARCHAR) AS reason, lag(total) OVER (PARTITION BY account_id, currency ORDER BY period_end) AS opening_total, statement_id % 5 AS change
 FROM printed_totals p JOIN statements USING (statement_id) WHERE section = 'summary')
 SELECT statement_id, """ + _CHECK.format(expected="opening_total + change", reported="total") + " FROM c WHERE opening_total IS NOT NULL")
def statement_change_results(t: Ledger) -> DataFrame:
    """Opening value and change against each summary's total; the change printed is a stand-in."""
    rows = _printed(t).join(t.statements().select("statement_id", *cash.SCOPE, "period_end"), "statement_id").filter("section = 'summary'")
    opening = F.lag("total").over(Window.partitionBy(*cash.SCOPE).orderBy("period_end"))
    return cash.changes(rows.withColumn("opening_total", opening).withColumn("change", F.col("statement_id") % 5))


@query(_BALANCES + f""", anchor AS (SELECT account_id, currency, max(period_end) AS d, max_by(s.statement_id, period_end) AS statement_id FROM statements s WHERE completeness = 'complete' AND period_end <= DATE '{AS_OF}' GROUP BY ALL),
 a AS (SELECT account_id, currency, d, closing FROM anchor JOIN balances USING (statement_id) WHERE closing IS NOT NULL),
 later AS (SELECT x.account_id, x.currency, SUM(cents) AS moved, COUNT(*) FILTER (cents IS NULL) AS missing FROM cashed x LEFT JOIN a ON a.account_id = x.account_id AND a.currency = x.currency WHERE x.d <= DATE '{AS_OF}' AND (a.d IS NULL OR x.d > a.d) GROUP BY ALL)
 SELECT account_id, currency, CAST(COALESCE(closing, 0) + COALESCE(moved, 0) AS BIGINT) AS balance, COALESCE(missing, 0) AS missing, CASE WHEN COALESCE(missing, 0) > 0 THEN 'incomplete' WHEN d = DATE '{AS_OF}' THEN 'reported' ELSE 'reconstructed' END AS state
 FROM a FULL JOIN later USING (account_id, currency) WHERE COALESCE(closing, 0) + COALESCE(moved, 0) <> 0""")
def cash_holdings(t: Ledger) -> DataFrame:
    return cash.held_at(t.statements(), balances(t), t.transactions(), day(AS_OF))


@query(_BALANCES + """, f AS (SELECT s.account_id, s.currency, min(period_end) AS first, min_by(closing, period_end) AS closing FROM statements s JOIN balances USING (statement_id) WHERE completeness = 'complete' AND closing IS NOT NULL GROUP BY ALL)
 SELECT f.account_id, f.currency, first - 1 AS as_of, CAST(any_value(closing) - COALESCE(SUM(cents), 0) AS BIGINT) AS balance FROM f LEFT JOIN cashed x ON x.account_id = f.account_id AND x.currency = f.currency AND x.d <= first
 GROUP BY f.account_id, f.currency, first HAVING any_value(closing) - COALESCE(SUM(cents), 0) <> 0""")
def initial_cash(t: Ledger) -> DataFrame:
    return cash.inferred_opening(t.statements(), balances(t), t.transactions())


@query("""WITH first AS (SELECT account_id, currency, min_by(statement_id, period_end) AS statement_id, min(period_end) AS as_of FROM statements WHERE completeness = 'complete' GROUP BY ALL),
 u AS (SELECT 'transaction' AS row_kind, row_id, account_id, instrument_id, trade_date, txn_type, quantity, CAST(net_amount AS DOUBLE) AS net_amount FROM transactions
 UNION ALL SELECT 'initial', concat('initial:-', p.account_id, '-', instrument_id), p.account_id, instrument_id, as_of, 'initial_position', quantity, NULL FROM positions p JOIN first f ON p.statement_id = f.statement_id)
 SELECT row_kind, row_id, account_id, concat('S', instrument_id) AS symbol, trade_date, txn_type, quantity, net_amount FROM u WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND txn_type IN ('initial_position', 'sell')""")
def transactions_union(t: Ledger) -> DataFrame:
    """Movements and initial positions in one list, filtered afterwards; columns that one side lacks are null."""
    first = t.statements().filter("completeness = 'complete'").groupBy("account_id", "currency").agg(F.min_by("statement_id", "period_end").alias("statement_id"), F.min("period_end").alias("as_of"))
    initial = t.positions().select("statement_id", "account_id", "instrument_id", "quantity").join(first.select("statement_id", "as_of"), "statement_id")
    rows = listing.with_initial(t.transactions(), initial)
    kept = rows.filter(F.col("trade_date").between("1997-01-01", "1998-12-31") & F.col("txn_type").isin("initial_position", "sell"))
    return kept.select("row_kind", "row_id", "account_id", F.concat(F.lit("S"), "instrument_id").alias("symbol"), "trade_date", "txn_type", "quantity", F.col("net_amount").cast("double").alias("net_amount"))


@query("""WITH p AS (SELECT row_id, trade_date, COUNT(*) OVER () AS total_count, row_number() OVER (ORDER BY trade_date DESC, row_id DESC, txn_type) AS k FROM transactions)
 SELECT row_id, trade_date, total_count, total_count > 300 AS has_more FROM p WHERE k <= 300""")
def transactions_counted(t: Ledger) -> DataFrame:
    """A page of the newest movements with the number of all and whether more follow."""
    return listing.counted_page(t.transactions().select("row_id", "trade_date", "txn_type"), 300).select("row_id", "trade_date", "total_count", "has_more")


@query("""SELECT p.period_end, p.currency, CAST(SUM(CAST(round(p.quantity * c.close_cents) AS BIGINT)) AS BIGINT) AS value_cents, COUNT(*) FILTER (c.close_cents IS NULL) AS unpriced
 FROM positions p ASOF LEFT JOIN prices c ON p.instrument_id = c.instrument_id AND p.period_end >= c.trade_date GROUP BY ALL""")
def performance_valued(t: Ledger) -> DataFrame:
    """Value of what statements print, at the last price by each one's end."""
    held = t.positions().select("instrument_id", "period_end", "currency", "quantity")
    # equal instrument and day need one price, however many statements end on it
    days = asof.asof_join(held.select("instrument_id", "period_end").distinct(), t.prices(), ["instrument_id"], "period_end", "trade_date", ["close_cents"])
    rows = held.join(days, ["instrument_id", "period_end"])
    value = F.round(F.col("quantity") * F.col("close_cents")).cast("long")
    return rows.groupBy("period_end", "currency").agg(F.sum(value).alias("value_cents"), F.count_if(F.col("close_cents").isNull()).alias("unpriced"))


@query("""SELECT issue, severity, subject FROM (SELECT statement_id AS subject, 'error' AS severity, unnest(list_filter([
 CASE WHEN statement_id % 23 = 0 THEN 'missing_statement_pages' END, CASE WHEN statement_id % 29 = 0 AND statement_id % 23 <> 0 THEN 'statement_page_out_of_range' END, CASE WHEN statement_id % 31 = 0 THEN 'missing_account_number' END,
 CASE WHEN statement_id % 37 = 0 THEN 'invalid_statement_type' END, CASE WHEN statement_id % 41 = 0 THEN 'invalid_period_start' END, CASE WHEN statement_id % 43 = 0 AND statement_id % 41 <> 0 THEN 'reversed_period' END], lambda x: x IS NOT NULL)) AS issue FROM statements)""")
def validation_statements(t: Ledger) -> DataFrame:
    """Rules of statements over rows with planted faults."""
    n = F.col("statement_id")
    shown = F.date_format("period_start", "yyyy-MM-dd")
    rows = t.statements().select(
        n, F.when(n % 31 == 0, " ").otherwise("a").alias("account_number"), F.when(n % 37 == 0, "weekly").otherwise("monthly").alias("statement_type"),
        F.when(n % 41 == 0, F.date_format("period_start", "yyyy/MM/dd")).when(n % 43 == 0, F.lit("2100-01-01")).otherwise(shown).alias("period_start"), F.date_format("period_end", "yyyy-MM-dd").alias("period_end"),
        F.when(n % 23 == 0, F.array().cast("array<int>")).when(n % 29 == 0, F.array(F.lit(1), F.lit(9))).otherwise(F.array(F.lit(1), F.lit(2))).alias("pages"), F.lit(5).alias("page_count"), F.lit("offsets").alias("page_method"),
    )
    return validation.issues(rows, validation.statement_rules(), "statement_id")


@query("""SELECT issue, severity, subject FROM (SELECT row_id AS subject, 'error' AS severity, unnest(list_filter([
 CASE WHEN last_day(trade_date) <> last_day(cash_effective_date) THEN 'transaction_date_outside_period' END, CASE WHEN instrument_id = 7 AND txn_type NOT IN ('dividend', 'journal', 'stock_split') THEN 'position_movement_without_instrument' END,
 CASE WHEN instrument_id = 9 AND txn_type = 'journal' THEN 'invalid_transaction_type' END, CASE WHEN instrument_id = 11 THEN 'missing_raw_line' END, CASE WHEN instrument_id = 12 THEN 'unexpected_related_instrument' END,
 CASE WHEN instrument_id = 13 THEN 'invalid_resolution_confidence' END, CASE WHEN instrument_id = 14 THEN 'invalid_numeric' END], lambda x: x IS NOT NULL)) AS issue FROM transactions)""")
def validation_transactions(t: Ledger) -> DataFrame:
    """Rules of transactions over rows with planted faults; the period is the month of the cash."""
    i, shown = F.col("instrument_id"), lambda c: F.date_format(c, "yyyy-MM-dd")
    rows = t.transactions().select(
        "row_id", shown("trade_date").alias("trade_date"), shown(F.trunc("cash_effective_date", "month")).alias("period_start"), shown(F.last_day("cash_effective_date")).alias("period_end"),
        F.lit(None).cast("string").alias("settle_date"), shown("cash_effective_date").alias("cash_effective_date"), F.when((i == 9) & (F.col("txn_type") == "journal"), "gift").otherwise(F.col("txn_type")).alias("txn_type"),
        F.when(i != 7, F.concat(F.lit("S"), i)).alias("instrument"), F.when(i == 12, "S1").alias("related"), F.lit(None).cast("double").alias("ratio"), F.when(i == 14, float("nan")).otherwise(F.col("quantity")).alias("quantity"),
        F.col("net_amount").cast("double").alias("net_amount"), F.when(i == 13, 1.5).otherwise(1.0).alias("confidence"), F.when(i != 11, "line").alias("raw_line"),
    )
    return validation.issues(rows, validation.transaction_rules(), "row_id")


@query("""WITH s AS (SELECT statement_id, completeness, CASE WHEN statement_id % 3 = 0 THEN 1 ELSE 0 END AS blocking FROM statements)
 SELECT 'complete_scope_has_blocking_issue' AS issue, 'error' AS severity, CAST(statement_id AS VARCHAR) AS subject FROM s WHERE completeness = 'complete' AND blocking = 1
 UNION ALL SELECT 'incomplete_scope_without_issue', 'error', CAST(statement_id AS VARCHAR) FROM s WHERE completeness = 'unknown' AND blocking = 0
 UNION ALL SELECT 'duplicate_snapshot_scope', 'error', concat(account_id, '|', period_end) FROM statements GROUP BY account_id, period_end HAVING COUNT(*) > 1
 UNION ALL SELECT 'snapshot_scope_undeclared', 'warning', CAST(statement_id AS VARCHAR) FROM statements WHERE statement_id % 5 = 0""")
def validation_scopes(t: Ledger) -> DataFrame:
    s = t.statements()
    rows = s.select("statement_id", F.lit("positions").alias("section_type"), F.lit("default").alias("scope_key"), "completeness", F.when(F.col("statement_id") % 3 == 0, 1).otherwise(0).alias("blocking"), F.lit(0).alias("other"), F.lit(1).alias("rows"))
    own = validation.issues(rows.withColumn("statement_id", F.col("statement_id").cast("string")), validation.scope_rules(), "statement_id")
    twice = validation.repeated(t.dealt(s, "account_id"), ["account_id", "period_end"], "duplicate_snapshot_scope")
    named = t.dealt(s, "statement_id")
    return own.unionByName(twice).unionByName(validation.undeclared(named, named.filter("statement_id % 5 != 0"), ["statement_id"]))


@query("""WITH o AS (SELECT c_custkey AS id, c_mktsegment AS name, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS nick, c_custkey % 3 AS flag FROM customer WHERE c_custkey % 4 <> 0),
 n AS (SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_custkey % 5 = 0 THEN 'new' END AS nick, c_custkey % 2 AS flag FROM customer WHERE c_custkey % 3 <> 0)
 SELECT id, COALESCE(n.name, o.name) AS name, COALESCE(n.nick, o.nick) AS nick, CASE WHEN o.flag IS NULL THEN n.flag WHEN n.flag IS NULL THEN o.flag ELSE greatest(o.flag, n.flag) END AS flag FROM o FULL JOIN n USING (id)""")
def account_upserts(t: Ledger) -> DataFrame:
    c, k = t.raw("customer"), F.col("c_custkey")
    old = c.filter(k % 4 != 0).select(k.alias("id"), F.col("c_mktsegment").alias("name"), F.when(k % 2 == 0, F.col("c_name")).alias("nick"), (k % 3).alias("flag"))
    new = c.filter(k % 3 != 0).select(k.alias("id"), F.upper("c_name").alias("name"), F.when(k % 5 == 0, "new").alias("nick"), (k % 2).alias("flag"))
    return merge.merged(old, new, ["id"], {"name": merge.TAKE_NEW, "nick": merge.KEEP_SET, "flag": merge.LARGEST})


@query("""SELECT instrument_id, trade_date, close_cents FROM prices WHERE instrument_id % 3 <> 0 UNION ALL SELECT instrument_id, trade_date, close_cents + 1 FROM prices WHERE instrument_id % 3 = 0 AND trade_date >= DATE '1998-01-01'""")
def price_refresh(t: Ledger) -> DataFrame:
    """A third of the symbols fetched anew: their kept rows go, the fetched ones come."""
    p = t.prices().select("instrument_id", "trade_date", "close_cents")
    fetched = p.filter((F.col("instrument_id") % 3 == 0) & (F.col("trade_date") >= "1998-01-01")).withColumn("close_cents", F.col("close_cents") + 1)
    every = t.prices().select("instrument_id").distinct().filter("instrument_id % 3 = 0")
    return merge.replaced(p.join(every, "instrument_id", "left_anti"), fetched, ["instrument_id"])


@query("""WITH q AS (SELECT l_partkey % 50 AS id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period_end, l_suppkey % 4 AS rank, SUM(l_quantity) AS revenue FROM lineitem GROUP BY ALL)
 SELECT id, period_end, max(rank) AS rank, max_by(revenue, rank) AS revenue, year(period_end) AS fiscal_year, quarter(period_end) AS fiscal_q FROM q GROUP BY id, period_end""")
def financials(t: Ledger) -> DataFrame:
    """Figures of each period by the newest symbol of a chain that has them."""
    end = F.trunc(F.to_date("l_shipdate"), "quarter")
    rows = t.raw("lineitem").groupBy((F.col("l_partkey") % 50).alias("id"), end.alias("period_end"), (F.col("l_suppkey") % 4).alias("rank")).agg(F.sum("l_quantity").alias("revenue"))
    return merge.fiscal(merge.newest_owner(rows, ["id", "period_end"], "rank"), "period_end").select("id", "period_end", "rank", "revenue", "fiscal_year", "fiscal_q")


@query("SELECT p_brand, p_size, CASE WHEN COUNT(DISTINCT p_type) = 1 THEN min(p_type) END AS p_type FROM part GROUP BY ALL")
def unique_values(t: Ledger) -> DataFrame:
    return merge.unique_or_none(t.raw("part"), ["p_brand", "p_size"], "p_type")


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS shown FROM lineitem GROUP BY 1")
def page_lists(t: Ledger) -> DataFrame:
    """Distinct pages of each owner, in order."""
    pages = F.array_sort(F.collect_set("l_linenumber"))
    return t.raw("lineitem").groupBy("l_orderkey").agg(F.array_join(pages, ",").alias("shown"))


@query("SELECT max(trade_date) AS latest, min(trade_date) AS earliest, COUNT(DISTINCT account_id) AS accounts FROM transactions")
def latest_date(t: Ledger) -> DataFrame:
    return t.transactions().agg(F.max("trade_date").alias("latest"), F.min("trade_date").alias("earliest"), F.count_distinct("account_id").alias("accounts"))


@query("""WITH rows AS (SELECT account_id, currency, trade_date, row_id FROM transactions WHERE txn_type = 'buy'),
 text AS (SELECT account_id, string_agg(concat('["', trade_date, '","', row_id, '"]'), ',' ORDER BY trade_date, row_id) AS payload FROM rows GROUP BY 1)
 SELECT account_id, sha256(concat('[', payload, ']')) AS digest FROM text""")
def content_hashes(t: Ledger) -> DataFrame:
    """A digest of each account's purchases in a fixed order, the same however they are stored."""
    rows = t.transactions().filter("txn_type = 'buy'").select("account_id", F.concat(F.lit('["'), "trade_date", F.lit('","'), "row_id", F.lit('"]')).alias("x"), F.struct("trade_date", "row_id").alias("o"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda r: r["x"])
    return rows.groupBy("account_id").agg(F.sha2(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")), 256).alias("digest"))


@query("""SELECT o_orderkey, o_totalprice, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def scoped_preference(t: Ledger) -> DataFrame:
    """The row of the preferred scope if there is one, else the newest."""
    w = Window.partitionBy("o_custkey").orderBy(F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), F.desc("o_orderdate"), "o_orderkey")
    return t.raw("orders").withColumn("k", F.row_number().over(w)).filter("k = 1").select("o_orderkey", "o_totalprice", "o_orderpriority")


_LINES = """WITH split AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL),
 lines AS (SELECT doc_id, line, upper(trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS s FROM split)"""


def _document_lines(t: Ledger) -> DataFrame:
    rows = t.raw("documents").filter("text is not null").select(F.col("doc_id").alias("relpath"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return rows.withColumn("line", F.col("line") + 1)


@query(_LINES + """, asked AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN substr(s, 1, greatest(length(s) - 3, 0)) ELSE s END AS t FROM lines WHERE line = 1),
 q AS (SELECT doc_id, trim(t) AS t FROM asked), e AS (SELECT q.doc_id, COUNT(*) AS n, min(line) AS line FROM q JOIN lines USING (doc_id) WHERE s = t GROUP BY 1),
 c AS (SELECT q.doc_id, COUNT(*) AS n, min(line) AS line FROM q JOIN lines USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM e) AND contains(s, t) AND length(t) >= 12 AND len(string_split(t, ' ')) >= 3 GROUP BY 1)
 SELECT doc_id, CASE WHEN COALESCE(e.n, c.n) = 1 THEN CAST(COALESCE(e.line, c.line) AS INTEGER) END AS line, CASE WHEN COALESCE(e.n, c.n) IS NULL THEN 'unmatched' WHEN COALESCE(e.n, c.n) > 1 THEN 'ambiguous' WHEN e.n = 1 THEN 'exact' ELSE 'contained' END AS method
 FROM q LEFT JOIN e USING (doc_id) LEFT JOIN c USING (doc_id)""")
def evidence_located(t: Ledger) -> DataFrame:
    """Where the first line of each document, cut short in some, stands in it."""
    lines = _document_lines(t)
    first = lines.filter("line = 1").select("relpath", F.col("relpath").alias("row_id"), names.plain_line(F.col("text")).alias("s"))
    cut = F.substr("s", F.lit(1), F.greatest(F.length("s") - 3, F.lit(0)))
    none = F.lit(None).cast("int")
    asked = first.select("relpath", "row_id", F.when(F.col("row_id") % 4 == 0, cut).otherwise(F.col("s")).alias("raw"), none.alias("page_hint"), none.alias("line_hint"))
    return evidence.located(asked, lines).select(F.col("row_id").alias("doc_id"), "line", "method")


@query(_LINES + """, used AS (SELECT doc_id, s AS t FROM lines WHERE line % 3 = 1 AND s <> ''), shown AS (SELECT * FROM lines WHERE s <> '')
 SELECT doc_id, COUNT(*) AS lines, COUNT(*) FILTER (EXISTS (SELECT 1 FROM used u WHERE u.doc_id = shown.doc_id AND (contains(u.t, s) OR (length(u.t) > 12 AND contains(s, u.t))))) AS matched FROM shown GROUP BY 1""")
def source_coverage(t: Ledger) -> DataFrame:
    """How many lines of each document every third of them, taken as rows, account for."""
    lines = _document_lines(t)
    out = evidence.coverage(lines, lines.filter("line % 3 = 1").select("relpath", F.col("text").alias("raw")))
    return out.select(F.col("relpath").alias("doc_id"), "lines", "matched")


@query("""WITH names AS (SELECT p_partkey, upper(p_name) AS term FROM part), one AS (SELECT term, min(p_partkey) AS found FROM names GROUP BY 1 HAVING COUNT(DISTINCT p_partkey) = 1),
 types AS (SELECT upper(p_type) AS term, min(p_partkey) AS found FROM part GROUP BY 1 HAVING COUNT(DISTINCT p_partkey) = 1)
 SELECT p_partkey, COALESCE(a.found, b.found) AS instrument, CASE WHEN a.found IS NOT NULL THEN 'name' WHEN b.found IS NOT NULL THEN 'type' END AS method
 FROM part LEFT JOIN one a ON a.term = upper(p_name) LEFT JOIN types b ON b.term = upper(p_type)""")
def identity_ladder(t: Ledger) -> DataFrame:
    """Parts looked up by names, then by types, that only one part has."""
    p = t.raw("part").select("p_partkey", F.upper("p_name").alias("n"), F.upper("p_type").alias("k"))
    steps = [("name", "n", resolve.single(p, "n", "p_partkey")), ("type", "k", resolve.single(p, "k", "p_partkey"))]
    return resolve.ladder(p, steps).select("p_partkey", "instrument", "method")


@query()
def holdings_replay(t: Ledger) -> DataFrame:
    """Holdings with each chain of symbols replayed in order; two instruments change into others. Held against a plain fold in tests."""
    statements, moves = t.statements(), t.transactions()
    anchor = checkpoints.anchors(statements, day(AS_OF)).withColumnRenamed("period_end", "as_of").withColumn("scope_key", F.lit("default"))
    name = F.concat(F.lit("S"), "instrument_id").alias("instrument")
    held = checkpoints.of_statement(t.positions().select("account_id", "currency", "statement_id", name, "quantity"), anchor).select("account_id", "currency", "scope_key", "instrument", "quantity")
    changed = moves.filter("instrument_id in (0, 10) and txn_type = 'stock_split'")
    number = F.xxhash64("row_id", "txn_type", "quantity").alias("move_id")
    rows = moves.select("account_id", "currency", name, "trade_date", number, "txn_type", "quantity", F.col("position_delta").alias("effect"))
    successor = F.when(F.col("instrument_id") == 0, "S50").otherwise("S60").alias("successor")
    changes = changed.select(number, successor, F.lit(2.0).alias("ratio")).distinct()
    lineage = t.spark.createDataFrame([("S0", "S0"), ("S50", "S0"), ("S10", "S10"), ("S60", "S10")], "instrument string, root string")
    none = t.spark.createDataFrame([], "account_id long, currency string, instrument string, quantity double, as_of date")
    out = replay.replayed(anchor.select("account_id", "currency", "scope_key", "as_of"), held, none, rows, changes, lineage, AS_OF)
    return replay.by_lineage(out)


_CURRENCY_OF = "CASE WHEN p_partkey % 3 = 0 THEN 'USD' ELSE 'CAD' END"


@query(f"""WITH named AS (SELECT p_partkey, p_brand, p_size, {_CURRENCY_OF} AS currency, list_distinct(string_split(upper(p_name), ' ')) AS w, string_split(upper(p_name), ' ')[1] AS f FROM part),
 held AS (SELECT p_brand AS held_by, currency, p_partkey AS instrument, p_size AS gap, w AS v, f AS g FROM named WHERE p_size % 2 = 1),
 met AS (SELECT a.p_partkey AS row_id, held_by = a.p_brand AS own, instrument, gap, len(list_intersect(w, v)) AS both_n, len(list_distinct(list_concat(w, v))) AS either_n, least(len(w), len(v)) AS small, f, g FROM named a JOIN held b ON a.currency = b.currency WHERE a.p_size % 2 = 0),
 scored AS (SELECT *, CASE WHEN both_n = either_n THEN 1.0::DOUBLE WHEN both_n >= 2 AND both_n = small THEN 0.97::DOUBLE WHEN both_n >= 2 AND 100 * both_n >= 55 * either_n AND 100 * both_n >= 75 * small THEN 0.9::DOUBLE WHEN f = g AND length(f) >= 5 THEN 0.86::DOUBLE ELSE 0 END AS score FROM met),
 scoped AS (SELECT *, bool_or(own) OVER (PARTITION BY row_id) AS any_own FROM scored WHERE score > 0),
 each AS (SELECT row_id, own, instrument, MAX(score) AS score, MAX(both_n) AS both_n FROM scoped WHERE own OR NOT any_own GROUP BY ALL),
 ranked AS (SELECT *, lead(score) OVER (PARTITION BY row_id ORDER BY score DESC, instrument) AS nxt FROM each QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, instrument) = 1),
 judged AS (SELECT *, COALESCE(score - nxt >= 0.1, TRUE) AND (own OR (score >= 0.97 AND both_n >= 2)) AS clear FROM ranked)
SELECT p_partkey AS row_id, CASE WHEN clear THEN instrument END AS instrument, score, CASE WHEN own THEN 'account' WHEN NOT own THEN 'portfolio' END AS scope, CASE WHEN clear THEN 'resolved' WHEN NOT clear THEN 'ambiguous' ELSE 'unmatched' END AS status
FROM named LEFT JOIN judged ON row_id = p_partkey WHERE p_size % 2 = 0""")
def trade_names(t: Ledger) -> DataFrame:
    """Trades by the name of a part alone, against what the accounts of its brand hold, else any account."""
    p = t.raw("part").select("p_partkey", "p_brand", "p_size", "p_name", F.expr(_CURRENCY_OF).alias("currency"))
    trades = p.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("account_id"), "currency", F.lit("2024-01-31").cast("date").alias("trade_date"), F.concat(F.lit("BOUGHT "), "p_name", F.lit(" 10 5.00 50.00")).alias("line"))
    held = p.filter("p_size % 2 = 1").select(F.col("p_brand").alias("account_id"), "currency", F.col("p_partkey").alias("instrument"), F.date_sub(F.lit("2024-01-31").cast("date"), F.col("p_size")).alias("as_of"), F.col("p_name").alias("line"))
    return resolve.by_name(trades, held)


@query("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL), shown AS (SELECT DISTINCT doc_id, raw FROM lines),
 quoted AS (SELECT doc_id, raw, concat('{"kind":"LINE","occurrence":1,"raw":', to_json(raw), ',"rule":"a","source":"b.txt"}') AS j FROM shown)
SELECT doc_id, sha256(raw) AS raw_sha, concat('ev2:', sha256(list_aggregate(list_transform(string_split(j, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN printf('\\u%04x', unicode(c))
 ELSE printf('\\u%04x\\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) END), 'string_agg', ''))) AS evidence_key FROM quoted""")
def line_evidence_keys(t: Ledger) -> DataFrame:
    """Keys of all distinct lines of documents, whose letters beyond ASCII are hashed escaped."""
    rows = t.raw("documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("raw")).distinct()
    key = identity.evidence_key(F.lit("b.txt"), F.lit("line"), F.lit(1), F.col("raw"), F.lit("a"))
    return rows.select("doc_id", F.sha2("raw", 256).alias("raw_sha"), key.alias("evidence_key"))


def _statement_texts(t: Ledger) -> DataFrame:
    """relpath, page, line, text: each statement printed with its headings and movements."""
    s = t.statements().select(F.col("statement_id").alias("relpath"), *cash.SCOPE, "period_start", "period_end")
    shown = lambda c: F.date_format(c, "MMMM d, yyyy")
    code = F.when(F.col("currency") == "CAD", "Canadian dollar account").otherwise("U.S. dollar account")
    heads = F.array(F.concat(F.lit("Account number: A-"), "account_id"), F.concat(F.lit("Period: "), shown("period_start"), F.lit(" to "), shown("period_end")), code, F.lit("Activity"))
    top = s.select("relpath", F.posexplode(heads).alias("line", "text")).withColumn("line", F.col("line") + 1)
    moves = t.transactions().filter("txn_type in ('buy', 'sell', 'dividend')").withColumn("period_end", F.last_day("trade_date"))
    verb = F.when(F.col("txn_type") == "buy", "BOUGHT").when(F.col("txn_type") == "sell", "SOLD").otherwise("DIVIDEND")
    printed = F.concat_ws(" ", F.date_format("trade_date", "MMM d"), verb, F.concat(F.lit("S"), "instrument_id"), F.format_number("quantity", 2), F.format_number(F.abs("net_amount"), 2))
    rows = moves.join(s, [*cash.SCOPE, "period_end"]).select("relpath", printed.alias("text"))
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("relpath").orderBy("text")) + 4)
    return top.unionByName(rows).select("relpath", F.lit(1).alias("page"), "line", "text")


@query("""SELECT s.statement_id AS relpath, concat('A-', s.account_id) AS account, s.currency, s.period_end, trade_date, txn_type, quantity, CAST(net_amount AS DOUBLE) AS net_amount
 FROM transactions t JOIN statements s ON t.account_id = s.account_id AND t.currency = s.currency AND last_day(trade_date) = s.period_end WHERE txn_type IN ('buy', 'sell', 'dividend')""")
def statement_parse(t: Ledger) -> DataFrame:
    """Statement texts read back: headings carried to the lines below them, rows by the patterns of their section."""
    layout = statements.Layout()
    rows = statements.activity(statements.carried(_statement_texts(t), layout), layout)
    return rows.select("relpath", "account", "currency", "period_end", "trade_date", "txn_type", F.col("quantity").cast("double"), F.col("net_amount").cast("double"))


@query("SELECT statement_id AS relpath, concat('A-', account_id) AS account, currency, unnest(['positions', 'cash']) AS section, 'unknown' AS completeness FROM statements")
def statement_scopes(t: Ledger) -> DataFrame:
    """The scopes of texts without holdings or balances: nothing in them is complete."""
    layout = statements.Layout()
    return statements.scopes(statements.carried(_statement_texts(t), layout), layout)

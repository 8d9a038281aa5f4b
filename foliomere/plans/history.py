"""Queries over time and structure: holdings on all dates, chains of tickers, lots in order, contents of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomere.operators import fingerprint, lots, sweep, tickers
from foliomere.sources.ledger import Ledger

from .queries import query
from .records import _BALANCES, balances

_SWEPT = f"""dates AS (SELECT DISTINCT period_end AS as_of FROM statements WHERE completeness = 'complete'),
 own AS (SELECT statement_id, account_id, currency, period_end, lead(period_end) OVER (PARTITION BY account_id, currency ORDER BY period_end) AS until FROM statements WHERE completeness = 'complete'),
 anchored AS (SELECT o.*, d.as_of FROM own o JOIN dates d ON d.as_of >= period_end AND d.as_of <= period_end + {sweep.CARRY} AND (until IS NULL OR d.as_of < until)),
 told AS (SELECT a.account_id, a.currency, p.instrument_id, a.as_of, a.period_end, p.quantity AS q, 0 AS unknown FROM anchored a JOIN positions p ON p.statement_id = a.statement_id
  UNION ALL SELECT a.account_id, a.currency, t.instrument_id, a.as_of, a.period_end, COALESCE(position_delta, 0), CASE WHEN position_delta IS NULL THEN 1 ELSE 0 END FROM anchored a JOIN transactions t ON t.account_id = a.account_id AND t.currency = a.currency AND t.trade_date > a.period_end AND t.trade_date <= a.as_of),
 held AS (SELECT as_of, account_id, currency, instrument_id, period_end AS anchor_date, SUM(q) AS quantity, SUM(unknown) AS unknown FROM told GROUP BY ALL HAVING abs(SUM(q)) > 1e-9)"""


def _holdings(t: Ledger) -> DataFrame:
    s = t.statements()
    return sweep.holdings_over(s, t.positions(), t.effects(), sweep.checkpoint_dates(s))


@query(f"""WITH {_SWEPT}
SELECT as_of, account_id, currency, instrument_id, quantity, anchor_date, CASE WHEN unknown > 0 THEN 'incomplete' WHEN anchor_date = as_of THEN 'reported' ELSE 'reconstructed' END AS state FROM held""")
def holdings_over_dates(t: Ledger) -> DataFrame:
    """Every holding on every checkpoint date, from checkpoints of at most 90 days before."""
    return _holdings(t).drop("unknown")


@query(f"""WITH {_SWEPT},
 valued AS (SELECT h.as_of, h.currency, CAST(round(quantity * close_cents) AS BIGINT) AS v FROM held h ASOF LEFT JOIN prices p ON h.instrument_id = p.instrument_id AND h.as_of >= p.trade_date),
 sums AS (SELECT as_of, currency, COALESCE(SUM(v), 0) AS v, COUNT(*) AS n, COUNT(*) FILTER (v IS NULL) AS u FROM valued GROUP BY ALL)
SELECT as_of, currency, CAST(COALESCE(v, 0) AS BIGINT) AS value_cents, COALESCE(n, 0) AS holdings, COALESCE(u, 0) AS unpriced FROM dates JOIN (SELECT DISTINCT currency FROM held) ON TRUE LEFT JOIN sums USING (as_of, currency)""")
def performance_total(t: Ledger) -> DataFrame:
    """Value held on every checkpoint date by currency; dates on which nothing is held are 0."""
    dates = sweep.checkpoint_dates(t.statements())
    return sweep.totals(sweep.valued_over(_holdings(t), t.prices(), dates), dates)


@query(_BALANCES + """
SELECT period_end AS as_of, account_id, currency, closing FROM statements JOIN balances USING (statement_id) WHERE completeness = 'complete' AND closing IS NOT NULL""")
def performance_cash(t: Ledger) -> DataFrame:
    """Printed closing balances of complete statements on their own dates."""
    return sweep.reported_cash(t.statements(), balances(t))


@query("SELECT currency, MAX(period_end) AS as_of FROM statements WHERE completeness = 'complete' AND period_end <= DATE '1998-06-30' GROUP BY 1")
def latest_holdings_dates(t: Ledger) -> DataFrame:
    """The last checkpoint date of each currency up to a day."""
    at = F.lit("1998-06-30").cast("date")
    rows = [sweep.latest_date(t.statements().filter(F.col("currency") == c), at).select(F.lit(c).alias("currency"), "as_of") for c in ("CAD", "USD")]
    return rows[0].unionByName(rows[1])


_LOTS = """raw AS (SELECT o_custkey AS account_id, l_partkey % 20 AS instrument_id, row_number() OVER (PARTITION BY o_custkey, l_partkey % 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i,
  CASE WHEN l_linenumber <> 5 THEN concat('lot ', CAST(l_quantity AS BIGINT) % 3) END AS raw_line, l_quantity AS quantity, l_discount AS avg_cost, CASE WHEN l_linenumber % 4 <> 2 THEN CAST(l_quantity AS BIGINT) % 2 + 0.5::DOUBLE END AS price,
  CASE WHEN l_tax > 0.01 THEN l_quantity END AS book_value, l_quantity * 2 AS market_value, l_quantity - 1 AS unrealized_pnl FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH RECURSIVE {_LOTS},
 folded AS (SELECT * FROM raw WHERE i = 1
  UNION ALL SELECT f.account_id, f.instrument_id, r.i, CASE WHEN same THEN f.raw_line ELSE COALESCE(f.raw_line || chr(10), '') || COALESCE(r.raw_line, '') END, CASE WHEN same THEN f.quantity ELSE f.quantity + r.quantity END, CASE WHEN same THEN f.avg_cost END,
   CASE WHEN f.price IS NULL THEN r.price WHEN r.price IS NULL OR abs(f.price - r.price) <= 1e-9 THEN f.price END, CASE WHEN same THEN f.book_value ELSE f.book_value + r.book_value END, CASE WHEN same THEN f.market_value ELSE f.market_value + r.market_value END, CASE WHEN same THEN f.unrealized_pnl ELSE f.unrealized_pnl + r.unrealized_pnl END
  FROM folded f JOIN raw r ON r.account_id = f.account_id AND r.instrument_id = f.instrument_id AND r.i = f.i + 1, LATERAL (SELECT COALESCE(f.raw_line, '') = COALESCE(r.raw_line, '') AS same))
SELECT account_id, instrument_id, i AS lots, raw_line, quantity, avg_cost, price, book_value, market_value, unrealized_pnl FROM folded QUALIFY row_number() OVER (PARTITION BY account_id, instrument_id ORDER BY i DESC) = 1""")
def lot_fold(t: Ledger) -> DataFrame:
    """Positions out of lots in their printed order: a reprint of all lines so far adds nothing, one of a single lot does."""
    rows = t.raw("lineitem").join(t.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    keys = [F.col("o_custkey").alias("account_id"), (F.col("l_partkey") % 20).alias("instrument_id")]
    w = Window.partitionBy("o_custkey", F.col("l_partkey") % 20).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    whole = F.col("l_quantity").cast("long")
    out = rows.select(
        *keys, F.row_number().over(w).alias("i"), F.when(F.col("l_linenumber") != 5, F.concat(F.lit("lot "), whole % 3)).alias("raw_line"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("avg_cost"),
        F.when(F.col("l_linenumber") % 4 != 2, whole % 2 + 0.5).alias("price"), F.when(F.col("l_tax") > 0.01, F.col("l_quantity")).alias("book_value"), (F.col("l_quantity") * 2).alias("market_value"), (F.col("l_quantity") - 1).alias("unrealized_pnl"),
    )
    return lots.fold_lots(out, ["account_id", "instrument_id"], "i")


#: Tables and the columns that a rebuild must leave alike.
_CONTENT = {
    "transactions": ["row_id", "account_id", "currency", "trade_date", "txn_type", "cents"],
    "statements": ["account_id", "currency", "period_start", "period_end", "completeness"],
    "accounts": ["account_number", "currency"],
}


def _content_sql(name: str) -> str:
    source = "(SELECT *, CAST(net_amount * 100 AS BIGINT) AS cents FROM transactions)" if name == "transactions" else name
    text = ", ".join(f"""concat('{c}=', COALESCE('"' || replace(replace(CAST({c} AS VARCHAR), '\\', '\\\\'), '"', '\\"') || '"', 'null'))""" for c in sorted(_CONTENT[name]))
    parts = ", ".join(f"CAST(SUM(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS BIGINT)) AS VARCHAR)" for k in range(4))
    return f"SELECT '{name}' AS name, COUNT(*) AS n_rows, sha256(concat_ws('|', '{name}', CAST(COUNT(*) AS VARCHAR), {parts})) AS digest FROM (SELECT sha256(concat_ws(',', {text})) AS h FROM {source})"


@query(f"""WITH each AS ({" UNION ALL ".join(map(_content_sql, _CONTENT))})
SELECT * FROM each UNION ALL SELECT 'all', SUM(n_rows), sha256(string_agg(digest, '|' ORDER BY name)) FROM each""")
def table_fingerprints(t: Ledger) -> DataFrame:
    """Contents of the ledger's tables as digests that do not depend on the order of rows."""
    tables = {"transactions": t.transactions().withColumn("cents", (F.col("net_amount") * 100).cast("long")), "statements": t.statements(), "accounts": t.accounts()}
    return fingerprint.semantic({name: (tables[name], cols) for name, cols in _CONTENT.items()})


_GRAPH = """names AS (SELECT p_partkey AS k, CASE WHEN (p_partkey // 24) % 3 = 0 THEN 'USD' ELSE 'CAD' END AS currency FROM part),
 said AS (SELECT k, k AS a, k + 1 AS b, k * 10 + 1 AS seq, 'recorded' AS status FROM names WHERE k % 6 <> 5
  UNION ALL SELECT k, k, k + 2, k * 10 + 5, 'branches' FROM names WHERE k % 6 = 2 UNION ALL SELECT k, k, k - 5, k * 10 + 7, 'closes a ring' FROM names WHERE k % 12 = 5
  UNION ALL SELECT k, k, k + 1, k * 10 + 8, 'ratio is not positive' FROM names WHERE k % 12 = 11)"""


def _graph(t: Ledger) -> tuple[DataFrame, DataFrame]:
    """Changes and instruments made of parts: chains of six, told twice here and there, with branches, rings and faults."""
    k = F.col("p_partkey")
    parts = t.raw("part").select("p_partkey")
    kinds = parts.select(k.alias("instrument_id"), F.lit("equity").alias("asset_type"), F.when(F.floor(k / 24) % 3 == 0, "USD").otherwise("CAD").alias("currency"))
    told = [(k % 6 != 5, 1, 1, 0, 1.0, 0.5), (k % 6 == 1, 1, 2, 0, 2.0, 0.9), (k % 6 == 2, 2, 5, 1, 1.0, 0.5), (k % 12 == 5, -5, 7, 0, 1.0, 0.5), (k % 12 == 11, 1, 8, 0, 0.0, 0.5)]
    day = F.date_add(F.lit("2000-01-01").cast("date"), k.cast("int"))
    rows = [
        parts.filter(cond).select((k * 10 + n).alias("seq"), k.alias("from_id"), (k + step).alias("to_id"), F.date_add(day, more).alias("day"), F.lit(ratio).alias("ratio"), F.lit(sure).alias("confidence"))
        for cond, step, n, more, ratio, sure in told
    ]
    return reduce(DataFrame.unionByName, rows), kinds


@query(f"""WITH {_GRAPH}
SELECT s.seq, a AS from_id, b AS to_id, CASE WHEN s.status = 'recorded' AND s.k % 6 = 1 AND x.k IS NOT NULL THEN 2.0::DOUBLE WHEN s.status = 'ratio is not positive' THEN 0.0 ELSE 1.0 END AS ratio, CASE WHEN s.status = 'recorded' AND s.k % 6 = 1 AND x.k IS NOT NULL THEN 0.9::DOUBLE ELSE 0.5 END AS confidence,
 CASE WHEN x.k IS NULL THEN 'not two instruments' WHEN x.currency <> o.currency THEN 'type or currency differs' ELSE s.status END AS status FROM said s JOIN names o ON o.k = s.a LEFT JOIN names x ON x.k = s.b
UNION ALL SELECT k * 10 + 2, k, k + 1, 2.0, 0.9, 'not two instruments' FROM names n WHERE k % 6 = 1 AND NOT EXISTS (SELECT 1 FROM names x WHERE x.k = n.k + 1)""")
def ticker_changes(t: Ledger) -> DataFrame:
    """Ticker changes among parts: which are recorded, and why others are not."""
    return tickers.recorded(*_graph(t)).select("seq", "from_id", "to_id", "ratio", "confidence", "status")


_SYMBOL = "CASE WHEN (k // 12) % 2 = 0 THEN concat('t', k // 6) ELSE concat('tx', k // 12) END"


@query(f"""WITH {_GRAPH}, own AS (SELECT k, {_SYMBOL} AS symbol, CASE WHEN k % 6 > 0 THEN DATE '2000-01-01' + CAST(k - 1 AS INTEGER) END AS f, CASE WHEN k % 6 < 5 AND EXISTS (SELECT 1 FROM names x WHERE x.k = n.k + 1) THEN DATE '2000-01-01' + CAST(k AS INTEGER) END AS u FROM names n),
 apart AS (SELECT symbol, COUNT(DISTINCT k // 6) > 1 AS several FROM own GROUP BY 1)
SELECT upper(symbol) AS asked, k AS instrument_id, symbol, CASE WHEN NOT several THEN f END AS valid_from, CASE WHEN NOT several THEN u END AS valid_to FROM own JOIN apart USING (symbol)""")
def ticker_chains(t: Ledger) -> DataFrame:
    """The chain that each symbol belongs to, with the days of each instrument; symbols of several chains join nothing."""
    changes, kinds = _graph(t)
    edges = tickers.recorded(changes, kinds).filter("status = 'recorded'")
    return tickers.symbol_segments(edges, kinds.select("instrument_id", F.expr(_SYMBOL.replace("k // 12", "p_partkey div 12").replace("k // 6", "p_partkey div 6").replace("p_partkey", "instrument_id")).alias("symbol")))

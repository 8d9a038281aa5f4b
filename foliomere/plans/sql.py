"""The ledger tables in SQL, as common table expressions before each query's own SQL."""

PRELUDE = """
institutions AS (SELECT n_nationkey AS institution_id, n_name AS institution FROM nation),
accounts AS (SELECT c_custkey AS account_id, c_name AS account_number, c_nationkey AS institution_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'CAD' ELSE 'USD' END AS currency FROM customer),
instruments AS (SELECT p_partkey AS instrument_id, concat('S', p_partkey) AS symbol, p_name AS name, p_type AS sector,
  CASE p_size % 4 WHEN 0 THEN 'equity' WHEN 1 THEN 'etf' WHEN 2 THEN 'bond' ELSE 'mutual_fund' END AS asset_type
  FROM part WHERE p_partkey < 50),
typed AS (SELECT *, CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'buy' WHEN 'AO' THEN 'sell' WHEN 'NF' THEN 'transfer_in'
  WHEN 'NO' THEN 'dividend' WHEN 'RF' THEN 'journal' ELSE 'stock_split' END AS txn_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
transactions AS (SELECT o_custkey AS account_id, l_partkey % 50 AS instrument_id, CAST(o_orderdate AS DATE) AS trade_date,
  CAST(l_shipdate AS DATE) AS cash_effective_date, txn_type, l_quantity AS quantity,
  CAST(CAST(ROUND(l_extendedprice, 2) AS DECIMAL(18,2)) * CASE WHEN txn_type = 'buy' THEN -1 WHEN txn_type IN ('sell','dividend') THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS net_amount,
  concat_ws('-', 'transaction:', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
  CASE txn_type WHEN 'buy' THEN abs(l_quantity) WHEN 'transfer_in' THEN abs(l_quantity) WHEN 'sell' THEN -abs(l_quantity)
    WHEN 'journal' THEN l_quantity WHEN 'dividend' THEN 0 END AS position_delta,
  CASE WHEN (o_custkey + l_partkey % 50) % 2 = 0 THEN 'CAD' ELSE 'USD' END AS currency FROM typed),
statement_months AS (SELECT DISTINCT account_id, currency, CAST(date_trunc('month', trade_date) AS DATE) AS period_start FROM transactions),
statements AS (SELECT number AS statement_id, account_id, currency, period_start, last_day(period_start) AS period_end, CASE WHEN number % 11 = 0 THEN 'unknown' ELSE 'complete' END AS completeness
  FROM (SELECT *, (account_id * 1000 + (year(period_start) - 1990) * 12 + month(period_start)) * 2 + CASE WHEN currency = 'USD' THEN 1 ELSE 0 END AS number FROM statement_months)),
monthly_moves AS (SELECT account_id, currency, instrument_id, CAST(date_trunc('month', trade_date) AS DATE) AS m, SUM(COALESCE(position_delta, 0)) AS d
  FROM transactions GROUP BY ALL),
positions AS (SELECT s.statement_id, s.account_id, s.currency, s.period_start, s.period_end, s.completeness, v.instrument_id,
  SUM(v.d) + MAX(CASE WHEN s.statement_id % 7 = 0 THEN 1.0 ELSE 0.0 END) AS quantity
  FROM statements s JOIN monthly_moves v ON v.account_id = s.account_id AND v.currency = s.currency AND v.m <= s.period_start GROUP BY ALL),
prices AS (SELECT l_partkey % 50 AS instrument_id, CAST(l_shipdate AS DATE) AS trade_date,
  CAST(floor(CAST(SUM(CAST(ROUND(l_extendedprice, 2) AS DECIMAL(18,2))) AS DOUBLE) / SUM(l_quantity) * 100) AS BIGINT) AS close_cents,
  SUM(l_quantity) AS volume FROM lineitem GROUP BY ALL),
fx AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS rate_date, CAST(120 + dayofyear(CAST(o_orderdate AS DATE)) % 10 AS BIGINT) AS rate_cents FROM orders)
"""


def sql(body: str) -> str:
    """``body`` after the ledger tables; a body that begins with its own tables continues the list."""
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {PRELUDE}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {PRELUDE}, {body[5:]}"
    return f"WITH {PRELUDE} {body}"

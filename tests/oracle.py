"""Holds queries against their SQL on the driver's tables, as sorted rows."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if v is not None and type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows_of(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want, got = rows_of(cols, rel.fetchall()), rows_of(df.columns, df.collect())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(cols)} against {sorted(df.columns)}"
    if len(want) != len(got):
        return f"{len(want)} rows in SQL, {len(got)} in Spark"
    bad = [(w, g) for w, g in zip(want, got, strict=True) if w != g]
    return f"{len(bad)} of {len(want)} rows differ: {bad[:2]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con = connect(sf)
    names = sys.argv[2:] or list(e.oracle_sql())
    for n in names:
        t = time.time()
        try:
            said = compare(e.queries()[n](spark, sf), con, e.oracle_sql()[n])
        except Exception as x:
            said = f"{type(x).__name__} {str(x)[:500]}"
        print(n, round(time.time() - t, 1), said or "ok", flush=True)

"""Pairing of outgoing with incoming transfers: greedy, nearest date first, each used once.

Incoming rows of one account and day are one count: an outgoing row takes a partner only where it
is the single nearest one, so of two or more alike none is ever taken. The greedy choice depends on
order, so the rows of each key and size pass one task in order of time; a pass holds the counts of
2 * REACH + 1 days, looks at these alone for each row, and never holds a group. Rows of one key and
size are still one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 7


def pair_transfers(moves: DataFrame, keys: list[str]) -> DataFrame:
    """out_id, in_id, days, status of outgoing rows. ``moves``: keys, row_id, account_id, day, quantity (out < 0)."""
    rows = moves.filter(F.col("quantity") != 0).withColumn("size", F.bround(F.abs("quantity"), 8))
    rows = rows.select(F.to_json(F.struct(*keys, "size")).alias("g"), "row_id", F.col("account_id").cast("string").alias("account"), F.unix_date(F.col("day").cast("date")).alias("day"), "quantity")
    out = rows.filter("quantity < 0").select("g", "day", F.lit(1).alias("side"), "account", "row_id", F.lit(0).cast("long").alias("n"), F.col("day").alias("turn"))
    into = rows.filter("quantity > 0 and day is not null").groupBy("g", "day", "account").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))
    # incoming rows come REACH days early: an outgoing row meets all within its reach
    into = into.select("g", "day", F.lit(0).alias("side"), "account", "row_id", "n", (F.col("day") - REACH).alias("turn"))
    both = out.unionByName(into).repartition("g").sortWithinPartitions("g", "turn", "side", "row_id")
    return both.mapInPandas(greedy, "out_id string, in_id string, days int, status string")


def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Outgoing rows (side 1) with their partners; rows come by g, then turn."""
    group, free = None, {}  # day: {account: (id, count)}
    for b in batches:
        found = []
        for g, day, side, account, row, n in zip(b.g, b.day.astype("Int64"), b.side, b.account, b.row_id, b.n, strict=True):
            if g != group:
                group, free = g, {}
            if side == 0:
                free.setdefault(day, {})[account] = (row, n)
                continue
            if day is pd.NA:
                found.append((row, None, None, "unmatched"))
                continue
            for old in [d for d in free if d < day - REACH]:
                del free[old]
            found.append((row, *nearest(free, day, account)))
        yield pd.DataFrame(found, columns=["out_id", "in_id", "days", "status"]).astype({"days": "Int32"})


def nearest(free: dict, day: int, account: str | None) -> tuple:
    """Partner, distance and status of an outgoing row; a partner is taken out of ``free``."""
    for gap in range(REACH + 1):
        near = []
        for d in {day - gap, day + gap}:
            own = free.get(d, {})
            for a in own:
                if account is None or a != account:
                    near.append((d, a, *own[a]))
                    if len(near) > 1 or near[0][3] > 1:
                        return None, gap, "ambiguous"
        if near:
            d, a, row, _ = near[0]
            del free[d][a]
            return row, gap, "paired"
    return None, None, "unmatched"

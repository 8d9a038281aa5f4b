"""Rows that say the same thing twice: lots of one position, instruments under several ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_lots(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each position; ``rows``: keys, raw_line, quantity, price, book_value.

    Equal printed lines are one lot. Quantities add up; the book value is unknown if that of any
    lot is; a price stays only if all lots have it."""
    lots = rows.dropDuplicates([*keys, "raw_line"])
    one_price = F.max("price") - F.min("price") <= 1e-9
    return lots.groupBy(*keys).agg(
        F.count("*").alias("lots"),
        F.sum("quantity").alias("quantity"),
        F.when(F.count("book_value") == F.count("*"), F.sum("book_value")).alias("book_value"),
        F.when(one_price & (F.count("price") == F.count("*")), F.min("price")).alias("price"),
    )


#: Figures of a lot that are null in a position as soon as one lot lacks them.
_ADDED = ("book_value", "market_value", "unrealized_pnl")


def fold_lots(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each position out of its printed lots, taken in their order.

    ``rows``: keys, ``order``, raw_line, quantity, avg_cost, price, book_value, market_value, unrealized_pnl. A lot whose line equals
    all that has been taken in so far is a reprint and changes the price alone. Else quantities and figures add up (null as soon as one is), the
    average cost is unknown, and the line is put below those before. A price is that of either side or, within 1e-9, of
    both; where they differ it is unknown until a later lot has one. The lots of one position are folded in one row."""
    fields = ["quantity", "avg_cost", "price", *_ADDED, "raw_line"]
    lots = F.array_sort(F.collect_list(F.struct(order, *fields)))
    first = F.get("_lots", F.lit(0))
    kinds = {f: rows.schema[f].dataType for f in fields}

    def step(s: Column, r: Column) -> Column:
        text = lambda x: F.coalesce(x["raw_line"], F.lit(""))
        same = text(s) == text(r)
        price = F.when(s["price"].isNull(), r["price"]).when(r["price"].isNull() | (F.abs(s["price"] - r["price"]) <= 1e-9), s["price"])
        line = F.concat(F.coalesce(F.concat(s["raw_line"], F.lit("\n")), F.lit("")), text(r))
        new = {
            "quantity": F.when(same, s["quantity"]).otherwise(s["quantity"] + r["quantity"]), "avg_cost": F.when(same, s["avg_cost"]), "price": price,
            **{f: F.when(same, s[f]).otherwise(s[f] + r[f]) for f in _ADDED}, "raw_line": F.when(same, s["raw_line"]).otherwise(line),
        }
        return F.struct(*(new[f].cast(kinds[f]).alias(f) for f in fields))

    start = F.struct(*(first[f].cast(kinds[f]).alias(f) for f in fields))
    folded = F.aggregate(F.slice("_lots", 2, F.size("_lots")), start, step)
    out = rows.groupBy(*keys).agg(lots.alias("_lots")).select(*keys, F.size("_lots").alias("lots"), folded.alias("x"))
    return out.select(*keys, "lots", "x.*")


def oldest_ids(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Each id beside the smallest id that has the same keys, nulls being equal."""
    name = F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys))
    low = rows.groupBy(*keys).agg(F.min(id_col).alias("kept_id")).withColumn("_name", name)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = F.col("a._name") == F.col("b._name")
    for s in same:
        on = on & s
    return rows.withColumn("_name", name).alias("a").join(low.alias("b"), on).select(F.col(f"a.{id_col}").alias(id_col), "kept_id")

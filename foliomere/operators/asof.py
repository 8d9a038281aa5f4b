"""Latest-at-a-date, validity and interval joins.

As-of by one date is a filter and max_by, which combines before its exchange. As-of for many
dates is one union of both sides and a window per key, so no row is multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_at(rows: DataFrame, keys: list[str], date: str, values: list[str], at: Column) -> DataFrame:
    """The row of each key with the largest date not after ``at``."""
    best = F.max_by(F.struct(date, *values), F.struct(date, *values))
    return rows.filter(F.col(date) <= at).groupBy(*keys).agg(best.alias("x")).select(*keys, "x.*")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, values: list[str]) -> DataFrame:
    """Left rows with the values of the last right row at or before their date; null if none.

    Keys stay columns of their own, so what comes out is known to lie by them."""
    rest = [c for c in left.columns if c not in keys]
    l = left.withColumn("_t", F.col(left_date)).withColumn("_right", F.lit(False)).withColumn("_left", F.struct(*rest))
    l = l.select(*keys, "_t", "_right", "_left", F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    r = right.select(*keys, F.col(right_date).alias("_t"), F.lit(True).alias("_right"), F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_v"))
    # at equal times right rows come first
    order = Window.partitionBy(*keys).orderBy("_t", F.col("_right").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(order))
    return both.filter("not _right").select(*_beside(left, keys, "_left"), *(F.col(f"_v.{v}").alias(v) for v in values))


def _beside(rows: DataFrame, keys: list[str], packed: str) -> list[Column]:
    """The columns of ``rows`` in their order: keys as they stand, all others out of a struct."""
    return [F.col(c if c in keys else f"{packed}.{c}") for c in rows.columns]


def previous(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Adds columns of the row before within the keys: {new name: column}."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({new: F.lag(old).over(w) for new, old in columns.items()})


def assign_interval(moves: DataFrame, points: DataFrame, keys: list[str], move_date: str, point_date: str, value: str) -> DataFrame:
    """Moves with the first point at or after their date: prior < move <= point. Moves past the last are left out."""
    m = moves.withColumn("_t", F.col(move_date)).withColumn("_m", F.struct(*(c for c in moves.columns if c not in keys)))
    m = m.select(*keys, "_t", F.lit(0).alias("_o"), "_m", F.lit(None).cast(points.schema[value].dataType).alias(value))
    p = points.select(*keys, F.col(point_date).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(m.schema["_m"].dataType).alias("_m"), value)
    # backwards in time, so the frame only grows and each row is looked at once
    w = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)
    both = m.unionByName(p).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return both.filter(F.col("_m").isNotNull() & F.col(value).isNotNull()).select(*_beside(moves, keys, "_m"), value)

"""Keyed merges of new rows into kept ones, rebuilt as whole tables, and refreshes of market tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a column of a row that both tables have comes out.
TAKE_NEW, KEEP_SET, LARGEST, KEEP_OLD = "new", "set", "largest", "old"


def merged(kept: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Rows of both tables by key, one full outer join.

    ``rules``: column -> TAKE_NEW (the new value), KEEP_SET (the new value unless it is null),
    LARGEST (of the two) or KEEP_OLD (as it was; insert or ignore). Of equal keys in ``new`` one must be left."""
    old = kept.select(*keys, F.struct(*rules).alias("_o"))
    fresh = new.select(*keys, F.struct(*rules).alias("_n"))

    def value(c: str, rule: str) -> Column:
        o, n = F.col(f"_o.{c}"), F.col(f"_n.{c}")
        if rule == KEEP_SET:
            return F.coalesce(n, o)
        if rule == LARGEST:
            return F.greatest(o, n)
        first, other = (o, n) if rule == KEEP_OLD else (n, o)
        row = F.col("_o") if rule == KEEP_OLD else F.col("_n")
        return F.when(row.isNotNull(), first).otherwise(other)

    return old.join(fresh, keys, "full_outer").select(*keys, *(value(c, r).alias(c) for c, r in rules.items()))


def sticky_status(old: Column, new: Column, same: Column) -> Column:
    """A verified mapping stays verified as long as it names the same symbol."""
    return F.when((old == "verified") & same, old).otherwise(F.coalesce(new, old))


def replaced(kept: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """``new`` in place of all kept rows with the same ``by``: a delete and an insert, safe to repeat."""
    return kept.join(new.select(*by).distinct(), by, "left_anti").unionByName(new)


def fiscal(rows: DataFrame, day: str) -> DataFrame:
    """``rows`` with calendar fiscal_year and fiscal_q of a period's end."""
    return rows.withColumn("fiscal_year", F.year(day)).withColumn("fiscal_q", F.quarter(day))


def newest_owner(rows: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Of rows with equal keys the one of the highest rank (the latest symbol of a chain)."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(rank)).alias("v")).select(*keys, "v.*")


def unique_or_none(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value: the one value that a key has; null where it has several."""
    one = F.when(F.count_distinct(value) == 1, F.min(value))
    return rows.groupBy(*keys).agg(one.alias(value))


def company_facts(docs: DataFrame, forms: tuple[str, ...] = ("10-K", "10-Q")) -> DataFrame:
    """symbol, period_end, tag, value out of nested JSON (``facts``: taxonomy -> tag -> units -> rows); later filings win."""
    row = "struct<end:string,val:double,form:string,fp:string,filed:string>"
    kind = f"struct<facts:map<string,map<string,struct<units:map<string,array<{row}>>>>>>"
    tags = docs.select("symbol", F.explode(F.from_json("json", kind)["facts"]).alias("taxonomy", "tags")).select("symbol", F.explode("tags").alias("tag", "t"))
    rows = tags.select("symbol", "tag", F.explode("t.units").alias("unit", "rows")).select("symbol", "tag", F.explode("rows").alias("r"))
    rows = rows.filter(F.col("r.form").isin(*forms)).select("symbol", "tag", F.try_to_date("r.end").alias("period_end"), F.col("r.filed").alias("filed"), F.col("r.val").alias("value"), F.col("r.fp").alias("fp"))
    best = F.max_by(F.struct("value", "fp"), "filed").alias("v")
    return rows.filter("period_end is not null").groupBy("symbol", "period_end", "tag").agg(best).select("symbol", "period_end", "tag", "v.value", "v.fp")

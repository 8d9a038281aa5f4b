"""Content of tables as digests that do not depend on the order or the files of their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a row's digest that make one summand, and how many of these.
_DIGITS, _PARTS = 15, 4


def row_text(columns: list[str]) -> Column:
    """The columns as text with their names in order; null and empty differ, and no value can pass for a mark."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return F.concat_ws(",", *(F.concat(F.lit(f"{c}="), F.coalesce(quoted(c), F.lit("null"))) for c in sorted(columns)))


def content(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """One row: name, n_rows, digest. Rows count as often as they occur; sums of their digests' parts are added up in every task.

    Two tables have one digest if and (but for collisions of SHA-256) only if they hold the same rows."""
    sha = F.sha2(row_text(columns or df.columns), 256)
    parts = [F.conv(F.substring(sha, 1 + _DIGITS * k, _DIGITS), 16, 10).cast("decimal(38,0)") for k in range(_PARTS)]
    sums = df.select(*(p.alias(f"p{k}") for k, p in enumerate(parts))).agg(F.count("*").alias("n_rows"), *(F.coalesce(F.sum(f"p{k}"), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"p{k}") for k in range(_PARTS)))
    digest = F.sha2(F.concat_ws("|", F.lit(name), F.col("n_rows").cast("string"), *(F.col(f"p{k}") for k in range(_PARTS))), 256)
    return sums.select(F.lit(name).alias("name"), "n_rows", digest.alias("digest"))


def semantic(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """name, n_rows, digest of each table by the named columns, and of all of them together under "all".

    Columns that a rebuild may number anew (ids, times of a run) are left out by naming the others."""
    each = reduce(DataFrame.unionByName, (content(df, name, cols) for name, (df, cols) in sorted(tables.items())))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda x: x["digest"]), "|"), 256)  # one row for each table
    return each.unionByName(each.agg(F.lit("all").alias("name"), F.sum("n_rows").alias("n_rows"), whole.alias("digest")))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """name of the tables whose digests differ, or that one side lacks."""
    both = before.select("name", F.col("digest").alias("b")).join(after.select("name", F.col("digest").alias("a")), "name", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("name")

"""Cash of printed rows by the columns in which their figures stand.

Text alone loses empty cells, so a debit and a credit look alike. A page's header says where
its columns lie: figures are told by the centre of their box. A page without a header has no cash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomere.functions.text import parse_money

#: A figure as it stands alone in a cell.
_FIGURE = r"^\(?-?\$?[\d,]+(?:\.\d+)?\)?-?$"
#: Where no rate column is named, the cash columns begin so much of the way between debit and credit before the debit.
_BEFORE = 0.75


def _centre(x0: str, x1: str) -> Column:
    return (F.col(x0) + F.col(x1)) / 2


def column_edges(words: DataFrame) -> DataFrame:
    """relpath, page, cash_from, credit_from: the left edges of the cash and credit columns of each page.

    ``words``: relpath, page, line, text, x0, x1. The first line that names both a debit and a credit column is the
    header; of a word that it names twice the leftmost counts."""
    name = F.regexp_replace(F.upper("text"), r"^[\\/]+(?=RATE$)", "")
    named = words.select("relpath", "page", "line", name.alias("name"), "x0", _centre("x0", "x1").alias("at")).filter(F.col("name").isin("RATE", "DEBIT", "CREDIT"))
    first = lambda n: F.min_by("at", F.when(F.col("name") == n, F.col("x0"))).alias(n.lower())
    heads = named.groupBy("relpath", "page", "line").agg(first("RATE"), first("DEBIT"), first("CREDIT")).filter("debit is not null and credit is not null")
    head = heads.groupBy("relpath", "page").agg(F.min(F.struct("line", "rate", "debit", "credit")).alias("h")).select("relpath", "page", "h.*")
    start = F.coalesce((F.col("rate") + F.col("debit")) / 2, F.col("debit") - (F.col("credit") - F.col("debit")) * _BEFORE)
    return head.select("relpath", "page", start.alias("cash_from"), ((F.col("debit") + F.col("credit")) / 2).alias("credit_from"))


def cash_effects(words: DataFrame) -> DataFrame:
    """relpath, page, line, text, effect: credits less debits of each line with a figure, on pages with a header.

    Figures left of the cash columns (quantities, prices) count nothing, so a line of such figures alone has an effect of 0."""
    figure = F.regexp_like("text", F.lit(_FIGURE))
    # a page's header is one row
    placed = words.join(column_edges(words), ["relpath", "page"])
    amount = F.abs(parse_money(F.col("text")))
    at = _centre("x0", "x1")
    signed = F.when(figure & (at >= F.col("cash_from")), F.when(at < F.col("credit_from"), -amount).otherwise(amount))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")  # the words of one line
    lines = placed.groupBy("relpath", "page", "line").agg(text.alias("text"), F.round(F.coalesce(F.sum(signed), F.lit(0)), 2).cast("decimal(18,2)").alias("effect"), F.bool_or(figure).alias("has_figure"))
    return lines.filter("has_figure").drop("has_figure")


def with_effects(rows: DataFrame, effects: DataFrame, tasks: int | None = None) -> DataFrame:
    """``rows`` (relpath, page, line, text and others) with the effect of their line; null where none is left.

    Equal texts of a document take their effects one after another, in the order of pages and lines on both sides.
    ``tasks``: how many tasks they are dealt to; by default Spark's own number."""
    key = F.upper(F.trim(F.regexp_replace("text", r"\s+", " ")))
    nth = F.row_number().over(Window.partitionBy("relpath", "_key").orderBy("page", "line"))

    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(tasks, *keys) if tasks else df

    def numbered(df: DataFrame) -> DataFrame:
        return dealt(dealt(df.withColumn("_key", key), "relpath", "_key").withColumn("_nth", nth), "relpath", "_key", "_nth")

    theirs = numbered(effects).select("relpath", "_key", "_nth", "effect")
    return numbered(rows).join(theirs, ["relpath", "_key", "_nth"], "left").drop("_key", "_nth")

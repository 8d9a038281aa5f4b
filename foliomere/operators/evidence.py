"""Printed lines behind rows: numbered lines, where a row's text stands, coverage, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomere.functions.names import plain_line

from .locator import contained


def page_offsets(pages: DataFrame) -> DataFrame:
    """relpath, page, first, last: the places that each page's characters take in the joined text, one between pages."""
    n = F.length("text")
    before = F.sum(n + 1).over(Window.partitionBy("relpath").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce(before, F.lit(0))
    return pages.select("relpath", "page", first.alias("first"), (first + n).alias("last"))


def pages_of(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """relpath, span_id, pages: the pages that a range of characters touches."""
    on = (F.col("s.relpath") == F.col("o.relpath")) & (F.col("s.first") < F.col("o.last")) & (F.col("s.last") > F.col("o.first"))
    rows = spans.alias("s").join(offsets.alias("o"), on)
    return rows.groupBy("s.relpath", "s.span_id").agg(F.array_sort(F.collect_set("o.page")).alias("pages"))


def located(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """row_id, page, line, method of each row's text among a document's lines.

    ``rows``: relpath, row_id, raw, page_hint, line_hint (or null); ``lines``: relpath, page, line, text. Equal lines
    come first: that of both hints, that of the page, or the only one. Else the only line that holds
    the text, of 12 characters and 3 words at least. Several are ambiguous, none is unmatched."""
    asked = rows.select("relpath", "row_id", plain_line(F.col("raw")).alias("t"), "page_hint", "line_hint")
    shown = lines.select("relpath", "page", "line", plain_line(F.col("text")).alias("s"))
    same = asked.join(shown, (asked["relpath"] == shown["relpath"]) & (F.col("t") == F.col("s"))).select("row_id", "page", "line", "page_hint", "line_hint")
    on_page = F.coalesce(F.col("page") == F.col("page_hint"), F.lit(False))
    rank = F.when(on_page & F.coalesce(F.col("line") == F.col("line_hint"), F.lit(False)), 0).when(on_page, 1).otherwise(2)
    same = same.withColumn("rank", rank).withColumn("top", F.min("rank").over(Window.partitionBy("row_id"))).filter("rank = top")
    exact = same.groupBy("row_id").agg(F.count("*").alias("n"), F.min(F.struct("page", "line")).alias("at")).withColumn("method", F.lit("exact"))
    left = asked.join(exact.select("row_id"), "row_id", "left_anti").filter((F.length("t") >= 12) & (F.size(F.split("t", " ")) >= 3))
    pairs = contained(left.select("relpath", F.col("t").alias("s")).distinct(), shown.select("relpath", F.col("s").alias("t")).distinct(), "relpath")
    on = pairs.select("relpath", F.col("s").alias("t"), F.col("t").alias("s"))
    inside = left.join(on, ["relpath", "t"]).join(shown, ["relpath", "s"])
    held = inside.groupBy("row_id").agg(F.count("*").alias("n"), F.min(F.struct("page", "line")).alias("at")).withColumn("method", F.lit("contained"))
    found = exact.unionByName(held)
    one = F.col("n") == 1
    method = F.when(F.col("n").isNull(), "unmatched").when(one, F.col("method")).otherwise("ambiguous")
    out = asked.select("row_id").join(found, "row_id", "left")
    return out.select("row_id", F.when(one, F.col("at.page")).alias("page"), F.when(one, F.col("at.line")).alias("line"), method.alias("method"))


def coverage(lines: DataFrame, used: DataFrame) -> DataFrame:
    """relpath, lines, matched: how many of a document's lines some row accounts for.

    A line counts if it stands in a row's text, or holds one of more than 12 characters."""
    shown = lines.select("relpath", plain_line(F.col("text")).alias("s")).filter("s != ''")
    each = shown.groupBy("relpath", "s").agg(F.count("*").alias("n"))
    rows = used.select("relpath", plain_line(F.col("raw")).alias("t")).filter("t != ''").distinct()
    texts = each.select("relpath", "s")
    held = contained(texts, rows, "relpath").select("relpath", "s")
    holds = contained(rows.filter(F.length("t") > 12).withColumnRenamed("t", "s"), texts.withColumnRenamed("s", "t"), "relpath").select("relpath", F.col("t").alias("s"))
    met = held.union(holds).distinct().withColumn("hit", F.lit(True))
    return each.join(met, ["relpath", "s"], "left").groupBy("relpath").agg(F.sum("n").alias("lines"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("matched"))


def subsequence_at(needle: Column, hay: Column) -> Column:
    """First place (from 0) at which the tokens of one array stand in another; null if nowhere."""
    last = F.size(hay) - F.size(needle)
    places = F.when((last >= 0) & (F.size(needle) > 0), F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(places, lambda k: F.slice(hay, k + 1, F.size(needle)) == needle), F.lit(0))


def union_box(words: Column, first: Column, count: Column) -> Column:
    """struct<x0, top, x1, bottom> around some of a line's words (structs with these fields); null without words."""
    some = F.slice(words, first + 1, count)
    side = lambda pick, k: pick(F.transform(some, lambda w: w[k])).alias(k)
    box = F.struct(side(F.array_min, "x0"), side(F.array_min, "top"), side(F.array_max, "x1"), side(F.array_max, "bottom"))
    return F.when(F.size(some) > 0, box)

"""JSON lines in a fixed order, statement dumps, market tables by symbol, an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_index(rows: DataFrame, folder: str, order: list[str], hidden: tuple[str, ...] = ()) -> None:
    """One JSON object a line, ordered over all part files; ``hidden`` columns are shown as digests only."""
    shown = [F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 16).alias(f"{c}_ref") if c in hidden else F.col(c) for c in sorted(rows.columns)]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(folder)


def sampled(docs: DataFrame, by: str, order: str, most: int = 3) -> DataFrame:
    """The first, middle and last document of each folder, as far as ``most`` allows."""
    w = Window.partitionBy(by)
    rows = docs.withColumn("_k", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    picks = F.slice(F.array_distinct(F.array(F.lit(0), F.floor(F.col("_n") / 2).cast("int"), F.col("_n").cast("int") - 1)), 1, most)
    return rows.filter(F.array_contains(picks, F.col("_k"))).drop("_k", "_n")


def write_dumps(docs: DataFrame, folder: str, mark: str) -> None:
    """Each document's pages as one text, joined by the marker line, a folder for each relpath."""
    text = F.array_join("pages", f"\n{mark}\n").alias("value")
    docs.select("relpath", text).write.mode("overwrite").partitionBy("relpath").text(folder)


def write_market(rows: DataFrame, folder: str, by: str = "symbol") -> None:
    """Partitions of the symbols at hand are replaced, others stay: safe to repeat."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)


def append_log(rows: DataFrame, folder: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(folder)

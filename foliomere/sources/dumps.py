"""Statement text dumps: one file a document, pages split by a marker line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "----- PAGE BREAK -----"


def read_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """relpath, sha256, size_bytes, pages of every .txt below a folder; lines of the first page that begin with '# ' are dropped."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(folder)
    pages = F.split(F.decode("content", "UTF-8"), r"\r?\n?" + MARK + r"\r?\n?", -1)
    kept = F.transform(pages, lambda p, i: F.when(i == 0, F.array_join(F.filter(F.split(p, "\n", -1), lambda x: ~F.startswith(x, F.lit("# "))), "\n")).otherwise(p))
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("relpath"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), kept.alias("pages"))


def page_lines(docs: DataFrame) -> DataFrame:
    """relpath, page, line, text of non-blank lines; numbers count from 1 and blanks too."""
    rows = docs.select("relpath", F.posexplode("pages").alias("page", "p"))
    rows = rows.select("relpath", (F.col("page") + 1).alias("page"), F.posexplode(F.split("p", "\n", -1)).alias("line", "text"))
    return rows.filter(F.trim("text") != "").withColumn("line", F.col("line") + 1)


def image_only(docs: DataFrame) -> DataFrame:
    """Documents whose pages hold less than 20 characters of text."""
    return docs.filter(F.length(F.trim(F.array_join("pages", ""))) < 20)

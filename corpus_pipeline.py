"""A training corpus in five stages, each over what the one before has kept.

Every stage takes rows with null ids or texts, repeated rows and an empty table; columns beside
those of documents are left behind at the first stage. Null and empty texts count as documents
without words: no stage removes them for that, and packing gives each its end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliomere.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from foliomere.llm.common import stage_table, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the labels of rows that are still there train it.

    Repeated rows fare alike; without labels of both kinds all stay (or go, if all labels are toxic)."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line matches. n_chars follows the text.

    Earlier is by id, then by a hash of the text; of equal lines the first stays. A document may be left with no text."""
    from pyspark.sql import functions as F

    out = line_dedup.deduped(docs.select(*COLUMNS))
    n = F.when(F.size("_gone") > 0, F.length("_row.text").cast("long")).otherwise(F.col("_row.n_chars"))
    return out.select("_row.*", n.alias("_n")).withColumn("n_chars", F.col("_n")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id; repeated rows of it stay together.

    Documents without words are in no group, so all of them stay."""
    return near_dup.keep_first(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item; of rows with one id all go if one overlaps. Without items all stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; repeated rows are packed each."""
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL cannot express the learned scores of the first stage; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

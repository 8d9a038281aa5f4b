"""Exact duplicates by two passes over hashes and a blocked Bloom filter.

The first pass reads the texts once and writes id, digest and a 64-bit hash of each row. Hashes
are counted, in each task before any exchange, and those met twice or more set their bits in a
Bloom filter of blocks of BLOCK_BITS bits. The second pass looks every hash up in it. What the filter does
not hold is unique and goes straight through; only the rest is shuffled by its digest, and there
the digest decides, so a false positive costs a row's way and changes nothing.

Edge cases: a null text counts as empty, and empty texts are equal; of rows with one id and one
text one stays, and a null id is the smallest; an empty table gives no rows; other columns are
passed over by the report and kept by ``dedup``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, scratch, stage_table, whole_text

#: Bits of a block (its probes are 12 bits each), bits set for a hash, and bits that the filter has for each.
BLOCK_BITS, PROBES, BITS_EACH = 4096, 4, 16
#: Blocks that may be broadcast, 64 MB of bits for 33 million repeated hashes; more are joined by a shuffle of hashes.
BROADCAST_BLOCKS = 2**17


def digest(text: str = "text") -> Column:
    """Lowercase hex SHA-256 of the text in UTF-8."""
    return F.sha2(whole_text(text), 256)


def places(h: Column) -> list[Column]:
    """Where a hash has its bits in its block."""
    mixed = F.xxhash64(h, F.lit(1))
    return [F.shiftrightunsigned(mixed, 12 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(PROBES)]


def block(h: Column, n_blocks: int) -> Column:
    return F.pmod(h, F.lit(n_blocks)).alias("block")


def bloom_filter(hashes: DataFrame) -> tuple[DataFrame, int]:
    """The filter of the hashes ``h`` that occur twice or more (block, words) and its number of blocks."""
    again = stage_table(hashes.groupBy("h").count().filter("count > 1").select("h"), "repeated-hashes")
    n_blocks = max(1, math.ceil(again.count() * BITS_EACH / BLOCK_BITS))
    at = again.select(block(F.col("h"), n_blocks), F.explode(F.array(*places(F.col("h")))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)))
    held = at.groupBy("block", F.shiftright("p", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    by_word = held.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))  # BLOCK_BITS / 64 entries at most
    words = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long")))
    return stage_table(by_word.select("block", words.alias("words")), "bloom-filter"), n_blocks


def marked(rows: DataFrame, bloom: tuple[DataFrame, int]) -> DataFrame:
    """``rows`` with _again: whether the filter holds their hash ``h``."""
    blocks, n_blocks = bloom
    side = F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else blocks
    met = rows.withColumn("_b", block(F.col("h"), n_blocks)).join(side.withColumnsRenamed({"block": "_b", "words": "_words"}), "_b", "left")
    bits = [F.call_function("getbit", F.get("_words", F.shiftright(p, 6)), p.bitwiseAND(F.lit(63))) == 1 for p in places(F.col("h"))]
    found = bits[0]
    for b in bits[1:]:
        found &= b
    return met.withColumn("_again", F.coalesce(found, F.lit(False))).drop("_b", "_words")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, h, _n: the narrow table that both passes read; _n tells rows apart."""
    rows = docs.select("doc_id", digest().alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256"))
    return stage_table(rows.withColumn("_n", F.monotonically_increasing_id()), "digests")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    with scratch(docs.sparkSession, "exact-dedup"):
        rows = digests(docs)
        bloom = bloom_filter(rows)
        split = stage_table(marked(rows, bloom).drop("h"), "digests-marked", keep=True)
    once, again = split.filter("not _again"), split.filter("_again").drop("_again")
    groups = again.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "_n")).alias("_k"), F.count("*").alias("group_size"))
    met = join_groups(again, groups, ["text_sha256"], "group_size")
    one = F.lit(1).cast("long")
    through = once.select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return through.union(met.select("doc_id", F.col("_k.doc_id").alias("keep_id"), "group_size", (F.col("_n") == F.col("_k._n")).alias("kept"), "text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each text, that with the largest doc_id (any one of those that share it).

    Rows whose hash the filter does not hold are passed on as they are read."""
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), digest().alias("_sha")).withColumn("h", F.xxhash64("_sha"))
    with scratch(docs.sparkSession, "exact-dedup"):
        blocks, n_blocks = bloom_filter(keyed.select("h"))
        blocks = stage_table(blocks, "bloom-filter", keep=True)
    seen = marked(keyed, (blocks, n_blocks))
    one = seen.filter("_again").groupBy("_sha").agg(F.max_by("_row", F.struct("_id")).alias("_row"))
    return seen.filter("not _again").select("_row.*").union(one.select("_row.*"))

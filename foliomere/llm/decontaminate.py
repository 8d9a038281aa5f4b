"""Benchmark decontamination by spaced seeds.

A mask such as 1101 looks at some token places and ignores the others, so a substitution at an
ignored place leaves the hash as it was. Every window of every test item and of every document
is hashed under a few fixed masks and joined; around each hit the aligned tokens are compared
in every window that holds the hit, and a hit counts if enough of a window agree.

The masks are sets that leave no gap: however the tolerated substitutions lie in a window (or
in an item shorter than one), some mask fits between them. Items are seeded by the set of their
length, so short ones have lighter masks; documents are hashed under the masks that the test
set's items ask for.

The test set is the stated query side. It is split into blocks by a count of its windows, so
what a task holds of it is bounded; documents are never shuffled.

Edge cases: null and empty texts have no windows and are clean; of an item of three tokens or
fewer all must agree; repeated rows and items give one pair; null ids form a pair of their own;
extra columns are passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text, without_rows, words

#: Tokens compared around a hit (the item's length if shorter), and the share that must agree.
WINDOW, PERCENT = 16, 75
#: Masks of items that have so many tokens at least. 16 tokens with 4 substituted and 15 with 3 share a set.
MASKS = {
    15: ("111011", "1100001011", "111000010001"),
    12: ("111011", "110100011", "11001011", "110111"),
    9: ("11101", "100111"),
    8: ("111", "1101"),
    7: ("11011",),
    6: ("111",),
    4: ("11",),
    3: ("111",),
    2: ("11",),
    1: ("1",),
}
#: Tokens on either side of a hit that a window with it can hold.
REACH = WINDOW - 1
#: Windows of the test set that one block may hold, about 50 MB.
BLOCK_WINDOWS = 100_000


def tokens(text: Column) -> Column:
    return words(F.lower(text))


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of n tokens."""
    return next((m for least, m in MASKS.items() if n >= least), ())


def asked_masks(items: DataFrame) -> list[str]:
    """Every mask that some item (its length is ``n``) has."""
    lengths = items.filter("n > 0").select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect()  # WINDOW rows at most
    return sorted({m for r in lengths for m in masks_of(r["n"])})


def _seeds(ws: Column, p: Column, n: Column, masks: list[str], own: bool = False) -> Column:
    """Hashes of the window at ``p`` under each mask it fits (and that an item of n tokens has, if ``own``), with the mask mixed in."""
    out = []
    for mask in masks:
        taken = [F.get(ws, p + i) for i, c in enumerate(mask) if c == "1"]
        fits = p + len(mask) <= n
        if own:
            fits &= F.least(n, F.lit(WINDOW)).isin([k for k in range(1, WINDOW + 1) if mask in masks_of(k)])
        out.append(F.when(fits, F.xxhash64(F.lit(mask), *taken)))
    return F.array(*out)


def places(n: Column, masks: list[str]) -> Column:
    """Where a window of the shortest mask can begin among n tokens; null if nowhere."""
    last = n - min(map(len, masks))
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))


def surroundings(ws: Column, p: Column) -> Column:
    """The token at ``p`` with up to REACH on either side: ``p`` has the place least(p, REACH) in it."""
    return F.slice(ws, F.greatest(p - REACH, F.lit(0)) + 1, F.least(p, F.lit(REACH)) + 1 + REACH)


def item_windows(items: DataFrame, masks: list[str]) -> DataFrame:
    """seed, item_id, q, n_item, around: the windows of the items under each mask; q is the place in ``around``.

    Windows of an item that look alike as far as they reach (as in repeated words) are one."""
    rows = items.select("*", F.explode(places(F.col("n"), masks)).alias("q"))
    seeds = _seeds(F.col("ws"), F.col("q"), F.col("n"), masks, own=True)
    around = surroundings(F.col("ws"), F.col("q")).alias("around")
    rows = rows.select("item_id", F.least("q", F.lit(REACH)).alias("q"), F.col("n").alias("n_item"), around, F.explode(seeds).alias("seed"))
    return rows.filter("seed is not null").distinct()


def agreeing(near: Column, p: Column, around: Column, q: Column) -> Column:
    """Most tokens that agree in a window that holds the hit.

    Places outside either text agree nowhere, so windows that leave the item never count more."""

    def bit(acc: Column, k: Column) -> Column:
        same = F.get(near, F.least(p, F.lit(REACH)) + k) == F.get(around, q + k)
        return acc.bitwiseOR(F.when(same, F.call_function("shiftleft", F.lit(1).cast("long"), k + REACH)).otherwise(F.lit(0).cast("long")))

    bits = F.aggregate(F.sequence(F.lit(-REACH), F.lit(REACH)), F.lit(0).cast("long"), bit)
    most = lambda b: F.greatest(*(F.bit_count(F.shiftright(b, k).bitwiseAND(F.lit(2**WINDOW - 1).cast("long"))) for k in range(WINDOW)))
    return F.get(F.transform(F.array(bits), most), F.lit(0))


def row_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, _r, item_id, agreeing: each row (told by its id and its text's hash) and item that overlap, and the most tokens that agree."""
    items = benchmark.select("item_id", tokens(whole_text()).alias("ws")).withColumn("n", F.size("ws"))
    masks = asked_masks(items) or ["1"]  # any mask will do where no item has a token
    windows = item_windows(items, masks)
    blocks = max(1, math.ceil(windows.count() / BLOCK_WINDOWS))
    own = F.xxhash64(whole_text()).alias("_r")
    rows = docs.select("doc_id", own, tokens(whole_text()).alias("ws")).withColumn("n", F.size("ws"))
    at = rows.select("doc_id", "_r", "ws", "n", F.explode(places(F.col("n"), masks)).alias("p"))
    seeded = at.select("doc_id", "_r", "ws", "p", F.explode(_seeds(F.col("ws"), F.col("p"), F.col("n"), masks)).alias("seed"))
    width = F.least(F.lit(WINDOW), F.col("n_item"))
    out = None
    for k in range(blocks):
        # whole rows are dealt out, so a seed of many items is spread too
        block = windows.filter(F.pmod(F.xxhash64("seed", "item_id", "around"), F.lit(blocks)) == k)
        hits = seeded.join(F.broadcast(block), "seed")  # at most about BLOCK_WINDOWS rows, by the count above
        # a hit takes along its surroundings, not the whole text
        near = surroundings(F.col("ws"), F.col("p"))
        # within a run of one token, a place that looks as the one before it tells nothing new
        alike = (F.col("p") > REACH) & (near == surroundings(F.col("ws"), F.col("p") - 1))
        hits = hits.filter(~alike)
        hits = hits.select("doc_id", "_r", "item_id", "p", "q", "n_item", "around", F.explode(F.array(near)).alias("near"))
        hits = hits.withColumn("agreeing", agreeing(F.col("near"), F.col("p"), F.col("around"), F.col("q")))
        good = hits.filter(100 * F.col("agreeing") >= PERCENT * width).select("doc_id", "_r", "item_id", "agreeing")
        out = good if out is None else out.union(good)
    return out.groupBy("doc_id", "_r", "item_id").agg(F.max("agreeing").alias("agreeing"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, agreeing: each document and item that overlap, and the most tokens that agree."""
    return row_overlaps(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("agreeing").alias("agreeing"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with all their columns; rows that share an id with one that does stay."""
    return without_rows(docs, row_overlaps(docs, benchmark).select(F.col("doc_id").cast("long").alias("_id"), "_r"))

"""Ranked lexical search by windowed bucket scoring.

Documents become postings of the terms that items ask for, one narrow row each, dealt out by ranges
of doc_id. A task walks its postings in windows of WINDOW ids: for each item the impacts of
its terms are scatter-added into one array of SLOTS numbers that fits a cache, a bit for each slot tells which were touched, and
what was touched is harvested into the item's heap. A heap lives as long as its task, so a
task returns ``top`` rows for each item, and these are merged by rank in two steps.

Items are the stated query side. They are taken in blocks of a bounded number of terms, so what a
task holds of them does not grow; any number of blocks gives the same rows.

Edge cases: a null or empty text has no terms and is not counted; a null doc_id ranks before all others on
equal scores; rows that share a doc_id are documents of their own (ties among them in any order); an item without
terms, or whose terms no document holds, has no rows; items of one id and one text are one, those of one id
and different texts are ranked each; other columns are passed over.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stage_table, whole_text

#: Results of an item, ids of a window, and slots of the score array (256 KB); a window of repeated ids takes several arrays.
TOP, WINDOW, SLOTS = 50, 2**15, 2**15
#: Terms, repeats over items included, that a block of items may have.
BLOCK_TERMS = 200_000
_NULL = -(2**63)
#: UTF-8 bytes: A-Z to lower case, other ASCII characters that are no letters or digits to spaces.
_FOLD = bytes(b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 or chr(b).isdigit() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split()


def item_blocks(items: DataFrame, terms_per_block: int) -> list[DataFrame]:
    """Items (item_id, text) once each, dealt into blocks by a bound on their terms."""
    once = items.select("item_id", whole_text().alias("text")).distinct()
    # a term takes a character and a separator at least
    n = math.ceil((once.agg(F.sum(F.ceil((F.length("text") + 1) / 2))).first()[0] or 0) / terms_per_block)
    return [once.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms, times (of those asked for) of every document with a term."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)  # BLOCK_TERMS at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ns, terms, times = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                found = terms_of(text.as_py())
                held = [(known[t], c) for t, c in Counter(found).items() if t in known]
                ns.append(len(found))
                terms.append([t for t, _ in held])
                times.append([c for _, c in held])
            columns = [batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<int>").filter("n > 0")


def weight(n_docs: int, df: int) -> int:
    """Of a term that df of n_docs documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Scorer:
    """Items over windows of postings: one score array, one bitset, a heap for each item."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, top: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.top = items, weights, n_docs, n_terms, top
        self.asking = defaultdict(list)  # term: items
        for k, terms in enumerate(items):
            for t in terms:
                self.asking[t].append(k)
        self.scores = np.zeros(SLOTS, dtype=np.int64)
        self.touched = np.zeros(SLOTS, dtype=bool)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in items]

    def window(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        """Up to SLOTS documents: ids in order, terms in all, and their postings end to end."""
        m = 50 + (50 * lengths * self.n_docs) // self.n_terms
        slots = np.repeat(np.arange(len(ids)), sizes)
        impacts = self.weights[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * m[slots]))
        order = np.argsort(terms, kind="stable")
        held, starts = np.unique(terms[order], return_index=True)
        lists = {t: (slots[own], impacts[own]) for t, own in zip(held.tolist(), np.split(order, starts[1:]))}
        for k in sorted({k for t in lists for k in self.asking[t]}):
            for t in self.items[k]:
                if t in lists:
                    at, impact = lists[t]
                    self.scores[at] += impact  # a document is in a term's list once
                    self.touched[at] = True
            self.harvest(k, ids)

    def harvest(self, k: int, ids: np.ndarray) -> None:
        """Takes what was touched into the item's heap and clears it."""
        at = np.flatnonzero(self.touched[: len(ids)])
        scores, heap = self.scores[at], self.heaps[k]
        self.scores[at] = 0
        self.touched[at] = False
        least = heap[0][0] if len(heap) == self.top else 1
        good = scores >= least
        at, scores = at[good], scores[good]
        if len(at) > self.top:  # slots are in the order of ids, so a stable sort settles ties
            best = np.argsort(-scores, kind="stable")[: self.top]
            at, scores = at[best], scores[best]
        for score, i in zip(scores.tolist(), ids[at].tolist()):
            if len(heap) < self.top:
                heapq.heappush(heap, (score, -i))
            elif (score, -i) > heap[0]:
                heapq.heapreplace(heap, (score, -i))


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def window_scores(rows: DataFrame, items: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item (its place in ``items``), doc_id, score: the best ``top`` of each task; rows lie in the order of doc_id in each."""
    sent = rows.sparkSession.sparkContext.broadcast((items, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_items, own_weights = sent.value
        scorer = Scorer(own_items, own_weights, n_docs, n_terms, top)
        held: list[tuple] = []  # slices of the window that is being read
        n, now = 0, None

        def close() -> None:
            if held:
                scorer.window(*(np.concatenate(x) for x in zip(*held)))

        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NULL).to_numpy()
            lengths = batch.column("n").to_numpy()
            sizes = batch.column("terms").value_lengths().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            terms, times = _flat(batch.column("terms"), np.int64), _flat(batch.column("times"), np.int64)
            windows = ids // WINDOW
            cuts = [0, *(np.flatnonzero(np.diff(windows)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                while lo < hi:
                    if windows[lo] != now or n == SLOTS:
                        close()
                        held, n, now = [], 0, windows[lo]
                    take = min(hi - lo, SLOTS - n)
                    part = slice(ends[lo], ends[lo + take])
                    held.append((ids[lo : lo + take], lengths[lo : lo + take], sizes[lo : lo + take], terms[part], times[part]))
                    n, lo = n + take, lo + take
        close()
        found = [(k, None if -i == _NULL else -i, s) for k, heap in enumerate(scorer.heaps) for s, i in heap]
        columns = zip(*found) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return rows.mapInArrow(score, "item int, doc_id long, score long")


def merged(found: DataFrame, key: str, top: int) -> DataFrame:
    """rank, and only the best ``top`` of each key: first within shares of its rows, then over these."""
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    share = F.pmod(F.xxhash64("doc_id"), F.lit(32)).alias("_share")
    some = found.select("*", share).withColumn("rank", F.row_number().over(Window.partitionBy(key, "_share").orderBy(*best))).filter(F.col("rank") <= top)
    return some.drop("_share").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*best))).filter(F.col("rank") <= top)


def block_search(docs: DataFrame, block: DataFrame, top: int) -> DataFrame:
    """item_id, rank, doc_id, score for one block of items."""
    spark = docs.sparkSession
    items = block.collect()  # BLOCK_TERMS terms at most
    distinct = [list(dict.fromkeys(terms_of(r["text"].encode()))) for r in items]
    numbers = {t: i for i, t in enumerate(dict.fromkeys(t for ts in distinct for t in ts))}
    asked = [[numbers[t] for t in ts] for ts in distinct]
    rows = stage_table(postings(docs, numbers), "postings")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # one row for each term of the block
    weights = np.zeros(max(1, len(numbers)), dtype=np.int64)
    for r in held:
        weights[r["t"]] = weight(n_docs, r["count"])
    # equal ids are dealt to several tasks by what else is in the row
    spread: Column = F.xxhash64("n", "terms", "times", F.spark_partition_id()).alias("_s")
    dealt = rows.filter(F.size("terms") > 0).select("*", spread).repartitionByRange("doc_id", "_s").sortWithinPartitions("doc_id").drop("_s")
    found = merged(window_scores(dealt, asked, weights, n_docs, n_terms, top), "item", top)
    keys = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], f"item int, item_id {block.schema['item_id'].dataType.simpleString()}")
    return found.join(F.broadcast(keys), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, terms_per_block: int = BLOCK_TERMS) -> DataFrame:
    """The ``top`` documents of each item by descending score, equal scores by ascending doc_id."""
    out = None
    with scratch(docs.sparkSession, "lexical-search"):
        for block in item_blocks(items, terms_per_block):
            found = stage_table(block_search(docs, block, top), "search-results", keep=True)
            out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return out

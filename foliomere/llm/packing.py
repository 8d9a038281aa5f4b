"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

The driver sees one count for each length, at most ``capacity`` of them. It packs counts by
best fit, longest first, and returns runs of slots. Pieces are ranked within their length and
join the slots on (length, rank), so each takes one place.

Edge cases: a null text is empty and has the end id alone; null and repeated ids keep a row
for each piece; texts longer than a sequence are cut, shorter ones never; an empty table gives
no rows; other columns are passed over.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table, whole_text
from .tokens import encoder, vocabulary

CAPACITY = 2048
#: Slots that one row of the plan unfolds to in a task.
RUN = 10_000


def pieces(docs: DataFrame, vocab: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, by_chunk: bool | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of each text."""
    by_chunk = vocab is None if by_chunk is None else by_chunk
    vocab = vocab or vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(vocab, by_chunk), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for k in range(0, len(b), 500):
                rows = []
                part = b.iloc[k : k + 500]
                for doc, ids in zip(part["doc_id"].tolist(), encode(part["_t"].tolist()), strict=True):
                    ids += end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        row = [doc, i, at // 4, len(own) // 4, zlib.crc32(own)]
                        rows.append(row + [np.frombuffer(own, "<u4").astype(np.int64)] * with_ids)
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("_t")).mapInPandas(cut, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: rows (length, rank, count, sequence, each, offset).

    Ranks rank.. of a length go to sequences from ``sequence`` on, ``each`` to a sequence, the
    first at ``offset``. Sequences with equal room are handled as one group, so the work depends
    on the number of lengths, not of documents."""
    rows = []
    rooms: list[int] = []  # sorted rooms that some group has
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)
    n_sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room = capacity
                first, n = n_sequences, -(-left // (capacity // length))
                n_sequences += n
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # the last sequence takes fewer
                rows.append((length, rank, left, first + full, each, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece, start and length.

    ``cut`` should be a written table: it is read for the histogram and for the places."""
    spark = cut.sparkSession
    sized = cut.groupBy("length").count()
    counts = {r["length"]: r["count"] for r in sized.collect()}  # one row for each length
    n = sum(counts.values())
    runs = plan(counts, capacity)
    # a length may hold any share of the rows, so it is ranked in buckets
    buckets = 64 + n // 250_000
    salted = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    base = (
        salted.groupBy("length", "_b").agg(F.count("*").alias("_n"))
        .select("length", "_b", (F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).alias("_base"))
    )
    within = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("_r", within).join(base, ["length", "_b"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_r") - 1).drop("_b", "_r", "_base")
    planned = spark.createDataFrame(runs, "length long, rank long, count long, sequence long, each long, offset long")
    chunks = planned.select("*", F.explode(F.expr(f"sequence(0L, (count - 1) div {RUN}L)")).alias("k")).repartition("length", "k")
    slots = chunks.select("*", F.explode(F.expr(f"sequence(k * {RUN}L, least(count, (k + 1) * {RUN}L) - 1)")).alias("j")).select(
        "length",
        (F.col("rank") + F.col("j")).alias("_rank"),
        F.expr("sequence + j div each").alias("sequence_id"),
        F.expr("offset + j % each * length").alias("offset"),
    )
    return ranked.join(slots, ["length", "_rank"]).drop("_rank")


def best_fit(docs: DataFrame, vocab: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, by_chunk: bool | None = None) -> DataFrame:
    """Pieces of all documents with their places."""
    cut = stage_table(pieces(docs, vocab, end_id, capacity, with_ids, by_chunk), "pieces")
    extra = ["ids"] * with_ids
    return pack(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *extra)

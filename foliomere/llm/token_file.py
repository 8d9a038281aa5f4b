"""Token ids in files of patched frame-of-reference blocks.

File: ``PFR1``, blocks, document table, block index, trailer. A block holds up to ``BLOCK``
ids: its minimum is subtracted, the rest is packed at the bit width that covers the chosen
percentile, wider values go to an exception list. The index holds each block's first byte
and first id, so that a reader can start at any id. All numbers are little-endian.

Edge cases: a null text is empty and has the end id alone; null ids sort first and come back
null; repeated ids stay as rows of their own, ordered by text; an empty table writes no file
and reads as no rows; other columns are passed over.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stage_table, whole_text
from .tokens import encoder, vocabulary

MAGIC = b"PFR1"
BLOCK = 8192
#: Share of a block's values that the packed width covers.
PERCENTILE = 0.9
_HEAD = struct.Struct("<IIIB")  # ids, minimum, exceptions, width
_TAIL = struct.Struct("<QQQ4s")  # documents, blocks, first byte of the document table
_MISSING = -(2**63)


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block: whole low bytes, then the bits above them plane by plane, then exceptions."""
    low = int(ids.min())
    v = ids.astype(np.uint32) - np.uint32(low)
    at = min(len(v) - 1, int(percentile * len(v)))
    width = int(np.partition(v, at)[at]).bit_length()
    over = np.flatnonzero(v >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    parts = [_HEAD.pack(len(v), low, len(over), width)]
    planes = v.astype("<u4").view(np.uint8).reshape(-1, 4)
    parts += [planes[:, k].tobytes() for k in range(width // 8)]
    parts += [np.packbits((v >> np.uint32(k)) & np.uint32(1) != 0).tobytes() for k in range(width // 8 * 8, width)]
    parts += [over.astype("<u4").tobytes(), v[over].astype("<u4").tobytes()]
    return b"".join(parts)


def unpack_block(data: bytes) -> np.ndarray:
    n, low, n_over, width = _HEAD.unpack_from(data)
    at = _HEAD.size
    v = np.zeros(n, np.uint32)
    for k in range(width // 8):
        v |= np.frombuffer(data, np.uint8, n, at).astype(np.uint32) << np.uint32(8 * k)
        at += n
    for k in range(width // 8 * 8, width):
        size = (n + 7) // 8
        v |= np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n).astype(np.uint32) << np.uint32(k)
        at += size
    over = np.frombuffer(data, "<u4", n_over, at)
    v[over] = np.frombuffer(data, "<u4", n_over, at + 4 * n_over)
    return v + np.uint32(low)


class Writer:
    """Streams documents into one file; holds one block of ids at a time."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.left = np.empty(0, np.uint32)
        self.docs, self.lengths, self.blocks, self.ids = [], [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append((self.at, self.ids))
        self._put(pack_block(ids))
        self.ids += len(ids)

    def add(self, doc_ids: list[int], arrays: list[np.ndarray]) -> None:
        self.docs += doc_ids
        self.lengths += map(len, arrays)
        joined = np.concatenate([self.left, *arrays])
        whole = len(joined) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            self._block(joined[k : k + BLOCK])
        self.left = joined[whole:].copy()

    def close(self) -> None:
        if len(self.left):
            self._block(self.left)
        table = self.at
        self._put(np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<u4").tobytes())
        self._put(np.array(self.blocks, "<u8").reshape(-1, 2).tobytes())
        self._put(_TAIL.pack(len(self.docs), len(self.blocks), table, MAGIC))


class Reader:
    """Reads the tables of one file, then its blocks as they are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, m, table, magic = _TAIL.unpack(self._range(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        data = self._range(table, 12 * n + 16 * m)
        self.docs = np.frombuffer(data, "<i8", n)
        self.lengths = np.frombuffer(data, "<u4", n, 8 * n)
        index = np.frombuffer(data, "<u8", 2 * m, 12 * n).reshape(-1, 2)
        self.first_byte = [*index[:, 0].tolist(), table]
        self.first_id = index[:, 1].astype(np.int64)

    def _range(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def block(self, k: int) -> np.ndarray:
        return unpack_block(self._range(self.first_byte[k], self.first_byte[k + 1] - self.first_byte[k]))

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, ids before it in this file, ids) of each document in turn."""
        held, have, k, start = [], 0, 0, 0
        for doc, n in zip(self.docs.tolist(), self.lengths.tolist(), strict=True):
            while have < n:
                held.append(self.block(k))
                have += len(held[-1])
                k += 1
            joined = held[0] if len(held) == 1 else np.concatenate([np.empty(0, np.uint32), *held])
            yield doc, start, joined[:n]
            held, have, start = [joined[n:]], have - n, start + n


def write_ids(docs: DataFrame, folder: str, vocab: str | None = None, end_id: int = 1, by_chunk: bool | None = None) -> DataFrame:
    """Encode whole texts and write them in ascending ``doc_id``; one row for each file.

    A range exchange orders the corpus, so file k holds smaller ids than file k + 1. A task
    writes under a name of its own and renames at the end, so a repeated attempt of a lost
    task leaves one whole file."""
    by_chunk = vocab is None if by_chunk is None else by_chunk
    vocab = vocab or vocabulary()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        encode, out = encoder(vocab, by_chunk), None
        end = np.array([end_id], np.uint32)
        task = TaskContext.get()
        for b in batches:
            if not len(b):
                continue
            if out is None:
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                path = f"{root}/part-{task.partitionId():06d}.pfr"
                draft = f"{path}.{task.taskAttemptId()}"
                sink = store.open_output_stream(draft)
                out = Writer(sink)
            for k in range(0, len(b), 200):
                texts = b["_t"].iloc[k : k + 200].tolist()
                ids = [np.concatenate([np.frombuffer(x, "<u4"), end]) for x in encode(texts)]
                out.add(b["_d"].iloc[k : k + 200].tolist(), ids)
        if out is not None:
            out.close()
            sink.close()
            store.move(draft, path)
            yield pd.DataFrame({"part": [task.partitionId()], "path": [path], "n_docs": [len(out.docs)], "n_ids": [out.ids]})

    ordered = (
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_MISSING)).alias("_d"), whole_text().alias("_t"))
        .repartitionByRange(F.col("_d"), F.xxhash64("_t"))
        .sortWithinPartitions("_d", "_t")
    )
    return stage_table(ordered.mapInPandas(write, "part int, path string, n_docs long, n_ids long"), "token-files")


def read_ids(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, read from the files."""
    from pyspark.sql import Window

    n_files = max(1, files.count())  # one row a file
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = files.withColumn("base", F.coalesce(before, F.lit(0)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for path, base in zip(b["path"], b["base"], strict=True):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_file(path) as source:
                    rows = []
                    for doc, start, ids in Reader(source).documents():
                        row = [None if doc == _MISSING else doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())]
                        rows.append(row + [ids.astype(np.int64)] * with_ids)
                        if len(rows) >= 2000:
                            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                            rows = []
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return based.select("path", "base", "part").repartition(n_files, "part").mapInPandas(read, schema)


def token_files(docs: DataFrame, vocab: str | None = None, end_id: int = 1, by_chunk: bool | None = None) -> DataFrame:
    """Write and read back: the round trip of the whole corpus."""
    folder = shared_dir(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, vocab, end_id, by_chunk), folder)

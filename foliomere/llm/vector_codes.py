"""Product codes of vectors: Lloyd rounds with heaps of bounds.

A vector is cut into PARTS equal parts of whole numbers, and each part position has a codebook of up to
ENTRIES entries. Vectors lie in chunks of a bounded size, one row each, and a chunk keeps one heap for
each entry of each position: the parts assigned to it, keyed by the slack (distance to
the second nearest entry minus distance to the own one) plus the drift that the entry had
gathered by then. When entries move, an entry's drift grows by its own way and the longest way of any other. As long
as a part's key is above its entry's drift, no other entry can have come nearer, so a round pops only
the parts whose key has been passed and compares those exactly with the whole codebook. Each
chunk tells which counts and sums its moved parts change; these are added by Spark, and the driver
sees codebooks and their sums only.

State between rounds is a written table, so a lost executor costs its tasks alone. Distances are whole
numbers in doubles, which is exact where none can pass EXACT; else they are Python's integers.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped; shorter
vectors count as padded with zeros to the longest one, and all to a multiple of PARTS; fewer vectors than ENTRIES make
a smaller codebook; repeated ids are coded each, and the first codebook takes ties of an id by the vector's own order, a null id first;
an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import join_groups, scratch, stage_table

#: Parts of a vector, entries of a codebook, rounds, and the scale of the whole numbers.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components that a chunk holds (8 MB), vectors at most, and vectors whose distances are found at once.
CHUNK_COMPONENTS, CHUNK_VECTORS, AT_ONCE = 2**20, 2**14, 2**12
#: Squared distances up to this are found in doubles.
EXACT = 2**53


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array of whole numbers) of the rows that are not dropped."""
    x = lambda c: c.cast("double")
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    return vectors.filter(fine).select("vec_id", "label", F.transform("embedding", lambda c: F.floor(x(c) * SCALE).cast("long")).alias("v"))


class Codebook:
    """Entries of each position, as whole numbers, and the drift that each has gathered."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # positions x entries x components
        self.drift = np.zeros(entries.shape[:2])

    def moved(self, entries: np.ndarray) -> Codebook:
        """After a round: an entry's drift grows by its own way and the longest of any other's."""
        out = Codebook(entries)
        way = np.sqrt(((entries.astype(float) - self.entries.astype(float)) ** 2).sum(axis=2))
        other = np.zeros_like(way)
        for p in range(len(way)):
            if way.shape[1] > 1:
                order = np.argsort(way[p])
                other[p] = way[p, order[-1]]
                other[p, order[-1]] = way[p, order[-2]]
        # rounded up, so that rounding never hides a part that may have moved
        out.drift = self.drift + (way + other) * (1 + 1e-9) + 1e-6
        return out

    def nearest(self, p: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part the nearest entry, ties to the lower index, and its slack."""
        entries = self.entries[p]
        largest = int(max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0)))
        if 4 * largest**2 * entries.shape[1] > EXACT:
            squares = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)) for e in entries] for x in parts], dtype=object)
        else:
            x, e = parts.astype(float), entries.astype(float)
            squares = (x * x).sum(axis=1)[:, None] - 2 * (x @ e.T) + (e * e).sum(axis=1)[None, :]
        own = np.argmin(squares, axis=1)
        if len(entries) == 1:
            return own, np.full(len(parts), np.inf)
        at = np.arange(len(parts))
        least = squares[at, own].astype(float)
        rest = squares.copy()
        rest[at, own] = np.max(rest, axis=1) if rest.dtype != object else [max(r) for r in rest]
        return own, np.sqrt(rest.min(axis=1).astype(float)) - np.sqrt(least)


class Heaps:
    """One heap of (key, vector) for each entry of each position of a chunk."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, bounds: np.ndarray):
        self.keys, self.rows, self.bounds = keys, rows, bounds
        self.opened: dict[int, list[tuple[float, int]]] = {}

    @classmethod
    def of(cls, keys: np.ndarray, owners: np.ndarray, n_heaps: int) -> Heaps:
        """From the key and the heap of each part; parts are numbered position by position."""
        order = np.lexsort((keys, owners))  # a sorted run is a heap
        bounds = np.searchsorted(owners[order], np.arange(n_heaps + 1))
        return cls(keys[order], order.astype(np.int32), bounds.astype(np.int32))

    def open(self, heap: int) -> list[tuple[float, int]]:
        if heap not in self.opened:
            own = slice(self.bounds[heap], self.bounds[heap + 1])
            self.opened[heap] = list(zip(self.keys[own].tolist(), self.rows[own].tolist()))
        return self.opened[heap]

    def pop(self, drift: np.ndarray) -> list[tuple[int, int]]:
        """Takes off (heap, part) wherever a key is not above the drift of its entry."""
        out = []
        full = np.flatnonzero(np.diff(self.bounds))
        for heap in full[self.keys[self.bounds[full]] <= drift[full]].tolist():
            items, limit = self.open(heap), drift[heap]
            while items and items[0][0] <= limit:
                out.append((heap, heapq.heappop(items)[1]))
        return out

    def push(self, heap: int, key: float, part: int) -> None:
        heapq.heappush(self.open(heap), (key, part))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        if self.opened:
            keys, rows, sizes = [], [], np.diff(self.bounds)
            for heap in range(len(sizes)):
                if heap in self.opened:
                    items = self.opened[heap]
                    keys.append(np.array([k for k, _ in items], dtype=float))
                    rows.append(np.array([r for _, r in items], dtype=np.int32))
                    sizes[heap] = len(items)
                elif sizes[heap]:
                    own = slice(self.bounds[heap], self.bounds[heap + 1])
                    keys.append(self.keys[own])
                    rows.append(self.rows[own])
            self.keys, self.rows = (np.concatenate(x) if x else y for x, y in ((keys, self.keys[:0]), (rows, self.rows[:0])))
            self.bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            self.opened = {}
        return self.keys.tobytes(), self.rows.tobytes(), self.bounds.tobytes()

    @classmethod
    def unpacked(cls, keys: bytes, rows: bytes, bounds: bytes) -> Heaps:
        return cls(np.frombuffer(keys), np.frombuffer(rows, dtype=np.int32), np.frombuffer(bounds, dtype=np.int32))


def chunks(rows: DataFrame, width: int) -> DataFrame:
    """One row for each chunk: ids, labels and the parts (positions x vectors x width) as bytes."""
    limit = max(1, min(CHUNK_VECTORS, CHUNK_COMPONENTS // max(1, PARTS * width)))
    ids, labels = rows.schema["vec_id"].dataType, rows.schema["label"].dataType
    schema = StructType([StructField("ids", ArrayType(ids)), StructField("labels", ArrayType(labels)), StructField("parts", BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def chunk() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            lengths = np.fromiter((len(v) for v in whole["v"]), dtype=np.int64, count=len(whole))
            flat = np.zeros((len(whole), PARTS * width), dtype=np.int64)
            flat[np.arange(PARTS * width)[None, :] < lengths[:, None]] = np.concatenate([c.flatten().to_numpy() for c in whole["v"].chunks])
            parts = np.ascontiguousarray(flat.reshape(len(whole), PARTS, width).transpose(1, 0, 2))
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), pa.concat_arrays(whole[c].chunks))
            return pa.RecordBatch.from_arrays([one("vec_id"), one("label"), pa.array([parts.tobytes()], pa.binary())], ["ids", "labels", "parts"])

        for batch in batches:
            while batch.num_rows:
                take = min(limit - n, batch.num_rows)
                held.append(batch.slice(0, take))
                n, batch = n + take, batch.slice(take)
                if n == limit:
                    yield chunk()
                    held, n = [], 0
        if n:
            yield chunk()

    return rows.select("vec_id", "label", "v").mapInArrow(cut, schema)


_STATE = "keys binary, heap_rows binary, bounds binary, codes binary, popped long, entries array<int>, counts array<long>, sums array<array<long>>"


def assigned(table: DataFrame, book: Codebook, first: bool) -> DataFrame:
    """The chunks with their heaps and codes after an assignment, and the counts and sums it changes.

    ``entries`` are position * ENTRIES + entry; counts and sums tell what is to be added to theirs."""
    kept = ["ids", "labels", "parts"]
    state = StructType(table.select(*kept).schema.fields + StructType.fromDDL(_STATE).fields)
    n_entries, width = book.entries.shape[1:]
    drift = np.zeros(PARTS * ENTRIES)
    for p in range(PARTS):
        drift[p * ENTRIES : p * ENTRIES + n_entries] = book.drift[p]

    def assign(parts: np.ndarray, row: dict | None) -> tuple:
        n = parts.shape[1]
        flat = parts.reshape(PARTS * n, width)
        if row is None:
            asked, was = np.arange(PARTS * n), None
            codes = np.zeros(PARTS * n, dtype=np.uint8)
        else:
            heaps = Heaps.unpacked(row["keys"], row["heap_rows"], row["bounds"])
            codes = np.frombuffer(row["codes"], dtype=np.uint8).copy()
            popped = heaps.pop(drift)
            asked = np.array(sorted(part for _, part in popped), dtype=np.int64)
            was = codes[asked].copy()
        keys = np.zeros(len(asked))
        for lo in range(0, len(asked), AT_ONCE):
            some = asked[lo : lo + AT_ONCE]
            for p in range(PARTS):
                at = np.flatnonzero(some // n == p)
                if len(at):
                    own, slack = book.nearest(p, flat[some[at]])
                    codes[some[at]] = own
                    keys[lo + at] = slack + book.drift[p, own]
        owner = (asked // max(n, 1)) * ENTRIES + codes[asked]
        if row is None:
            heaps = Heaps.of(keys, owner, PARTS * ENTRIES)
            plus, minus = asked, asked[:0]
            lost = asked[:0]
        else:
            for heap, key, part in zip(owner.tolist(), keys.tolist(), asked.tolist()):
                heaps.push(heap, key, part)
            changed = codes[asked] != was
            plus = minus = asked[changed]
            lost = (minus // n) * ENTRIES + was[changed]
        gained = (plus // max(n, 1)) * ENTRIES + codes[plus]
        counts, sums = np.zeros(PARTS * ENTRIES, dtype=np.int64), np.zeros((PARTS * ENTRIES, width), dtype=np.int64)
        for owners, which, sign in ((gained, plus, 1), (lost, minus, -1)):
            np.add.at(counts, owners, sign)
            np.add.at(sums, owners, sign * flat[which])
        told = np.flatnonzero((counts != 0) | (sums != 0).any(axis=1))
        return (*heaps.packed(), codes.tobytes(), len(asked), told.tolist(), counts[told].tolist(), sums[told].tolist())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in state.fields]
        for batch in batches:
            for i in range(batch.num_rows):  # a chunk at a time
                one = batch.slice(i, 1)
                row = {c: one.column(c)[0].as_py() for c in ("keys", "heap_rows", "bounds", "codes")} if not first else None
                parts = np.frombuffer(one.column("parts")[0].as_py(), dtype=np.int64).reshape(PARTS, len(one.column("ids")[0]), width)
                out = assign(parts, row)
                kinds = [pa.binary()] * 4 + [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([one.column(c) for c in kept] + [pa.array([v], t) for v, t in zip(out, kinds)], names)

    return table.mapInArrow(each, state)


def changes(state: DataFrame) -> list:
    """entry, n, sums: what a round adds to each entry; at most PARTS * ENTRIES rows."""
    told = state.select(F.explode(F.arrays_zip("entries", "counts", "sums")).alias("x"))
    each = told.select("x.entries", "x.counts", F.posexplode_outer("x.sums").alias("i", "s"))
    added = each.groupBy("entries", "i").agg(F.sum("counts").alias("n"), F.sum("s").alias("s"))
    return added.groupBy("entries").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("sums")).collect()


def codes(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of every kept vector, and the codebooks (positions x entries x components)."""
    spark = vectors.sparkSession
    rows = stage_table(kept_vectors(vectors), "vectors")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = -(-(longest or 0) // PARTS)
    start = [r["v"] + [0] * (PARTS * width - len(r["v"])) for r in rows.orderBy("vec_id", "v").limit(ENTRIES).select("v").collect()]
    book = Codebook(np.array(start, dtype=np.int64).reshape(len(start), PARTS, width).transpose(1, 0, 2))
    schema = StructType([rows.schema["vec_id"], rows.schema["label"]]).add("code", "string").add("error", "long")
    if not start:
        return spark.createDataFrame([], schema), book.entries
    counts, sums = np.zeros(PARTS * ENTRIES, dtype=np.int64), np.zeros((PARTS * ENTRIES, width), dtype=np.int64)
    state = stage_table(chunks(rows, width), "vector-chunks")
    for k in range(rounds + 1):
        state = stage_table(assigned(state, book, first=k == 0), f"vector-round-{k}")
        if k < rounds:
            for r in changes(state.select("entries", "counts", "sums")):
                counts[r["entries"]] += r["n"]
                sums[r["entries"]] += np.array([x["s"] or 0 for x in r["sums"]][:width], dtype=np.int64)
            entries = book.entries.copy()
            for p in range(PARTS):
                own = slice(p * ENTRIES, p * ENTRIES + entries.shape[1])
                used = counts[own] > 0
                entries[p][used] = sums[own][used] // counts[own][used][:, None]
            book = book.moved(entries)
    return decoded(state, book.entries, schema), book.entries


def decoded(state: DataFrame, entries: np.ndarray, schema: StructType) -> DataFrame:
    """The rows of the chunks with their codes and the final squared distances."""
    width = entries.shape[2]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                n = len(ids)
                parts = np.frombuffer(batch.column("parts")[i].as_py(), dtype=np.int64).reshape(PARTS, n, width)
                own = np.frombuffer(batch.column("codes")[i].as_py(), dtype=np.uint8).reshape(PARTS, n)
                error = sum(((parts[p] - entries[p][own[p]]) ** 2).sum(axis=1) for p in range(PARTS))
                text = np.ascontiguousarray(own.T).tobytes().hex()
                code = pa.array([text[2 * PARTS * j : 2 * PARTS * (j + 1)] for j in range(n)], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return state.select("ids", "labels", "parts", "codes").mapInArrow(each, schema)


def codebook_digest(entries: np.ndarray) -> str:
    """SHA-256 of all components by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    with scratch(vectors.sparkSession, "vector-codes"):
        rows, entries = codes(vectors)
        rows = stage_table(rows, "vector-codes", keep=True)
    keyed = rows.withColumn("_null", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    totals = keyed.groupBy("_null", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_size"))
    met = join_groups(keyed, totals, ["_null", "_label"], "_size")
    return met.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(entries)).alias("codebooks_sha256"))

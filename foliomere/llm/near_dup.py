"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each text becomes its set of 5-word shingles, hashed to 64 bits; the sketch is the K
   smallest. Equal sets are one class from here on, so copies are never paired.
2. Inverted lists of the retained values: a pair at the wanted similarity shares at least
   MIN_SHARED of K values but for chance below 1e-6, so it shares one of a sketch's
   K - MIN_SHARED + 1 rarest. Only those are listed, and only classes whose sets can still
   reach a partner (enough shingles that some other listed class has) stay.
3. In each list all classes are compared with two pivots; links found join components. This
   is repeated with pivots of the components met, while long lists stay open. Then only pairs
   across components of a list are left, and all of those are compared.
4. A pair is estimated on the sketch of the union, then confirmed on the full sets.

Edge cases: texts without words (null, empty, blanks) are linked with nothing; with fewer
than five words the whole sequence is the one shingle; repeated ids take the class of their
own text; null ids never name a component unless all its ids are null; other columns are
passed over; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage_table, whole_text, without_rows

SHINGLE = 5
K = 32
#: Values of a union's sketch that both must hold, at similarity 0.75: 24 of 32 are awaited, 12 are five deviations less.
MIN_SHARE = 0.375
MIN_SHARED = 12
PERCENT = 75
#: The longer sketch, for pairs left across components; classes of a list compared at once, and of either side in one cell.
LONG_K, BLOCK, CELL = 256, 256, 1024
#: Rounds of comparisons with pivots at most; another follows while a list has more than SHORT classes outside of its main component.
ROUNDS, SHORT = 2, 16
#: Ids of texts that may be broadcast to fetch full sets; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_hashes(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    n = SHINGLE if len(words) >= SHINGLE else len(words)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - n + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(29)))


def sketches(docs: DataFrame, with_sets: bool = False) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, class (fingerprint of the whole set; null if empty), sketch (and set, and its least hashes cut to 32 bits)."""
    schema = "doc_id long, row long, n_shingles long, class binary, sketch array<long>" + ", full array<long>, least binary" * with_sets

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                rows = []
                for doc, row, text in zip(part["doc_id"].tolist(), part["row"].tolist(), part["_t"].tolist(), strict=True):
                    s = shingle_hashes(text)
                    name = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    signed = s.view(np.int64)
                    sets = [signed, np.unique((s[:LONG_K] >> np.uint64(32)).astype(np.uint32)).tobytes()] if with_sets else []
                    rows.append([doc, row, len(s), name, signed[:K], *sets])
                names = ["doc_id", "row", "n_shingles", "class", "sketch"] + ["full", "least"] * with_sets
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(whole_text()).alias("row"), whole_text().alias("_t")).mapInPandas(run, schema)


def _unsigned(x: Column) -> Column:
    """Turns signed longs, which hold unsigned hashes, into ones of the same order."""
    return x.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def union_share(a: Column, b: Column, k: int = K) -> Column:
    """Estimated similarity of ascending sketches: the share of the union's sketch that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.greatest(F.size(union), F.lit(1))


def least_share(na: Column, nb: Column, k: int) -> Column:
    """What the estimate of a link falls below by chance only: five deviations of k values drawn from the union.

    The union of a link has (na + nb) / 1.75 shingles at most; where k is no less, the estimate is the similarity itself."""
    wanted = PERCENT / 100
    left = F.greatest(F.lit(0.0), 1 - k * (1 + wanted) / (na + nb))
    return wanted - 5 * F.sqrt(wanted * (1 - wanted) / k * left) - 1e-9


def listed(classes: DataFrame) -> DataFrame:
    """value, class, n, place: the rarest values of each sketch that some other sketch has too."""
    post = classes.select("class", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    shared = post.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    mine = post.join(shared, "value").groupBy("class", "n", "s").agg(F.collect_list(F.struct("df", "value")).alias("v"))
    # values that no other sketch has are the rarest: they take the first places
    length = F.col("s") - F.ceil(F.lit(MIN_SHARE) * F.col("s")) + 1 - (F.col("s") - F.size("v"))
    kept = mine.filter(length > 0).select("class", "n", F.explode(F.slice(F.sort_array("v"), 1, F.greatest(length, F.lit(0)).cast("int"))).alias("x"))
    rows = kept.select(F.col("x.value").alias("value"), "class", "n")
    alone = rows.groupBy("value").agg(F.count("*").alias("m")).filter("m > 1")
    return rows.join(alone, "value")


def possible(na: Column, ea: Column, nb: Column, eb: Column) -> Column:
    """Whether sets of sizes n, of which e shingles are held by some other class too, can be similar enough."""
    most = F.least(ea, eb)
    return 100 * most >= PERCENT * (na + nb - most)


def confirmed(pairs: DataFrame, marks: DataFrame, full: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes those whose full sets are similar enough."""
    side = lambda rows, x, *cols: rows.select(F.col("class").alias(x), *(F.col(c).alias(c + x) for c in cols))
    brief = pairs
    for x in "ab":
        brief = brief.join(side(marks, x, "n", "e", "sketch"), x)
    sizes = [F.col(c) for c in ("na", "ea", "nb", "eb")]
    near = union_share(F.col("sketcha"), F.col("sketchb")) >= least_share(F.col("na"), F.col("nb"), K)
    both = stage_table(brief.filter(possible(*sizes)).filter(near).select("a", "b"), "likely")
    for x in "ab":
        both = both.join(side(full, x, "full"), x)
    i = F.size(F.array_intersect("fulla", "fullb"))
    return stage_table(both.filter(100 * i >= PERCENT * (F.size("fulla") + F.size("fullb") - i)).select("a", "b"), "links")


def full_sets(docs: DataFrame, made: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, full, least, id (a number) of the ``wanted`` classes, from one text each, by the smallest id.

    Sets are written where they are made. Only ids that texts share give a class twice or one not wanted; only then are sets dealt by class to leave these out."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    first = made.join(wanted, "class", "left_semi").groupBy("class").agg(F.min(key).alias("_k")).select("_k").distinct()
    first = stage_table(first, "set-ids")
    few = first.count() <= BROADCAST_IDS
    texts = docs.select(key.alias("_k"), "doc_id", "text").join(F.broadcast(first) if few else first, "_k", "left_semi")
    sets = sketches(texts, True).filter("class is not null").select("class", "full", "least", F.monotonically_increasing_id().alias("id"))
    sets = stage_table(sets, "sets")
    one = stage_table(sets.select("class", "id").join(wanted, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id")), "set-rows")
    if one.count() == sets.count():
        return sets
    return stage_table(sets.join(one.select("id"), "id", "left_semi").select("class", "full", "least", "id"), "sets")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """class, n, e of sets (class, full, id): e counts the shingles that some other of these classes has.

    Classes that can't reach the similarity with so few go; they can't be anyone's partner."""
    # a shingle goes out with the set's number, which packs far better than the class's fingerprint
    once = sets.select("id", F.explode("full").alias("h")).groupBy("h").agg(F.count("*").alias("df"), F.min("id").alias("id")).filter("df = 1")
    lone = once.groupBy("id").agg(F.count("*").alias("lone"))
    rows = sets.select("id", "class", F.size("full").alias("n")).join(lone, "id", "left").select("class", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("e"))
    return stage_table(rows.filter(100 * F.col("e") >= PERCENT * F.col("n")), "shared")


def components(links: DataFrame) -> DataFrame:
    """class, root for every class in a link: smallest class reachable, by label spreading with jumps."""
    edges = stage_table(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    label = stage_table(edges.groupBy(F.col("a").alias("class")).agg(F.min("b").alias("m")).select("class", F.least("class", "m").alias("root")), "roots")
    while True:
        near = (
            edges.join(label.select(F.col("class").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("class")).agg(F.min("root").alias("m"))
        )
        step = label.join(near, "class").select("class", "root", F.least("root", "m").alias("new"))
        jump = step.select(F.col("class").alias("new"), F.col("new").alias("over"))
        after = stage_table(step.join(jump, "new").select("class", F.col("root").alias("old"), F.least("new", "over").alias("root")), "roots")
        label = after.select("class", "root")
        if after.filter("old != root").isEmpty():
            return label


def with_roots(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label, "class", "left").withColumn("root", F.coalesce("root", "class"))


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` after further links between its components: only their roots are spread anew."""
    if links.isEmpty():
        return label
    tops = with_roots(links.select(F.col("a").alias("class"), "b"), label).select(F.col("root").alias("a"), F.col("b").alias("class"))
    tops = with_roots(tops, label).select("a", F.col("root").alias("b"))
    over = components(tops.distinct())
    alone = over.join(label, "class", "left_anti").select("class", F.col("class").alias("root"))
    up = over.select(F.col("class").alias("root"), F.col("root").alias("over"))
    known = label.select("class", "root").union(alone)
    return known.join(up, "root", "left").select("class", F.coalesce("over", "root").alias("root"))


def open_lists(post: DataFrame, label: DataFrame | None) -> DataFrame:
    """value, main, pivot, low, c, others: the lists with classes of several components.

    ``main`` is the component that most of a list's classes are in, ``pivot`` its class of which
    the largest share is held by others too (the middle of a group of copies has them all),
    ``low`` the least class of the list, ``others`` counts those outside of ``main``."""
    rooted = post.withColumn("root", F.col("class")) if label is None else with_roots(post, label)
    best = F.max(F.struct((F.col("e") / F.col("n")).alias("held"), "class")).alias("best")
    parts = rooted.groupBy("value", "root").agg(F.count("*").alias("c"), best, F.min("class").alias("low"))
    top = F.max(F.struct("c", F.col("best.held").alias("held"), "root", F.col("best.class").alias("pivot"))).alias("top")
    lists = parts.groupBy("value").agg(top, F.min("low").alias("low"), F.sum("c").alias("c"), F.count("*").alias("parts")).filter("parts > 1")
    return lists.select("value", F.col("top.root").alias("main"), F.col("top.pivot").alias("pivot"), "low", "c", (F.col("c") - F.col("top.c")).alias("others"))


def pivot_pairs(post: DataFrame, lists: DataFrame, label: DataFrame | None) -> DataFrame:
    """a, b: the classes outside of a list's main component with its pivot, and all with its least class."""
    rows = post.select("value", "class").join(lists, "value")
    rows = rows.withColumn("root", F.col("class")) if label is None else with_roots(rows, label)
    ends = F.when(F.col("root") != F.col("main"), F.array("pivot", "low")).otherwise(F.array("low"))
    pairs = rows.select("class", F.explode(ends).alias("p")).filter("class != p")
    return pairs.select(F.least("class", "p").alias("a"), F.greatest("class", "p").alias("b")).distinct()


class Block:
    """Classes of a list: their ids and components as longs, set sizes, and the least of their hashes, cut to 32 bits."""

    def __init__(self, rows: pd.DataFrame):
        self.name, self.n = rows["class"].to_numpy(), rows["n"].to_numpy()
        self.id, self.root, self.main = rows["id"].to_numpy(), rows["root"].to_numpy(), rows["in_main"].to_numpy()
        self.least = [np.frombuffer(s, np.uint32) for s in rows["least"]]
        # up to here a set's hashes are known
        self.reach = np.array([s[-1] if n > len(s) else 2**32 - 1 for s, n in zip(self.least, self.n, strict=True)], np.uint32)
        self.values = np.concatenate(self.least)
        self.rows = np.repeat(np.arange(len(self.least)), [len(s) for s in self.least])

    def holds(self, values: np.ndarray) -> np.ndarray:
        """A row for each class, a column for each of the ascending values: 1 where it is held."""
        at = np.minimum(np.searchsorted(values, self.values), len(values) - 1)
        hit = values[at] == self.values
        out = np.zeros((len(self.least), len(values)), np.float32)
        out[self.rows[hit], at[hit]] = 1
        return out

    def known(self, reach: np.ndarray) -> np.ndarray:
        """How many of each class's hashes are known up to each of ``reach``."""
        return np.array([np.searchsorted(s, reach, "right") for s in self.least])


def likely_pairs(x: Block, y: Block) -> list[tuple[bytes, bytes]]:
    """Pairs across components that the estimate leaves.

    Where a class is surely similar to some of a component, the likeliest of these speaks for all."""
    values = np.intersect1d(x.values, y.values)
    if not len(values):
        return []
    shared = x.holds(values) @ y.holds(values).T
    seen = np.maximum(1, x.known(y.reach) + y.known(x.reach).T - shared)
    share = shared / seen
    # the sample is part of the union, which has (n + n) / 1.75 shingles at most in a link; two may share 32 bits
    left = np.maximum(0, 1 - seen * (100 + PERCENT) / 100 / (x.n[:, None] + y.n[None, :]))
    slack = 5 * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / seen * left) + 2 / seen
    may = (share >= PERCENT / 100 - slack) & (x.root[:, None] != y.root[None, :]) & ((x.id[:, None] < y.id[None, :]) | y.main[None, :])
    out = []
    for i in np.flatnonzero(may.any(axis=1)):
        js = np.flatnonzero(may[i])
        sure = js[share[i, js] >= PERCENT / 100 + slack[i, js]]
        sure = sure[np.argsort(-share[i, sure], kind="stable")]
        roots, first = np.unique(y.root[sure], return_index=True)
        js = np.concatenate([sure[first], js[~np.isin(y.root[js], roots)]])
        out.extend((min(x.name[i], y.name[j]), max(x.name[i], y.name[j])) for j in js)
    return out


def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Likely pairs of each cell's two sides; rows come by cell, its few left ones first."""
    cell, lefts = None, []
    for b in batches:
        found, start = set(), 0
        names = b["cell"].to_numpy()
        ends = [*(np.flatnonzero(names[1:] != names[:-1]) + 1), len(b)]
        for end in ends:
            rows = b.iloc[start:end]
            if names[start] != cell:
                cell, lefts = names[start], []
            left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
            lefts.extend(Block(left.iloc[k : k + BLOCK]) for k in range(0, len(left), BLOCK))
            for k in range(0, len(right), BLOCK):
                y = Block(right.iloc[k : k + BLOCK])
                for x in lefts:
                    found.update(likely_pairs(x, y))
            start = end
        yield pd.DataFrame(sorted(found), columns=["a", "b"])


def rest_pairs(post: DataFrame, lists: DataFrame, label: DataFrame, full: DataFrame) -> DataFrame:
    """a, b: the pairs across components of open lists that a longer sketch leaves.

    A list is a grid of cells: classes outside of its main component by all of its classes, CELL of
    either at about the most, so no task holds a list."""
    rows = with_roots(post.join(lists.select("value", "main", "others", "c"), "value"), label).join(full.select("class", "least"), "class")
    rows = rows.select("value", "class", "n", "least", "others", "c", F.xxhash64("class").alias("id"), F.xxhash64("root").alias("root"), (F.col("root") == F.col("main")).alias("in_main"))
    rows = stage_table(rows, "open")
    parts = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    cells = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    left = rows.filter("not in_main").select("*", F.lit(0).alias("side"), F.pmod("id", parts("others")).cast("int").alias("row"), cells("c").alias("column"))
    right = rows.select("*", F.lit(1).alias("side"), cells("others").alias("row"), F.pmod("id", parts("c")).cast("int").alias("column"))
    both = left.unionByName(right).withColumn("cell", F.concat_ws(" ", "value", "row", "column")).drop("value", "others", "c", "row", "column")
    return both.repartition("cell").sortWithinPartitions("cell", "side").mapInPandas(compared, "a binary, b binary").distinct()


def link_classes(docs: DataFrame, made: DataFrame) -> DataFrame:
    """class, root of all linked classes."""
    none = docs.sparkSession.createDataFrame([], "class binary, root binary")
    own = made.filter(F.col("class").isNotNull()).groupBy("class", F.col("n_shingles").alias("n")).agg(F.first("sketch").alias("sketch"))
    classes = stage_table(own, "classes")
    post = stage_table(listed(classes).select("value", "class"), "lists")
    wanted = post.select("class").distinct()
    if wanted.isEmpty():
        return none
    full = full_sets(docs, made, wanted)
    # the second round counts among those that the first has left
    marks = shared_shingles(full.join(shared_shingles(full).select("class"), "class", "left_semi"))
    sketch = classes.select("class", F.transform("sketch", _unsigned).alias("sketch"))
    marks = stage_table(marks.join(sketch, "class"), "marks")
    post = post.join(marks.select("class", "n", "e"), "class")
    post = stage_table(post.join(post.groupBy("value").agg(F.count("*").alias("m")).filter("m > 1").select("value"), "value"), "lists")
    label, done = None, None
    for _ in range(ROUNDS):
        lists = stage_table(open_lists(post, label), "open-lists")
        pairs = pivot_pairs(post, lists, label)
        pairs = stage_table(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pivot-pairs")
        done = pairs if done is None else done.union(pairs)
        links = confirmed(pairs, marks, full)
        label = components(links) if label is None else merged(label, links)
        # a round that finds nothing, or leaves short lists alone, is the last
        if links.isEmpty() or lists.filter(F.col("others") > SHORT).isEmpty():
            break
    lists = stage_table(open_lists(post, label), "open-lists")
    rest = stage_table(rest_pairs(post, lists, label, full).join(done, ["a", "b"], "left_anti"), "rest")
    return merged(label, confirmed(rest, marks, full))


def near_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept, leads of every document.

    ``leads`` tells one class of each component, of the smallest id (null is the largest)."""
    made = stage_table(sketches(docs), "sketches")
    with scratch(docs.sparkSession, "near-dup"):
        roots = stage_table(link_classes(docs, made), "component-roots", keep=True)
    own = made.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("low"))
    low = with_roots(own, roots)
    top = F.min(F.struct(F.col("low").isNull(), F.col("low"), F.col("class").alias("top")))["top"]
    least = low.groupBy("root").agg(F.min("low").alias("component_id"), top.alias("top"))
    named = low.join(least, "root").select("class", "component_id", (F.col("class") == F.col("top")).alias("leads"))
    out = made.select("doc_id", "row", "n_shingles", "class").join(named, "class", "left")
    out = out.select("doc_id", "row", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("leads", F.lit(True)).alias("leads"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_rows(docs).select("doc_id", "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that no other document of their component precedes, told by id and text; repeated rows stay together."""
    later = near_rows(docs).filter("not (kept and leads)").select(F.col("doc_id").cast("long").alias("_id"), F.col("row").alias("_r"))
    return without_rows(docs, later)

"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its lower-case tokens, parted by spaces. Tokens are ordered by rarity: occurrences over all
texts are counted in a fixed number of hash buckets, and a token's key puts the power of two of its bucket's
count before 57 bits of its hash, so the order is total and fits a long. Two sets at the threshold
share a token in their prefixes; length, position and a bit signature bound the overlap that is still
possible; what is left is verified on the whole sets. Equal sets are one class before any pair is made.

A line goes if an earlier line, by (doc_id, text hash, line), is equal or similar enough, whether
that one stays or not. Sets of a token's list meet each other; a list of more than SHORT sets is parted by
their sizes first, as only sizes near each other can match. Where such a part is still longer, all its
sets meet a few early ones, and only those without a match so far meet the others, in cells of a
bounded size: a set is done once one earlier match is known. None of this changes which lines go.
Lines without words stay and match nothing.

A row is known by its doc_id and 64 bits of its text's hash, so texts that share an id (or have
none) lose their own lines alone; 32 of these bits order the texts of one id.

Edge cases: a null text stays null; an empty one has no lines with words; rows with one doc_id and
one text count as one place, so repeated rows are treated alike; null ids come first; an empty
table gives no rows; extra columns of any name are kept.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage_table, whole_text

#: Similarity of word sets, in percent.
PERCENT = 90
#: Buckets of the occurrence count, as a power of two: its size does not depend on the corpus.
BITS = 20
#: Sets of a token's list up to which all are paired at once, the early ones that the sets of longer lists meet first, and sets of a cell.
SHORT, PIVOTS, CELL = 128, 4, 2048
#: Tokens of long lists that may be broadcast, 10 MB; more are joined by a shuffle.
BROADCAST_KEYS = 300_000
#: One in so many tokens is in the second signature of a set; all are in the first, which large sets fill.
FEW = 4
#: Lines whose places may be broadcast to fetch their words; more are joined by a shuffle.
BROADCAST_LINES = 500_000
#: Numbers that the lines to take out may make in a broadcast, some 20 MB.
BROADCAST_GONE = 5_000_000
_MISSING = -(2**63)
_PLACES = 2**31
_ROWS = Decimal(2**63)


def tokens(text: Column) -> Column:
    """Lower-case runs of characters other than spaces; a tab is a character. Some are empty."""
    return F.split(F.lower(text), " ", -1)


def token_hashes(line: Column) -> Column:
    """Hashes of a line's distinct words."""
    hashes = F.array_distinct(F.transform(tokens(line), lambda w: F.xxhash64(w)))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(2**BITS - 1)).cast("int")


def rarity_classes(docs: DataFrame) -> DataFrame:
    """One row, ``classes``: for each bucket the power of two of its tokens' occurrences, where a key has it."""
    lines = docs.select(F.explode(F.split(whole_text(), "\n", -1)).alias("t"))
    seen = lines.select(F.explode(tokens(F.col("t"))).alias("w"))
    counts = seen.groupBy(bucket(F.xxhash64("w")).alias("b")).count()
    every = docs.sparkSession.range(2**BITS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("count"))
    power = F.shiftleft(F.ceil(F.log2(F.sum("count") + 1)).cast("long"), 57).alias("c")
    filled = every.union(counts).groupBy("b").agg(power)  # 2**BITS rows, whatever the corpus
    row = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "c"))), lambda x: x["c"]).alias("classes"))
    return stage_table(row, "rarity")


def keys(hashes: Column, classes: Column) -> Column:
    """Sorted keys of token hashes, the rarest first."""
    # never null, so that keys are sorted as plain numbers
    rare = lambda h: F.coalesce(F.get(classes, bucket(h)), F.lit(0).cast("long"))
    return F.sort_array(F.transform(hashes, lambda h: rare(h).bitwiseOR(F.shiftrightunsigned(h, 7))))


def row_key() -> tuple[Column, Column]:
    """_d and _r: the id, null as the least, and the hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_MISSING)).alias("_d"), F.xxhash64(whole_text()).alias("_r")


def order_part(r: Column) -> Column:
    """The 32 bits of a text's hash that order the texts of one id."""
    return r.bitwiseAND(F.lit(2**32 - 1))


def place() -> Column:
    """One number for (_d, 32 bits of _r, line), in that order; its size is at most 2**126."""
    return (F.col("_d").cast("decimal(38,0)") * _ROWS + (order_part(F.col("_r")) * _PLACES + F.col("line"))).cast("decimal(38,0)")


def within_id() -> Column:
    """The part of ``first`` that orders the lines of one id."""
    return F.pmod(F.col("first"), F.lit(_ROWS)).cast("long")


def signature(k: Column) -> Column:
    """64 bits, one for each of the tokens, which several may share."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(k, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(bit(x)))


def named(k: Column) -> tuple[Column, Column]:
    """s1 and s2, the name of a set."""
    return F.xxhash64(k).alias("s1"), F.hash(k).alias("s2")


def line_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """_d, _r, line, s1, s2, n, prefix, bits, few of every line with tokens; (s1, s2) names its set."""
    own = docs.select(*row_key(), whole_text().alias("_t"))  # hashed once, not for each line
    rows = own.select("_d", "_r", F.posexplode(F.split("_t", "\n", -1)).alias("line", "t")).filter(F.trim("t") != "")
    rows = rows.withColumn("_c", classes.scalar()).select("_d", "_r", "line", keys(token_hashes(F.col("t")), F.col("_c")).alias("k"))
    n = F.size("k")
    # a set that one more token would already part from all others has no prefix
    listed = 100 * n >= PERCENT * (n + 1)
    prefix = F.slice("k", 1, n - F.ceil(PERCENT * n / 100).cast("int") + 1)
    some = F.filter("k", lambda x: x.bitwiseAND(F.lit(64 * (FEW - 1))) == 0)
    marks = [F.when(listed, c).alias(name) for name, c in (("prefix", prefix), ("bits", signature(F.col("k"))), ("few", signature(some)))]
    return rows.select("_d", "_r", "line", *named(F.col("k")), n.alias("n"), *marks)


def distinct_sets(lines: DataFrame) -> DataFrame:
    """s1, s2, n, prefix, bits, few, d, low, c: each set once, with its first place (d, low) and its lines."""
    sets = lines.groupBy("s1", "s2", "n", "prefix", "bits", "few").agg(F.min("_d").alias("d"), F.min(place()).alias("first"), F.count("*").alias("c"))
    return sets.withColumn("low", within_id()).drop("first")


def postings(sets: DataFrame) -> DataFrame:
    """key, s1, d, low, n, at, bits, few of each token in a set's prefix; (s1, d, low) is a set's name, and (d, low) its first place."""
    return sets.filter("prefix is not null").select("s1", "d", "low", "n", "bits", "few", F.posexplode("prefix").alias("at", "key"))


def may_be_long() -> Column:
    """Whether a key's list may have more than SHORT sets: it has no more than its token's bucket has occurrences, which the key's class bounds."""
    return F.col("key") >= F.lit((SHORT + 1).bit_length() << 57)


def size_band(n: Column) -> Column:
    """Number of a range of sizes; rises with n, and partners lie in one or two of them."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / PERCENT)).cast("int")


def parted_by_size(long: DataFrame) -> DataFrame:
    """Postings of long lists as lists of (key, band) with their number m; a set is its band's own and visits those of smaller partners.

    The smaller set of a pair meets the other in its own band alone, so of two visitors none need be paired."""
    least = F.ceil(F.col("n") * PERCENT / 100 - 1e-9)
    bands = F.sequence(size_band(least), size_band(F.col("n")))
    rows = long.withColumn("band", F.explode(bands)).withColumn("own", F.col("band") == size_band(F.col("n")))
    sizes = rows.groupBy("key", "band").agg(F.count("*").alias("m"), F.count_if("own").alias("owns")).filter("m > 1 and owns > 0")
    return rows.join(sizes.drop("owns"), ["key", "band"])


def may_match(a: str, b: str) -> Column:
    """Length, position and bit filters of two postings of one key."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.ceil((na + nb) * PERCENT / (100 + PERCENT) - 1e-9)
    reach = F.least(na - F.col(f"{a}.at"), nb - F.col(f"{b}.at"))
    # each bit of one side alone is a token that the other lacks
    lacks = lambda x, y, c: F.bit_count(F.col(f"{x}.{c}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{c}"))))
    shared = lambda c: F.least(na - lacks(a, b, c), nb - lacks(b, a, c))
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & (reach >= need) & (shared("bits") >= need) & (shared("few") >= need)


_NAME = ["s1", "d", "low"]


def joined(later: DataFrame, earlier: DataFrame, on: list[str]) -> DataFrame:
    """Names of sets a and b (columns s1, d, low with suffixes _a, _b) that share a list and may match, where b has the earlier first place."""
    same_id = F.col("b.d") == F.col("a.d")
    # equal places (texts of one id whose hashes share 32 bits) are told apart by s1
    before = (F.col("b.d") < F.col("a.d")) | (same_id & (F.col("b.low") < F.col("a.low"))) | (same_id & (F.col("b.low") == F.col("a.low")) & (F.col("b.s1") < F.col("a.s1")))
    match = before & may_match("a", "b")
    if "band" in on:
        match &= F.col("a.own") | F.col("b.own")
    for c in on:
        match = (F.col(f"a.{c}") == F.col(f"b.{c}")) & match
    return later.alias("a").join(earlier.alias("b"), match).select(*(F.col(f"{t}.{c}").alias(f"{c}_{t}") for t in "ab" for c in _NAME))


def words_of(docs: DataFrame, names: DataFrame, classes: DataFrame) -> DataFrame:
    """s1, d, low, h: the sets called ``names`` with their tokens' hashes, from the lines at their first places."""
    places = stage_table(names, "line-places")
    few = places.count() <= BROADCAST_LINES
    line = F.col("low").bitwiseAND(F.lit(_PLACES - 1)).cast("int")
    asked = places.groupBy(F.col("d").alias("_d"), F.shiftright("low", 31).alias("_o")).agg(F.collect_list(F.struct(line.alias("line"), *_NAME)).alias("asked"))
    d, r = row_key()
    own = docs.select(d, order_part(r).alias("_o"), whole_text().alias("_t")).join(F.broadcast(asked) if few else asked, ["_d", "_o"])
    # only the lines asked for leave their texts
    own = own.select(F.split("_t", "\n", -1).alias("_all"), "asked")
    own = own.select(F.explode(F.transform("asked", lambda x: F.struct(x.alias("x"), F.get("_all", x["line"]).alias("t")))).alias("y"))
    got = own.select("y.x.*", token_hashes(F.col("y.t")).alias("h")).withColumn("_c", classes.scalar())
    # another text of that id and order is told by the name
    s1, _ = named(keys(F.col("h"), F.col("_c")))
    return stage_table(got.filter(s1 == F.col("s1")).select(*_NAME, "h").dropDuplicates(_NAME), "line-words")


def matched(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """s1, d, low of the later set of each of ``pairs`` that is similar enough; ``whole`` has the words of their sets."""
    of = lambda t: whole.select(*(F.col(c).alias(f"{c}_{t}") for c in _NAME), F.col("h").alias(f"h_{t}"))
    both = pairs
    for t in "ab":
        both = both.join(of(t), [f"{c}_{t}" for c in _NAME])
    i = F.size(F.array_intersect("h_a", "h_b"))
    good = both.filter(100 * i >= PERCENT * (F.size("h_a") + F.size("h_b") - i))
    return stage_table(good.select(*(F.col(f"{c}_a").alias(c) for c in _NAME)).distinct(), "line-links")


def earlier_matches(docs: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """s1, d, low of the sets that an earlier one matches."""
    post = postings(sets)
    often = stage_table(post.filter(may_be_long()).groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > SHORT).select("key", F.lit(True).alias("often")), "long-lists")
    lists = post.join(F.broadcast(often) if often.count() <= BROADCAST_KEYS else often, "key", "left")
    short = lists.filter("often is null").drop("often")
    long = stage_table(lists.filter("often").drop("often"), "long-postings")
    bands = stage_table(parted_by_size(long), "line-lists")
    near, far = bands.filter(F.col("m") <= SHORT), bands.filter(F.col("m") > SHORT)
    part = ["key", "band"]
    early = F.min(F.struct("d", "low", "s1", "n", "at", "bits", "few", "own"))
    pivots = far.groupBy(*part, F.pmod("s1", F.lit(PIVOTS)).alias("share")).agg(early.alias("p")).select(*part, "p.*")
    pairs = stage_table(joined(short, short, ["key"]).union(joined(near, near, part)).union(joined(far, pivots, part)).distinct(), "line-pairs")
    side = lambda t: pairs.select(*(F.col(f"{c}_{t}").alias(c) for c in _NAME))
    # the sets of long parts come along, so the texts are read once for both rounds
    whole = words_of(docs, side("a").union(side("b")).union(far.select(*_NAME)).distinct(), classes)
    found = matched(pairs, whole)
    cells = F.ceil(F.col("m") / CELL).cast("int")
    left = far.join(found, _NAME, "left_anti").withColumn("cell", F.pmod("s1", cells).cast("int"))
    rest = far.withColumn("cell", F.explode(F.sequence(F.lit(0), cells - 1)))
    return found.union(matched(joined(left, rest, [*part, "cell"]).distinct(), whole))


def removed_lines(docs: DataFrame) -> DataFrame:
    """_d, _r, _gone (sorted line numbers)."""
    classes = rarity_classes(docs)
    lines = stage_table(line_sets(docs, classes), "lines")
    sets = stage_table(distinct_sets(lines), "distinct-lines")
    with scratch(docs.sparkSession, "line-matches"):
        near = stage_table(earlier_matches(docs, sets, classes).distinct(), "line-matches", keep=True)
    near = near.withColumn("near", F.lit(True))
    last = sets.select("s1", "s2", "c", "d", "low").join(near, _NAME, "left").filter("c > 1 or near")
    low = order_part(F.col("_r")) * _PLACES + F.col("line")
    after = (F.col("_d") > F.col("d")) | ((F.col("_d") == F.col("d")) & (low > F.col("low")))
    hit = lines.select("_d", "_r", "line", "s1", "s2").join(last.drop("c"), ["s1", "s2"]).filter(F.col("near").isNotNull() | after)
    return hit.groupBy("_d", "_r").agg(F.sort_array(F.collect_set("line")).alias("_gone"))


def deduped(docs: DataFrame) -> DataFrame:
    """_row (the row of ``docs``, later matching lines taken out of its text), _gone (their numbers), _n_lines."""
    gone = stage_table(removed_lines(docs), "lines-gone")
    # texts are not shuffled while the lines to take out of them are few
    side = F.broadcast(gone) if (gone.agg(F.sum(F.size("_gone") + 4)).first()[0] or 0) <= BROADCAST_GONE else gone
    rows = docs.select(F.struct("*").alias("_row"), *row_key()).join(side, ["_d", "_r"], "left")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    lines = F.split(F.col("_row.text"), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(left)
    n = F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(lines))
    return rows.select(F.col("_row").withField("text", text).alias("_row"), gone.alias("_gone"), n.alias("_n_lines"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later matching lines taken out of ``text``."""
    return deduped(docs).select("_row.*")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers), kept_sha256 of every document."""
    return deduped(docs.select("doc_id", "text")).select(
        "_row.doc_id",
        F.col("_n_lines").cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_removed"),
        F.array_join("_gone", ",").alias("removed"),
        F.sha2(whole_text("_row.text"), 256).alias("kept_sha256"),
    )

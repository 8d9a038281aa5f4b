"""Transaction search, dimension lists, quality counters and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomere.functions import text

from .checkpoints import SCOPE

LIMIT, MOST = 5000, 50_000


def search(
    moves: DataFrame, accounts: DataFrame, instruments: DataFrame, start=None, end=None, account_ids=None, symbols=None, types=None, min_abs_amount: float = 0
) -> DataFrame:
    """Movements with names that pass every filter given."""
    tests = [
        start and F.col("trade_date") >= F.lit(start).cast("date"),
        end and F.col("trade_date") <= F.lit(end).cast("date"),
        account_ids and F.col("account_id").isin(*account_ids),
        types and F.col("txn_type").isin(*types),
        min_abs_amount and F.abs(F.coalesce("net_amount", F.lit(0))) >= min_abs_amount,
    ]
    rows = reduce(lambda df, c: df.filter(c), (t for t in tests if t is not None and not isinstance(t, (bool, int, float, list))), moves)
    rows = rows.join(instruments.select("instrument_id", "symbol"), "instrument_id", "left").join(accounts.select("account_id", "account_number"), "account_id")
    return rows.filter(F.col("symbol").isin(*(s.upper() for s in symbols))) if symbols else rows


def page(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Newest first; row ids are ordered as text."""
    return rows.orderBy(F.desc("trade_date"), F.desc("row_id")).limit(max(1, min(limit, MOST)))


def with_initial(moves: DataFrame, initial: DataFrame) -> DataFrame:
    """Movements and initial positions as one list; what either side lacks is null. ``initial``: account_id, instrument_id, as_of, quantity."""
    first = initial.select(
        F.lit("initial").alias("row_kind"), F.concat_ws("-", F.lit("initial:"), "account_id", "instrument_id").alias("row_id"), "account_id", "instrument_id",
        F.col("as_of").alias("trade_date"), F.lit("initial_position").alias("txn_type"), "quantity",
    )
    return moves.withColumn("row_kind", F.lit("transaction")).unionByName(first, allowMissingColumns=True)


def counted_page(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The newest rows with total_count (of all) and has_more. The limit is kept between 1 and MOST."""
    n = max(1, min(limit, MOST))
    total = rows.agg(F.count("*").alias("total_count"))  # one row
    ordered = rows.orderBy(F.desc("trade_date"), F.desc("row_id"), "txn_type").limit(n)
    return ordered.withColumn("total_count", total.scalar()).withColumn("has_more", F.col("total_count") > n)


def statement_counters(statements: DataFrame, moves: DataFrame, results: DataFrame) -> DataFrame:
    """Movements, unknown effects and unreconciled positions of each statement, in one pass over each input."""
    keys = [*SCOPE, "period_start"]
    by = moves.withColumn("period_start", F.trunc("trade_date", "month")).groupBy(*keys).agg(F.count("*").alias("movements"), F.count_if(F.col("position_delta").isNull()).alias("unknown"))
    bad = results.groupBy("statement_id").agg(F.count_if(F.col("status") == "unexplained").alias("unexplained"))
    rows = statements.join(by, keys, "left").join(bad, "statement_id", "left").fillna(0, ["movements", "unknown", "unexplained"])
    return rows.select("statement_id", "movements", "unknown", "unexplained", (F.col("completeness") != "complete").alias("incomplete"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def weighted_average(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Average weighted by absolute weights; null if any value is, or if the weights are all 0."""
    total = F.sum(F.abs(weight))
    avg = F.when(F.count_if(F.col(value).isNull()) == 0, F.try_divide(F.sum(F.col(value) * F.abs(weight)), total))
    return rows.groupBy(*keys).agg(avg.alias("average"))


def meeting_keys(t: Column) -> Column:
    """Keys of which two token arrays share one if they can be alike: the equal set, two tokens in common, a long first word."""
    own = F.array_sort(t)
    pairs = F.flatten(F.transform(own, lambda x: F.transform(F.filter(own, lambda y: y > x), lambda y: F.concat_ws(" ", F.lit("2"), x, y))))
    word = F.get(t, F.lit(0))
    first = F.when(F.length(word) >= 5, F.concat_ws(" ", F.lit("1"), word))
    return F.array_compact(F.concat(pairs, F.array(F.concat_ws(" ", F.lit("0"), own), first)))


def similar_names(rows: DataFrame) -> DataFrame:
    """left_id, right_id, score of all pairs with a score above 0. ``rows``: id, t (distinct tokens).

    The pairs grow with the square of rows of one name; ``similar_classes`` says the same by classes."""
    known = rows.filter(F.size("t") > 0).select("id", F.array_join("t", " ").alias("s"))
    left, right = known.select(F.col("id").alias("i"), "s"), known.select(F.col("id").alias("j"), F.col("s").alias("z"))
    out = _scored(rows).join(left, "s").join(right, "z").filter((F.col("s") != F.col("z")) | (F.col("i") < F.col("j")))
    return out.select(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id"), "score")


def similar_classes(rows: DataFrame) -> DataFrame:
    """left_id, right_id, score: pairs of class representatives with a score above 0, and each member with its representative.

    Rows with one array of tokens are a class, of which the smallest id stands for all: every row of the
    one class has the score of their representatives with every row of the other, and 1.0 within its own."""
    known = rows.filter(F.size("t") > 0).select("id", F.array_join("t", " ").alias("s"))
    heads = known.groupBy("s").agg(F.min("id").alias("head"))
    pairs = _scored(rows).filter("s != z").join(heads.select("s", F.col("head").alias("i")), "s").join(heads.select(F.col("s").alias("z"), F.col("head").alias("j")), "z")
    members = known.join(heads, "s").filter("id != head").select(F.col("head").alias("left_id"), F.col("id").alias("right_id"), F.lit(1.0).alias("score"))
    return pairs.select(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id"), "score").unionByName(members)


def _scored(rows: DataFrame) -> DataFrame:
    """s, z, score of names, each with itself and the others: once for each two token arrays.

    A score asks for equal sets, two tokens in common or one long first word, so arrays meet by these, and none is missed."""
    known = rows.filter(F.size("t") > 0).select("t", F.array_join("t", " ").alias("s"))
    names = known.select("s", "t").distinct()
    keyed = names.select("s", "t", F.explode(meeting_keys(F.col("t"))).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.s") < F.col("b.s"))).select(F.col("a.s").alias("s"), F.col("b.s").alias("z"), F.col("a.t").alias("x"), F.col("b.t").alias("y")).distinct()
    scored = met.select("s", "z", text.name_similarity(F.col("x"), F.col("y")).alias("score")).filter("score > 0")
    return scored.unionByName(names.select("s", F.col("s").alias("z"), F.lit(1.0).alias("score")))


def paired_classes(rows: DataFrame, row_id: str, keys: list[str], side: str) -> DataFrame:
    """``row_id``, class_id, paired_class, links: rows of equal keys on two sides, each of which pairs with all of the other side.

    Equal keys and sides are a class, named by its smallest id; paired_class is null where the other side is empty. Keys without a value pair with nothing and have no row."""
    known = rows.dropna(subset=[row_id, side, *keys])
    classes = known.groupBy(*keys, side).agg(F.min(row_id).alias("class_id"), F.count("*").alias("n"))
    both = classes.groupBy(*keys).agg(F.collect_list(F.struct(side, "class_id", "n")).alias("cs"))  # two at most
    pick = F.transform("cs", lambda c: F.struct(c[side].alias(side), c["class_id"].alias("class_id"), F.get(F.filter("cs", lambda o: o[side] != c[side]), F.lit(0)).alias("o")))
    links = both.select(*keys, F.inline(pick)).select(*keys, side, "class_id", F.col("o.class_id").alias("paired_class"), F.coalesce("o.n", F.lit(0)).alias("links"))
    return known.join(links, [*keys, side]).select(row_id, "class_id", "paired_class", "links")

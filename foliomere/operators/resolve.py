"""Which instrument a printed row means: a ladder of exact lookups, then names alone.

Every step is a join that keeps an answer only where it is the single one; a later step looks at
what the earlier ones have left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomere.functions import names
from foliomere.functions.text import name_similarity

from .listing import meeting_keys

#: Scores from which a name counts in the row's own account, and in any other; by how much the best must lead.
ACCOUNT, PORTFOLIO, MARGIN = 0.85, 0.97, 0.10


def single(lookup: DataFrame, term: str, instrument: str) -> DataFrame:
    """term, found: terms that name one instrument alone."""
    one = lookup.filter(F.col(term).isNotNull() & (F.col(term) != "")).groupBy(F.col(term).alias("term"))
    return one.agg(F.count_distinct(instrument).alias("n"), F.min(instrument).alias("found")).filter("n = 1").select("term", "found")


def ladder(rows: DataFrame, steps: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """``rows`` with instrument and method of the first step that answers; both null where none does.

    ``steps``: method, column of ``rows``, (term, found) with each term once."""
    out, methods, founds = rows, [], []
    for k, (method, column, lookup) in enumerate(steps):
        out = out.join(lookup.select(F.col("term").alias(f"_t{k}"), F.col("found").alias(f"_f{k}")), F.col(column) == F.col(f"_t{k}"), "left")
        methods.append(F.when(F.col(f"_f{k}").isNotNull(), method))
        founds.append(F.col(f"_f{k}"))
    return out.select(*rows.columns, F.coalesce(*founds).alias("instrument"), F.coalesce(*methods).alias("method"))


def by_name(trades: DataFrame, observed: DataFrame) -> DataFrame:
    """row_id, instrument, score, scope, status of trades that print a name only.

    ``trades``: row_id, account_id, currency, trade_date, line; ``observed``: account_id, currency, instrument, as_of, line of
    holdings. A trade is held against all its account has held in its currency; only where no name there is alike at all,
    against those of any account. The best must lead the next instrument by MARGIN, and in the portfolio say enough:
    PORTFOLIO, with two telling words in common or the one that both names consist of. Names meet by what a score asks
    for, and each two names are scored once."""
    asked = trades.select("row_id", "account_id", "currency", "trade_date", names.name_words(F.col("line")).alias("w"))
    known = observed.select("account_id", "currency", "instrument", "as_of", names.name_words(F.col("line")).alias("w")).filter(F.size("w") > 0).distinct()
    asked, known = (df.withColumn("s", F.array_join("w", " ")) for df in (asked, known))
    telling = lambda w: ~w.isin(*names.GENERIC)
    a = asked.filter(F.size("w") > 0).select("s", "w").distinct().withColumn("key", F.explode(meeting_keys(F.col("w"))))
    b = known.select(F.col("s").alias("z"), F.col("w").alias("v")).distinct().withColumn("key", F.explode(meeting_keys(F.col("v"))))
    met = a.join(b, "key").select("s", "w", "z", "v").distinct()
    common = F.size(F.filter(F.array_intersect("w", "v"), telling))
    one = (F.array_sort("w") == F.array_sort("v")) & (common == 1)
    scores = met.select("s", "z", name_similarity(F.col("w"), F.col("v"), names.GENERIC).alias("score"), ((common >= 2) | one).alias("says_enough")).filter("score > 0")
    # trades that ask the same are answered once
    ask = ["s", "account_id", "currency", "trade_date"]
    asked = asked.withColumn("q", F.to_json(F.struct(*ask)))
    asks = asked.filter(F.size("w") > 0).select("q", *ask).distinct()
    # the best and the next instrument are among the two smallest of each name and scope: what of a name goes before its third has at least its score
    own = _two(known, ["s", "currency", "account_id"]).select(F.col("s").alias("z"), "currency", "account_id", F.explode("two").alias("instrument"))
    any_ = _two(known, ["s", "currency"]).select(F.col("s").alias("z"), "currency", F.explode("two").alias("instrument"))
    met = asks.join(scores, "s")
    inside = met.join(own, ["z", "currency", "account_id"]).withColumn("own", F.lit(True))
    # an account's own holdings go before all others, also where they settle nothing
    left = asks.filter("account_id is not null").join(inside.select("q"), "q", "left_anti")
    outside = left.join(scores, "s").join(any_, ["z", "currency"]).withColumn("own", F.lit(False))
    cols = ["q", *ask, "own", "instrument", "score"]
    each = inside.select(*cols).unionByName(outside.select(*cols)).groupBy(*cols[:-1]).agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "instrument")
    ranked = each.withColumn("k", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).filter("k = 1")
    # of the names that give the best its score, that held nearest to the trade tells whether it says enough
    held = known.select(F.col("s").alias("z"), "currency", "instrument", "as_of", F.col("account_id").alias("held_by"))
    top = ranked.filter("not own").join(scores, ["s", "score"]).join(held, ["z", "currency", "instrument"])
    gap = F.coalesce(F.abs(F.datediff("trade_date", "as_of")), F.lit(10**9))
    enough = top.groupBy("q").agg(F.max(F.struct((-gap).alias("near"), "says_enough"))["says_enough"].alias("says_enough"))
    ranked = ranked.join(enough, "q", "left")
    clear = F.col("next").isNull() | (F.col("score") - F.col("next") >= MARGIN)
    clear &= F.when(F.col("own"), F.col("score") >= ACCOUNT).otherwise((F.col("score") >= PORTFOLIO) & F.col("says_enough"))
    found = ranked.select("q", F.when(clear, F.col("instrument")).alias("instrument"), "score", F.when(F.col("own"), "account").otherwise("portfolio").alias("scope"), F.when(clear, "resolved").otherwise("ambiguous").alias("status"))
    return asked.join(found, "q", "left").select("row_id", "instrument", "score", "scope", "status").fillna("unmatched", ["status"])


def _two(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and two: their two smallest instruments."""
    one = rows.groupBy(*keys).agg(F.min("instrument").alias("least"))
    nxt = rows.join(one, keys).filter("instrument > least").groupBy(*keys).agg(F.min("instrument").alias("second"))
    return one.join(nxt, keys, "left").select(*keys, F.array_compact(F.array("least", "second")).alias("two"))


# Points of a holding that may be what a description means, the least sum, and how near quantities must be.
POINTS = {"word": 6, "all_words": 35, "name": 45, "symbol": 35, "quantity": 25, "currency": 8, "plain": 8}
LEAST, NEAR = 35, 0.001


def by_holdings(trades: DataFrame, held: DataFrame, least: float = LEAST) -> DataFrame:
    """row_id, instrument, score: the holding of a trade's own statement that fits its line best, from ``least`` on.

    ``trades``: row_id, statement_id, line, quantity, currency; ``held``: statement_id, instrument, name, symbol,
    quantity, currency, plain (whether the symbol is one), seq (their order; of equal scores the first counts). A row's own quantity goes before one that its line
    prints; without telling words on either side there is no score."""
    rows = trades.select("row_id", "statement_id", "line", F.col("quantity").alias("q"), F.col("currency").alias("c")).join(held, "statement_id")
    rows = rows.withColumn("w", names.holding_words(F.col("line"))).withColumn("v", names.holding_words(F.col("name"))).filter((F.size("w") > 0) & (F.size("v") > 0))
    common = F.size(F.array_intersect("w", "v"))
    hint = F.coalesce(F.abs("q"), names.shares_hint(F.col("line")))
    title = names.holding_name(F.col("name"))
    points = (
        POINTS["word"] * common
        + F.when((F.size("v") >= 2) & (common == F.size("v")), POINTS["all_words"]).otherwise(0)
        + F.when(F.contains(names.holding_name(F.col("line")), title) & (title != ""), POINTS["name"]).otherwise(0)
        + F.when(F.array_contains("w", F.upper("symbol")), POINTS["symbol"]).otherwise(0)
        + F.when(F.abs(hint - F.abs("quantity")) < NEAR, POINTS["quantity"]).otherwise(0)
        + F.when(F.col("c") == F.col("currency"), POINTS["currency"]).otherwise(0)
        + F.when(F.col("plain"), POINTS["plain"]).otherwise(0)
    )
    best = F.max(F.struct(points.cast("double").alias("score"), (-F.col("seq")).alias("tie"), "instrument")).alias("x")
    return rows.groupBy("row_id").agg(best).select("row_id", "x.instrument", "x.score").filter(F.col("score") >= least)

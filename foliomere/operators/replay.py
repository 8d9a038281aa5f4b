"""Quantities replayed in order, where a movement's effect depends on the position before it.

Sums are enough for most accounts (``checkpoints.holdings_at``). Closing option rows take their
direction from the position that they close, and a ticker change moves a whole position, so these
are replayed: the events of each account, currency, scope and chain of symbols pass in order of time,
and a task holds one chain's positions at a time, never its events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomere.functions.movements import affects_position, closing_delta

#: What a scope is known by, and the position within it.
SCOPE = ["account_id", "currency", "scope_key"]
_RESULT = "key string, instrument string, quantity double, moved boolean, stale boolean, missing boolean, floor date, counted int"


def routed(moves: DataFrame, anchors: DataFrame, held: DataFrame) -> DataFrame:
    """``moves`` with the scope_key that each belongs to; null where several anchored scopes could take it.

    ``anchors``: SCOPE of complete checkpoints; ``held``: SCOPE and instrument of the positions there
    and of initial rows. Movements print no scope: with one anchored scope, the one that holds the
    instrument takes it, else the anchored one; without any it is ``default``."""
    pair = ["account_id", "currency"]
    known = anchors.select(*SCOPE).distinct().groupBy(*pair).agg(F.count("*").alias("_anchored"), F.min("scope_key").alias("_only"))
    own = held.filter("instrument is not null").select(*SCOPE, "instrument").distinct().groupBy(*pair, "instrument").agg(F.count("*").alias("n"), F.min("scope_key").alias("holder"))
    # an account's instruments are one row, so movements are dealt by account once
    own = own.groupBy(*pair).agg(F.map_from_entries(F.collect_list(F.struct("instrument", F.struct("n", "holder")))).alias("_own"))
    rows = moves.join(known, pair, "left").join(own, pair, "left")
    scope = (
        F.when(F.col("_anchored") > 1, F.lit(None).cast("string"))
        .when(F.col("_own")[F.col("instrument")]["n"] == 1, F.col("_own")[F.col("instrument")]["holder"])
        .when(F.col("_anchored") == 1, F.col("_only"))
        .otherwise("default")
    )
    return rows.withColumn("scope_key", scope).drop("_anchored", "_only", "_own")


def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Final positions of each key; events come by key, then in order.

    kind: anchor, initial or a movement's type; day; q; effect; successor and ratio of a ticker change."""
    key, floor, held = None, None, {}

    def done() -> list[tuple]:
        return [(key, i, *s) for i, s in held.items()]

    for b in batches:
        out = []
        for k, i, kind, day, q, effect, successor, ratio in zip(b["key"], b["instrument"], b["kind"], b["day"], b["q"], b["effect"], b["successor"], b["ratio"], strict=True):
            if k != key:
                out += done()
                key, floor, held = k, None, {}
            if kind in ("scope", "anchor", "initial"):
                floor = day if kind == "scope" else floor
                if kind != "scope":
                    held[i] = [q, False, False, False, day, 0]
                continue
            state = held.setdefault(i, [0.0, False, False, False, floor, 0])
            if state[4] is not None and day <= state[4]:
                continue
            if successor is not None:
                new = held.setdefault(successor, [0.0, False, state[2], False, state[4], state[5]])
                new[0] += state[0] * ratio
                new[1], new[5] = True, new[5] + 1
                state[0], state[1] = 0.0, True
                continue
            step = closing_delta(kind, None if pd.isna(q) else q, state[0], None if pd.isna(effect) else effect)
            if step is None:
                state[3] = True
            elif abs(step) > 1e-9:
                state[0] += step
                state[1], state[2], state[5] = True, True, state[5] + 1
        yield pd.DataFrame(out, columns=["key", "instrument", "quantity", "moved", "stale", "missing", "floor", "counted"])
    if key is not None:
        yield pd.DataFrame(done(), columns=["key", "instrument", "quantity", "moved", "stale", "missing", "floor", "counted"])


def replayed(anchors: DataFrame, positions: DataFrame, initial: DataFrame, moves: DataFrame, changes: DataFrame, lineage: DataFrame, at: str) -> DataFrame:
    """account_id, currency, scope_key, instrument, quantity, moved, stale, warnings, movements at a date.

    ``anchors``: SCOPE, as_of of the latest complete checkpoints by the date; ``positions``: SCOPE,
    instrument, quantity at these; ``initial``: account_id, currency, instrument, quantity, as_of, which count
    where no default scope is anchored; ``moves``: account_id, currency, instrument (or null), trade_date,
    move_id, txn_type, quantity, effect; ``changes``: move_id, successor, ratio; ``lineage``: instrument, root.
    Positions of nothing are left out; a movement without a known effect, without an instrument or
    with several scopes to choose from leaves a warning where it may belong."""
    day = F.lit(at).cast("date")
    default = anchors.filter("scope_key = 'default'").select("account_id", "currency")
    first = initial.filter(F.col("as_of") <= day).groupBy("account_id", "currency", "instrument").agg(F.max_by(F.struct("quantity", "as_of"), "as_of").alias("x"))
    first = first.join(default, ["account_id", "currency"], "left_anti").select("account_id", "currency", F.lit("default").alias("scope_key"), "instrument", "x.quantity", "x.as_of")
    held = positions.join(anchors.select(*SCOPE, "as_of"), SCOPE).select(*SCOPE, "instrument", "quantity", "as_of")
    seen = moves.filter(F.col("trade_date") <= day)
    placed = routed(seen.filter("instrument is not null"), anchors, held.unionByName(first)).join(changes, "move_id", "left")

    nothing = {"q": "double", "effect": "double", "successor": "string", "ratio": "double"}
    event = lambda df, order, kind, **cols: df.select(
        *SCOPE, "instrument", F.lit(order).alias("turn"), kind.alias("kind"), *(cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in ({"day": "date", "move_id": "long"} | nothing).items())
    )
    roots = lineage.select("instrument", "root")
    rows = event(held, 1, F.lit("anchor"), day=F.col("as_of"), q=F.col("quantity")).unionByName(event(first, 1, F.lit("initial"), day=F.col("as_of"), q=F.col("quantity")))
    steps = placed.filter("scope_key is not null")
    rows = rows.unionByName(event(steps, 2, F.col("txn_type"), day=F.col("trade_date"), move_id=F.col("move_id"), q=F.col("quantity"), effect=F.col("effect"), successor=F.col("successor"), ratio=F.col("ratio")))
    rows = rows.join(roots, "instrument", "left").withColumn("root", F.coalesce("root", "instrument"))
    # an anchored scope is a floor also for what it does not list
    used = rows.select(*SCOPE, "root").distinct().join(anchors.select(*SCOPE, F.col("as_of").alias("day")), SCOPE)
    floors = used.select(*SCOPE, "root", "root", "day").toDF(*SCOPE, "root", "instrument", "day").select(
        *SCOPE, "root", "instrument", F.lit(0).alias("turn"), F.lit("scope").alias("kind"), "day", F.lit(None).cast("long").alias("move_id"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items())
    )
    rows = rows.unionByName(floors).withColumn("key", F.to_json(F.struct(*SCOPE, "root"), {"ignoreNullFields": "false"}))
    order = ["key", "turn", "day", "move_id", "instrument"]
    final = rows.repartition("key").sortWithinPartitions(*order).select("key", "instrument", "kind", "day", "q", "effect", "successor", "ratio").mapInPandas(fold, _RESULT)
    parts = F.from_json("key", "account_id long, currency string, scope_key string, root string")
    final = final.withColumn("k", parts).select("k.*", "instrument", "quantity", "moved", "stale", "missing", "floor", "counted")

    pair = ["account_id", "currency"]
    several = placed.filter("scope_key is null").select(*pair).distinct().withColumn("several", F.lit(True))
    unnamed = seen.filter(F.col("instrument").isNull() & affects_position(F.col("txn_type"))).groupBy(*pair).agg(F.max("trade_date").alias("unnamed"))
    final = final.join(several, pair, "left").join(unnamed, pair, "left")
    tests = {
        "ambiguous_position_scope_transaction": F.coalesce("several", F.lit(False)),
        "missing_position_delta": F.col("missing"),
        "unresolved_position_transaction": F.col("unnamed").isNotNull() & (F.col("floor").isNull() | (F.col("unnamed") > F.col("floor"))),
    }
    warnings = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in tests.items())))
    return final.filter(F.abs("quantity") > 1e-9).select(*SCOPE, "root", "instrument", "quantity", "moved", "stale", warnings.alias("warnings"), F.col("counted").alias("movements"))


def by_lineage(states: DataFrame) -> DataFrame:
    """One holding for each account, chain of symbols and currency; several states are added up and say so."""
    total = states.groupBy("account_id", "root", "currency").agg(
        F.sum("quantity").alias("quantity"), F.count("*").alias("states"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings"), F.bool_or("stale").alias("stale")
    )
    return total.withColumn("warnings", F.when(F.col("states") > 1, F.array_append("warnings", F.lit("combined_states"))).otherwise(F.col("warnings")))

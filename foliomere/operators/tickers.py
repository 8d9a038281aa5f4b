"""Ticker changes as a graph: which records hold, and the chains that they make.

Records come in an order, and one that would part a chain in two or close it to a ring is refused by what stands before
it. That is decided in rounds for all records at once: a record with nothing undecided before it in its way holds, what it is in the
way of falls, and a ring loses its last record. Chains are walked by doubled steps, so the number of rounds grows
with the logarithm of their length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut


def judged(changes: DataFrame, instruments: DataFrame) -> DataFrame:
    """``changes`` (seq, from_id, to_id, day, ratio, confidence) with fault: what is wrong with a record by itself, null if nothing.

    ``instruments``: instrument_id, asset_type, currency, each id once."""
    side = lambda c: instruments.select(F.col("instrument_id").alias(c), F.struct("asset_type", "currency").alias(f"_{c}"))
    rows = changes.join(side("from_id"), "from_id", "left").join(side("to_id"), "to_id", "left")
    fault = (
        F.when(F.col("_from_id").isNull() | F.col("_to_id").isNull() | (F.col("from_id") == F.col("to_id")), "not two instruments")
        .when(~F.col("_from_id").eqNullSafe(F.col("_to_id")), "type or currency differs")
        .when(~F.coalesce(F.col("ratio") > 0, F.lit(False)), "ratio is not positive")
    )
    return rows.select(*changes.columns, fault.alias("fault"))


def merged(changes: DataFrame) -> DataFrame:
    """Records of one change as one: the first seq, the last ratio, the largest confidence, n of records."""
    return changes.groupBy("from_id", "to_id", "day").agg(F.min("seq").alias("seq"), F.max_by("ratio", "seq").alias("ratio"), F.max("confidence").alias("confidence"), F.count("*").alias("n"))


def unbranched(edges: DataFrame) -> DataFrame:
    """``edges`` with holds: whether none that holds and comes before it leaves its instrument or ends in its other one."""
    rows = edges.withColumn("holds", F.lit(None).cast("boolean"))
    a, b = Window.partitionBy("from_id"), Window.partitionBy("to_id")
    while True:
        first = lambda w: F.min(F.when(F.col("holds").isNull(), F.col("seq"))).over(w)
        now = rows.withColumn("_a", first(a)).withColumn("_b", first(b))
        now = now.withColumn("holds", F.when(F.col("holds").isNotNull(), F.col("holds")).when((F.col("seq") == F.col("_a")) & (F.col("seq") == F.col("_b")), True))
        taken = lambda w: F.bool_or(F.coalesce("holds", F.lit(False))).over(w)
        now = now.withColumn("_a", taken(a)).withColumn("_b", taken(b))
        rows = cut(now.withColumn("holds", F.when(F.col("holds").isNull() & (F.col("_a") | F.col("_b")), False).otherwise(F.col("holds"))).drop("_a", "_b"))
        if rows.filter("holds is null").isEmpty():
            return rows


def walked(edges: DataFrame) -> DataFrame:
    """instrument_id, root, steps, ring, last: where the chain of each instrument begins and how far from there it stands.

    ``edges``: from_id, to_id, seq; none branches. In a ring, root is null, ring its smallest instrument and last its largest seq."""
    nodes = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct()
    up = nodes.join(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("up"), "seq"), "id", "left")
    known = F.col("up").isNotNull()
    state = up.select("id", F.coalesce("up", "id").alias("up"), F.when(known, 1).otherwise(0).alias("steps"), F.least("id", "up").alias("ring"), F.col("seq").alias("last"), (~known).alias("ended"))
    state = cut(state)
    for _ in range(math.ceil(math.log2(state.count() + 1)) + 1):
        other = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("ring").alias("_ring"), F.col("last").alias("_last"), F.col("ended").alias("_ended"))
        both = state.join(other, F.col("up") == F.col("_id"))
        moved = (F.col("_ring") < F.col("ring")) | (F.col("_ended") != F.col("ended"))
        state = cut(both.select("id", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("ring", "_ring").alias("ring"), F.greatest("last", "_last").alias("last"), F.col("_ended").alias("ended"), (moved & ~F.col("ended")).alias("moved")))
        # where no chain has ended and no ring found a smaller instrument, the steps go all the way round
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
    inside = lambda c: F.when(~F.col("ended"), F.col(c)).alias(c)
    return state.select(F.col("id").alias("instrument_id"), F.when(F.col("ended"), F.col("up")).alias("root"), F.when(F.col("ended"), F.col("steps")).alias("steps"), inside("ring"), inside("last"))


def recorded(changes: DataFrame, instruments: DataFrame) -> DataFrame:
    """seq, from_id, to_id, day, ratio, confidence, n, status of all changes: a fault, "branches", "closes a ring" or "recorded".

    Records of one change are one (see ``merged``); one with a fault stands for itself."""
    rows = judged(changes, instruments)
    edges = cut(merged(rows.filter("fault is null")))
    out = ["seq", "from_id", "to_id", "day", "ratio", "confidence", "n"]
    faulty = rows.filter("fault is not null").select(*out[:-1], F.lit(1).cast("long").alias("n"), F.col("fault").alias("status"))
    refused = None
    while True:
        tried = unbranched(edges)
        held = tried.filter("holds")
        places = walked(held.select("from_id", "to_id", "seq"))
        rings = cut(places.filter("ring is not null").select("instrument_id", "ring", "last"))
        if rings.isEmpty():
            break
        # a record that was refused may hold once a ring is broken; rings that none of these leads out of are broken at once
        of = lambda c: rings.select(F.col("instrument_id").alias(c), F.col("ring").alias(f"_{c}"))
        idle = tried.filter("not holds").join(of("from_id"), "from_id", "left").join(of("to_id"), "to_id", "left").filter("not (_from_id <=> _to_id)")
        touched = idle.select(F.explode(F.array_compact(F.array("_from_id", "_to_id"))).alias("ring")).distinct().withColumn("_t", F.lit(True))
        each = rings.groupBy("ring").agg(F.max("last").alias("last")).join(touched, "ring", "left")
        least = each.filter("_t").agg(F.min("last").alias("m")).first()["m"]
        drop = cut(each.filter(F.col("_t").isNull() | (F.col("last") == F.lit(least))).select(F.col("last").alias("seq")))
        now = edges.join(drop, "seq", "left_semi")
        refused = now if refused is None else refused.union(now)
        edges = cut(edges.join(drop, "seq", "left_anti"))
    done = tried.select(*out, F.when(F.col("holds"), "recorded").otherwise("branches").alias("status"))
    if refused is not None:
        done = done.unionByName(refused.select(*out, F.lit("closes a ring").alias("status")))
    return done.unionByName(faulty)


def chains(edges: DataFrame) -> DataFrame:
    """instrument_id, root, place, valid_from, valid_to: each instrument of a chain with the days on which it is the valid one.

    ``edges``: from_id, to_id, day, seq of recorded changes. From is inclusive, to exclusive."""
    at = walked(edges.select("from_id", "to_id", "seq")).select("instrument_id", "root", F.col("steps").alias("place"))
    begun = edges.select(F.col("to_id").alias("instrument_id"), F.col("day").alias("valid_from"))
    over = edges.select(F.col("from_id").alias("instrument_id"), F.col("day").alias("valid_to"))
    return at.join(begun, "instrument_id", "left").join(over, "instrument_id", "left")


def symbol_segments(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """asked, instrument_id, symbol, valid_from, valid_to of the chain that each symbol belongs to.

    ``symbols``: instrument_id, symbol. Where a symbol's instruments stand in several chains, the symbol alone joins
    nothing: its own instruments come without days."""
    own = symbols.join(chains(edges), "instrument_id", "left").withColumn("chain", F.coalesce("root", "instrument_id"))
    name: Column = F.upper("symbol")
    asked = own.groupBy(name.alias("asked")).agg(F.count_distinct("chain").alias("n"), F.min("chain").alias("chain"))
    whole = asked.filter("n = 1").select("asked", "chain").join(own, "chain").select("asked", "instrument_id", "symbol", "valid_from", "valid_to")
    none = F.lit(None).cast("date")
    apart = asked.filter("n > 1").select("asked").join(own.withColumn("asked", name), "asked").select("asked", "instrument_id", "symbol", none.alias("valid_from"), none.alias("valid_to"))
    return whole.union(apart)

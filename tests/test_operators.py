"""Worked examples with nulls, ties and empty inputs."""

import datetime as dt

from pyspark.sql import functions as F

from foliomere.functions import identity, keys, movements, names, text
from foliomere.operators import activity, asof, checkpoints, lineage, listing, lots, market, merge, reconcile, replay, transfers, validation
from foliomere.sources import dumps

D = dt.date


def test_movement_rules(spark):
    """Every type, with and without a sign."""
    adds = ("buy", "buy_to_cover", "transfer_in", "reinvest_dividend", "stock_split_credit", "option_buy_to_open", "option_buy_to_close")
    takes = ("sell", "short_sell", "transfer_out", "stock_split_debit", "option_sell_to_open", "option_sell_to_close")
    want = {k: (abs, abs) for k in adds} | {k: (lambda q: -abs(q),) * 2 for k in takes}
    want |= {k: (lambda q: -q,) * 2 for k in ("option_assignment", "option_exercise", "option_expiration")} | {"journal": (lambda q: q,) * 2, "dividend": (lambda q: 0,) * 2}
    want |= {k: (lambda q: 0, lambda q: None) for k in ("stock_split", "name_change", "spinoff", "merger")}
    rows = spark.createDataFrame([(k, q) for k in want for q in (5.0, -5.0, None)], "k string, q double")
    k, q = F.col("k"), F.col("q")
    got = rows.select("k", "q", movements.quantity_delta(k, q).alias("a"), movements.position_delta(k, q).alias("b"), movements.affects_position(k).alias("c")).collect()
    for r in got:
        legacy, known = want[r.k]
        assert r.a == (0 if r.q is None else legacy(r.q)) and r.b == (None if r.q is None else known(r.q)) and r.c == (r.k != "dividend"), r
    assert set(movements.NON_CASH) == {"reinvest_dividend", "stock_split", "stock_split_credit", "stock_split_debit", "name_change", "spinoff", "merger"}


def test_closing_rows_go_towards_zero():
    f = movements.closing_delta
    assert f("option_expiration", 2.0, -5.0, -2.0) == 2.0 and f("option_exercise", -2.0, 5.0, 2.0) == -2.0
    assert f("option_expiration", 9.0, 5.0, -9.0) == -9.0 and f("option_expiration", 2.0, 0.0, None) is None and f("sell", 2.0, 5.0, -2.0) == -2.0 and f("option_exercise", None, 5.0, None) is None


def test_hollow_stored_effect_stays_unknown(spark):
    row = spark.createDataFrame([("merger", 0.0, 5.0), ("buy", 0.0, 5.0), ("dividend", None, None), ("buy", None, None)], "k string, s double, q double")
    got = row.select(movements.position_effect(F.col("k"), F.col("s"), F.col("q")).alias("e")).collect()
    assert [r.e for r in got] == [None, 0.0, 0.0, None]


def test_money_and_dates(spark):
    rows = spark.createDataFrame([("$1,234.50",), ("(12.00)",), ("7.25-",), ("–3",), ("—",), (None,), ("1-2",), ("2021-03-05",), ("(-4)",), ("$ 5",), ("N/A",), ("--",), (".5",), ("1 2",)], "x string")
    assert [r.v for r in rows.select(text.parse_money(F.col("x")).cast("double").alias("v")).collect()] == [1234.5, -12.0, -7.25, -3.0, None, None, None, None, -4.0, 5.0, None, None, 0.5, None]
    assert spark.range(1).select(text.third_friday(F.lit(2024), F.lit(3)).alias("d")).first().d == D(2024, 3, 15)


def test_decimal_token(spark):
    rows = spark.createDataFrame([(100.0,), (1.50,), (0.0,), (None,)], "x double")
    assert [r.v for r in rows.select(text.decimal_token(F.col("x")).alias("v")).collect()] == ["100", "1.5", "0", ""]


def test_asof_join_takes_equal_dates_and_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, "a", D(2024, 1, 2)), (2, "a", D(2024, 1, 1)), (3, "b", D(2024, 1, 5))], "id int, k string, d date")
    right = spark.createDataFrame([("a", D(2024, 1, 2), 7)], "k string, r date, v int")
    assert {r.id: r.v for r in asof.asof_join(left, right, ["k"], "d", "r", ["v"]).collect()} == {1: 7, 2: None, 3: None}


def test_interval_is_open_before_and_closed_after(spark):
    moves = spark.createDataFrame([(1, "a", D(2024, 1, 31)), (2, "a", D(2024, 2, 1)), (3, "a", D(2024, 3, 1))], "id int, k string, d date")
    points = spark.createDataFrame([("a", D(2024, 1, 31), 10), ("a", D(2024, 2, 29), 20)], "k string, e date, s int")
    assert {r.id: r.s for r in asof.assign_interval(moves, points, ["k"], "d", "e", "s").collect()} == {1: 10, 2: 20}


def test_complete_checkpoint_clears_and_incomplete_does_not(spark):
    st = spark.createDataFrame(
        [(1, 1, "CAD", D(2024, 1, 1), D(2024, 1, 31), "complete"), (2, 1, "CAD", D(2024, 2, 1), D(2024, 2, 29), "unknown")],
        "statement_id int, account_id int, currency string, period_start date, period_end date, completeness string",
    )
    pos = spark.createDataFrame([(1, 1, "CAD", 5, 3.0), (2, 1, "CAD", 5, 99.0)], "statement_id int, account_id int, currency string, instrument_id int, quantity double")
    mv = spark.createDataFrame([(1, "CAD", 5, D(2024, 1, 5), 8.0), (1, "CAD", 5, D(2024, 2, 5), 2.0), (1, "CAD", 6, D(2024, 2, 6), None)], "account_id int, currency string, instrument_id int, trade_date date, position_delta double")
    got = checkpoints.holdings_at(st, pos, mv, F.lit("2024-02-29").cast("date")).collect()
    assert [(r.instrument_id, r.quantity, r.state) for r in got] == [(5, 5.0, "reconstructed")]
    assert checkpoints.holdings_at(st.limit(0), pos, mv.limit(0), F.lit("2024-02-29").cast("date")).count() == 0


def test_transfers_are_paired_once_and_ties_are_ambiguous(spark):
    rows = [("o1", 1, D(2024, 1, 1), -5.0), ("o2", 1, D(2024, 1, 2), -5.0), ("i1", 2, D(2024, 1, 3), 5.0), ("o3", 1, D(2024, 6, 2), -5.0), ("i2", 2, D(2024, 6, 1), 5.0), ("i3", 3, D(2024, 6, 3), 5.0), ("i4", 1, D(2024, 1, 2), 5.0)]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, row_id string, account_id int, day date, quantity double")
    got = {r.out_id: (r.in_id, r.status) for r in transfers.pair_transfers(df, ["k"]).collect()}
    assert got == {"o1": ("i1", "paired"), "o2": (None, "unmatched"), "o3": (None, "ambiguous")}


def test_segments(spark):
    ch = spark.createDataFrame([("A", "B", D(2020, 1, 1)), ("B", "C", D(2021, 1, 1))], "old string, new string, day date")
    assert {(r.root, r.symbol, r.valid_from, r.valid_to) for r in lineage.segments(ch).collect()} == {
        ("A", "A", None, D(2020, 1, 1)), ("A", "B", D(2020, 1, 1), D(2021, 1, 1)), ("A", "C", D(2021, 1, 1), None)}


def test_weighted_average_is_null_with_a_null(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", 4.0, -3.0), ("b", None, 1.0), ("c", 1.0, 0.0)], "k string, v double, w double")
    assert {r.k: r.average for r in listing.weighted_average(df, ["k"], "v", "w").collect()} == {"a": 3.5, "b": None, "c": None}


def test_dumps(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\nfirst\n\nsecond\n----- PAGE BREAK -----\n# kept\n")
    docs = dumps.read_dumps(spark, str(tmp_path))
    assert [(r.page, r.line, r.text) for r in dumps.page_lines(docs).orderBy("page", "line").collect()] == [(1, 1, "first"), (1, 3, "second"), (2, 1, "# kept")]
    assert dumps.image_only(docs).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from foliomere.streaming import resample

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    src.write.parquet(str(tmp_path / "in" / "a"))
    q = resample.windowed(resample.read_events(spark, str(tmp_path / "in" / "*"), src.schema)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = resample.windowed(src)
    assert spark.table("w").count() == batch.count() > 0


def test_activity_lines(spark):
    rows = [("Dec 31 BOUGHT S1 10 (1,250.50)", D(2024, 1, 31)), ("Jan5 SOLD SHORT AB.C 3 $9", D(2024, 1, 31)), ("Opening balance", D(2024, 1, 31)), (None, None), ("Feb 30 SOLD X 1 1", D(2024, 3, 31))]
    got = activity.parsed(spark.createDataFrame(rows, "line string, period_end date"))
    found = {r.line: (r.trade_date, r.txn_type, r.symbol, r.quantity and float(r.quantity), r.amount and float(r.amount)) for r in got.collect()}
    assert found["Dec 31 BOUGHT S1 10 (1,250.50)"] == (D(2023, 12, 31), "buy", "S1", 10.0, -1250.5)
    assert found["Jan5 SOLD SHORT AB.C 3 $9"] == (D(2024, 1, 5), "short_sell", "AB.C", 3.0, 9.0)
    assert found["Opening balance"] == (None,) * 5 and found["Feb 30 SOLD X 1 1"][0] is None
    assert activity.rejected(got).count() == 3


def test_later_frames_win_where_they_are_set(spark):
    a = spark.createDataFrame([(1, 5.0, 1), (2, 6.0, 2)], "k int, x double, y int")
    b = spark.createDataFrame([(1, None), (2, 7.0), (3, 8.0)], "k int, x double")
    got = {r.k: (r.x, r.y) for r in market.merged_fields([a, b], ["k"], ["x", "y"]).collect()}
    assert got == {1: (5.0, 1), 2: (7.0, 2), 3: (8.0, None)}
    first = {r.k: r.x for r in market.first_provider([a.select("k", "x"), b], ["k"]).collect()}
    assert first == {1: 5.0, 2: 6.0, 3: 8.0}


def test_combined_totals_take_direct_then_inverse_rates(spark):
    totals = spark.createDataFrame([("CAD", 100), ("USD", 200), ("EUR", 300)], "currency string, value_cents long")
    rates = spark.createDataFrame([("USD", "CAD", D(2024, 1, 1), 125), ("USD", "CAD", D(2024, 3, 1), 999)], "base string, quote string, rate_date date, rate_cents long")
    at = F.lit("2024-02-01").cast("date")
    assert {r.currency: r.combined_cents for r in market.combined(totals, rates, "CAD", at).collect()} == {"CAD": 100, "USD": 250, "EUR": None}
    assert {r.currency: r.combined_cents for r in market.combined(totals, rates, "USD", at).collect()} == {"CAD": 80, "USD": 200, "EUR": None}


def test_lots_merge_and_unknown_stays_unknown(spark):
    rows = [(1, "a", 1.0, 2.0, 5.0), (1, "a", 1.0, 2.0, 5.0), (1, "b", 3.0, 2.0, None), (2, "c", 1.0, 1.0, 1.0), (2, "d", 1.0, 4.0, 1.0)]
    out = lots.merge_lots(spark.createDataFrame(rows, "k int, raw_line string, quantity double, price double, book_value double"), ["k"])
    assert {r.k: (r.lots, r.quantity, r.book_value, r.price) for r in out.collect()} == {1: (2, 4.0, None, 2.0), 2: (2, 2.0, 2.0, None)}
    ids = spark.createDataFrame([(3, "x", None), (1, "x", None), (2, "x", "y")], "id int, a string, b string")
    assert {r.id: r.kept_id for r in lots.oldest_ids(ids, ["a", "b"], "id").collect()} == {3: 1, 1: 1, 2: 2}


def test_cash_at_counts_unknown_effects(spark):
    rows = [(1, "CAD", D(2024, 1, 1), "buy", -5.0), (1, "CAD", D(2024, 1, 2), "sell", None), (1, "CAD", D(2024, 1, 2), "journal", 9.0), (1, "CAD", D(2024, 2, 1), "sell", 7.0)]
    moves = spark.createDataFrame(rows, "account_id int, currency string, cash_effective_date date, txn_type string, net_amount double")
    assert [(r.balance, r.missing) for r in reconcile.cash_at(moves, F.lit("2024-01-31").cast("date")).collect()] == [(4.0, 1)]


def test_iso_dates(spark):
    rows = spark.createDataFrame([("2024-02-29",), ("2024-2-9",), ("2023-02-29",), (None,)], "x string")
    assert [r.ok for r in rows.select(keys.is_iso_date(F.col("x")).alias("ok")).collect()] == [True, False, False, False]


def test_events_take_the_rate_of_their_day(spark):
    from foliomere.plans import queries

    class Tables:
        def fx(self):
            return spark.createDataFrame([(D(2024, 1, 1), 120), (D(2024, 1, 3), 130)], "rate_date date, rate_cents long")

        def raw(self, name):
            days = [(1, "2023-12-31"), (2, "2024-01-01"), (3, "2024-01-02"), (4, "2024-01-03"), (5, "2024-02-01"), (6, None)]
            return spark.createDataFrame(days, "event_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))

    assert {r.event_id: r.rate_cents for r in queries.asof_fx(Tables()).collect()} == {1: None, 2: 120, 3: 120, 4: 130, 5: 130, 6: None}


def test_similar_names_are_those_of_all_pairs(spark):
    import itertools

    words = ["LARGE", "SMALL", "RED", "HOT", "RING", "BOLT"]
    names = ["", *words, *(" ".join(x) for n in (2, 3) for x in itertools.permutations(words[:5], n)), "RED HOT", "RED RED"]
    rows = spark.createDataFrame([(1000 - k, x) for k, x in enumerate(names)], "id int, x string").select("id", text.name_tokens(F.col("x")).alias("t"))
    a, b = rows.alias("a"), rows.alias("b")
    every = a.join(b, F.col("a.id") < F.col("b.id")).select("a.id", "b.id", text.name_similarity(F.col("a.t"), F.col("b.t")).alias("score")).filter("score > 0")
    got = listing.similar_names(rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, every.collect())) and got


def test_whole_queries_reach_all_ids(spark):
    from foliomere.plans import queries

    got = queries.QUERIES["correlation_all"](spark, "/root/testdata/sf0.001").agg(F.max("left_id").alias("high"), F.count("*").alias("n")).first()
    assert got.high == 49 and got.n > 144
    assert queries.QUERIES["name_similarity_all"](spark, "/root/testdata/sf0.01").agg(F.max("right_id")).first()[0] > 1900


def test_transfers_equal_the_plain_greedy_choice(spark):
    import random

    rng = random.Random(9)
    moves = [(k, f"{k}{n:04}", rng.choice([1, 2, 3, 4, None]), D(2024, 1, 1) + dt.timedelta(rng.randrange(span)), rng.choice([-5.0, 5.0, -7.0, 7.0])) for k, span in (("a", 30), ("b", 300), ("c", 900)) for n in range(300)]
    want = {}
    for k in "abc":
        for size in (5.0, 7.0):
            own = sorted((m[3], m[1], m[2], m[4]) for m in moves if m[0] == k and abs(m[4]) == size)
            free = [m for m in own if m[3] > 0]
            for day, o, account, q in own:
                if q > 0:
                    continue
                near = sorted((abs((d - day).days), i) for d, i, a, _ in free if (a is None or a != account) and abs((d - day).days) <= 7)
                if not near:
                    want[o] = (None, None, "unmatched")
                elif len(near) > 1 and near[0][0] == near[1][0]:
                    want[o] = (None, near[0][0], "ambiguous")
                else:
                    want[o] = (near[0][1], near[0][0], "paired")
                    free = [m for m in free if m[1] != near[0][1]]
    df = spark.createDataFrame(moves, "k string, row_id string, account_id int, day date, quantity double")
    assert {r.out_id: (r.in_id, r.days, r.status) for r in transfers.pair_transfers(df, ["k"]).collect()} == want
    assert {x[2] for x in want.values()} == {"unmatched", "ambiguous", "paired"}


def test_transfers_hold_counts_of_a_few_days_alone():
    """A chain without gaps passes in many batches, and its length does not slow a row."""
    import time

    import pandas as pd

    start, days = time.time(), 100_000
    rows = [x for d in range(days) for x in (("g", d, 0, "1", f"i{d}", 1), ("g", d, 1, "2", f"o{d}", 0))]
    parts = (pd.DataFrame(rows[k : k + 1000], columns=["g", "day", "side", "account", "row_id", "n"]) for k in range(0, len(rows), 1000))
    got = pd.concat(transfers.greedy(parts))
    assert len(got) == days and (got.status == "paired").all() and time.time() - start < 60


def test_currencies_of_one_account_stay_apart(spark):
    st = spark.createDataFrame(
        [(1, 1, "CAD", D(2024, 1, 1), D(2024, 1, 31), "complete"), (2, 1, "USD", D(2024, 1, 1), D(2024, 1, 31), "complete"), (3, 1, "USD", D(2024, 2, 1), D(2024, 2, 29), "unknown")],
        "statement_id int, account_id int, currency string, period_start date, period_end date, completeness string",
    )
    pos = spark.createDataFrame([(1, 1, "CAD", 5, 3.0), (2, 1, "USD", 6, 4.0)], "statement_id int, account_id int, currency string, instrument_id int, quantity double")
    mv = spark.createDataFrame([(1, "CAD", 5, D(2024, 2, 5), 9.0)], "account_id int, currency string, instrument_id int, trade_date date, position_delta double")
    at = F.lit("2024-02-29").cast("date")
    held = checkpoints.holdings_at(st, pos, mv, at)
    assert {(r.currency, r.instrument_id, r.quantity) for r in held.collect()} == {("CAD", 5, 12.0), ("USD", 6, 4.0)}
    flags = {r.currency: r.incomplete_scope for r in checkpoints.quality_flags(held, st, at).collect()}
    assert flags == {"CAD": False, "USD": True}


def replay_frames(spark, moves, anchors=(), positions=(), initial=(), changes=(), lineage_rows=()):
    frame = spark.createDataFrame
    return (
        frame(list(anchors), "account_id long, currency string, scope_key string, as_of date"),
        frame(list(positions), "account_id long, currency string, scope_key string, instrument string, quantity double"),
        frame(list(initial), "account_id long, currency string, instrument string, quantity double, as_of date"),
        frame(moves, "account_id long, currency string, instrument string, trade_date date, move_id long, txn_type string, quantity double, effect double"),
        frame(list(changes), "move_id long, successor string, ratio double"),
        frame(list(lineage_rows), "instrument string, root string"),
    )


def test_replay_takes_direction_scope_and_ticker_changes_in_order(spark):
    d = lambda n: D(2024, 3, n)
    moves = [
        (1, "CAD", "opt", d(2), 1, "option_sell_to_open", 5.0, -5.0), (1, "CAD", "opt", d(3), 2, "option_expiration", 2.0, -2.0), (1, "CAD", "opt", d(1), 3, "buy", 9.0, 9.0),
        (1, "CAD", "A", d(4), 4, "buy", 10.0, 10.0), (1, "CAD", "A", d(5), 5, "name_change", None, None), (1, "CAD", "B", d(6), 6, "sell", 4.0, -4.0),
        (1, "CAD", "x", d(7), 7, "merger", 1.0, None), (1, "CAD", "x", d(8), 8, "buy", 1.0, 1.0), (1, "CAD", None, d(9), 9, "buy", 1.0, 1.0), (1, "CAD", "x", d(30), 10, "buy", 99.0, 99.0),
        (2, "USD", "A", d(4), 11, "buy", 2.0, 2.0), (3, "USD", "A", d(4), 12, "buy", 2.0, 2.0), (4, "CAD", "i", d(4), 13, "sell", 1.0, -1.0),
    ]
    anchors = [(1, "CAD", "default", d(1)), (2, "USD", "margin", d(1)), (2, "USD", "cash", d(1))]
    positions = [(1, "CAD", "default", "A", 20.0), (2, "USD", "margin", "A", 7.0)]
    initial = [(4, "CAD", "i", 3.0, d(1)), (4, "CAD", "i", 5.0, d(2)), (1, "CAD", "z", 8.0, d(1))]
    frames = replay_frames(spark, moves, anchors, positions, initial, [(5, "B", 2.0)], [("A", "A"), ("B", "A")])
    got = {(r.account_id, r.instrument): (r.quantity, r.warnings) for r in replay.replayed(*frames, "2024-03-20").collect()}
    lost = "unresolved_position_transaction"
    assert got == {
        (1, "opt"): (-3.0, [lost]), (1, "B"): (56.0, [lost]), (1, "x"): (1.0, ["missing_position_delta", lost]),
        (2, "A"): (7.0, ["ambiguous_position_scope_transaction"]), (3, "A"): (2.0, []), (4, "i"): (4.0, []),
    }
    held = {(r.account_id, r.root): r.quantity for r in replay.by_lineage(replay.replayed(*frames, "2024-03-20")).collect()}
    assert held[(1, "A")] == 56.0
    assert replay.replayed(*(f.limit(0) for f in frames), "2024-03-20").count() == 0


def test_replay_equals_the_plain_fold(spark):
    import random

    rng = random.Random(3)
    kinds = ("buy", "sell", "option_expiration", "option_assignment", "option_sell_to_open", "merger", "dividend")
    moves, want = [], {}
    for n in range(800):
        k, q = rng.choice(kinds), rng.choice([1.0, 2.0, -3.0, None])
        effect = None if q is None or k == "merger" else {"buy": abs(q), "sell": -abs(q), "option_sell_to_open": -abs(q), "dividend": 0.0}.get(k, -q)
        moves.append((rng.randrange(3), rng.choice(["CAD", "USD"]), f"i{rng.randrange(4)}", D(2024, 1, 1) + dt.timedelta(rng.randrange(60)), n, k, q, effect))
    for a, c, i, _, _, k, q, e in sorted(moves, key=lambda m: (m[3], m[4])):
        step = movements.closing_delta(k, q, want.get((a, c, i), 0.0), e)
        want[(a, c, i)] = want.get((a, c, i), 0.0) + (step or 0.0)
    got = {(r.account_id, r.currency, r.instrument): r.quantity for r in replay.replayed(*replay_frames(spark, moves), "2025-01-01").collect()}
    assert got == {k: q for k, q in want.items() if abs(q) > 1e-9}


def test_names_and_keys(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(names.name_words(F.lit("Bought BMO  Rty Income ETF 20 yr 1000 AB-123456 10 $5.00 50.00 rest"))) == ["BMO", "REALTY", "INCOME", "20", "YEAR"]
    assert get(names.strip_leading(F.lit(" Dividend:  BOUGHT  Acme  corp"))) == "Acme corp" and get(names.made_symbol(F.lit("SOLD ACME Corp. of the north 1,000.5"))) == "ACME_CORP_OF_THE"
    assert get(names.made_symbol(F.lit(None).cast("string"))) == "UNKNOWN" and get(text.layout_text(F.lit("a\u00a0\u2013  b"))) == "a - b" and get(names.shares_hint(F.lit("div on 1,200 shs"))) == 1200.0
    rules = [("GOLD", "G", "equity"), ("BARRICK", "ABX", "equity")]
    assert get(names.resolved(F.lit("Barrick  gold"), rules)).ticker == "ABX" and get(names.resolved(F.lit("silver"), rules)) is None
    key = lambda **kw: get(identity.instrument_key(*(F.lit(v) for v in kw.values())))
    assert key(kind="equity", symbol=" brk b", currency="usd") == "ik1|EQUITY|BRKB|USD"
    full = identity.instrument_key(F.lit("option"), F.lit("x"), F.lit("USD"), F.lit(" t d"), F.lit("2024-01-19"), F.lit("80.50").cast("decimal(18,4)"), F.lit("call"))
    assert get(full) == "ik1|OPTION|TD|USD|2024-01-19|80.5|CALL|100" and get(identity.quoted_token(F.lit("a  b*c~d/e+"))) == "A%20B%2AC~D%2FE%2B"
    assert [get(c) for c in identity.ledger_symbol(F.lit("brk-b.to"))] == ["BRK.B", "TSX"]
    assert get(text.parse_date(F.lit("SEPT 5"), F.lit(2024))) == D(2024, 9, 5) and get(text.parse_date(F.lit("13/02/2024"))) == D(2024, 2, 13) and get(text.parse_date(F.lit("02/03/2024,"))) == D(2024, 2, 3)
    assert get(text.option_expiry(F.lit("25 JA"))) == D(2025, 1, 17) and get(text.option_expiry(F.lit("1/17/25"))) == D(2025, 1, 17) and get(text.option_expiry(F.lit("XX 25"))) is None


def test_merges_and_facts(spark):
    old = spark.createDataFrame([(1, "a", "x", 0, "k"), (2, "b", None, 1, "k")], "id int, name string, nick string, flag int, first string")
    new = spark.createDataFrame([(1, None, None, 1, "n"), (3, "c", "z", 0, "n")], "id int, name string, nick string, flag int, first string")
    rules = {"name": merge.TAKE_NEW, "nick": merge.KEEP_SET, "flag": merge.LARGEST, "first": merge.KEEP_OLD}
    assert {tuple(r) for r in merge.merged(old, new, ["id"], rules).collect()} == {(1, None, "x", 1, "k"), (2, "b", None, 1, "k"), (3, "c", "z", 0, "n")}
    row = lambda v, filed, form="10-K": {"end": "2023-12-31", "val": v, "form": form, "fp": "FY", "filed": filed}
    import json

    doc = json.dumps({"facts": {"gaap": {"Revenues": {"units": {"USD": [row(5.0, "2024-02-01"), row(6.0, "2024-05-01"), row(9.0, "2024-09-01", "8-K")]}}}}})
    facts = merge.company_facts(spark.createDataFrame([("S", doc), ("T", None), ("U", "{")], "symbol string, json string")).collect()
    assert [(r.symbol, r.tag, r.value) for r in facts] == [("S", "Revenues", 6.0)]


def test_instrument_rules_and_quarantine(spark):
    cols = "id string, asset_type string, symbol string, currency string, row_currency string, root string, expiry string, strike double, option_type string, multiplier int"
    rows = [("ok", "option", "X", "CAD", "CAD", "X", "2024-01-19", 5.0, "call", 100), ("bad", "option", "", "EUR", "CAD", "X", "soon", None, "both", 0), ("kind", "gold", "G", "USD", None, None, None, None, None, None)]
    got = validation.issues(spark.createDataFrame(rows, cols), validation.instrument_rules(), "id").collect()
    broken = {"missing_symbol", "invalid_currency", "instrument_currency_mismatch", "incomplete_option_identity", "invalid_option_type", "invalid_option_expiry", "invalid_option_multiplier", "missing_numeric"}
    assert {(r.subject, r.issue) for r in got} == {("bad", k) for k in broken} | {("kind", "invalid_asset_type")}
    dated = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 2, 5),), (None,)], "d date").withColumns({"a": F.lit(D(2024, 1, 1)), "z": F.lit(D(2024, 1, 31))})
    kept, out = validation.split_quarantine(dated, "a", "z", "d")
    assert kept.count() == 1 and {r.reason for r in out.collect()} == {"no date", "date outside period"}


def test_trades_by_name_equal_all_pairs(spark):
    import random

    from foliomere.operators import resolve

    rng = random.Random(5)
    words = ["BARRICK", "GOLD", "MINING", "GLOBAL", "ENERGY", "NORTH", "RES", "BOND"]
    line = lambda: " ".join(rng.sample(words, rng.randrange(1, 4)))
    trades = [(k, rng.randrange(4), rng.choice(["CAD", "USD"]), D(2024, 1, rng.randrange(1, 28)), line()) for k in range(90)] + [(90, 9, "CAD", None, "10 5 50"), (91, 9, "CAD", D(2024, 1, 1), "ENERGY")]
    held = [(rng.randrange(3), rng.choice(["CAD", "USD"]), rng.randrange(12), D(2024, 1, rng.randrange(1, 28)), line()) for _ in range(40)]
    held += [(7, "CAD", 50, None, "NORTH BOND ENERGY"), (8, "EUR", 60, D(2024, 1, 1), "GOLD MINING"), (6, "EUR", 61, D(2024, 1, 1), "ENERGY")]
    trades += [(92, 1, "EUR", D(2024, 1, 1), "GOLD MINING NORTH"), (93, 1, "EUR", D(2024, 1, 1), "ENERGY")]
    a = spark.createDataFrame(trades, "row_id int, account_id int, currency string, trade_date date, line string")
    b = spark.createDataFrame(held, "account_id int, currency string, instrument int, as_of date, line string")
    full = {"RES": "RESOURCES"}

    def score(x, y):
        both, either = len(set(x) & set(y)), len(set(x) | set(y))
        if set(x) == set(y):
            return 1.0
        if both >= 2 and both == min(len(x), len(y)):
            return 0.97
        if both >= 2 and both / either >= 0.55 and both / min(len(x), len(y)) >= 0.75:
            return 0.9
        return 0.86 if x[0] == y[0] and x[0] != "GLOBAL" and len(x[0]) >= 5 else 0.0

    want, said = {}, lambda t: [full.get(w, w) for w in t.split() if not w.isdigit()]
    for k, account, currency, day, text_ in trades:
        x = said(text_)
        for scope in ("account", "portfolio"):
            best = {}
            for other, c, instrument, at, name in held:
                if x and c == currency and (scope == "portfolio" or other == account) and (s := score(x, said(name))):
                    gap = -abs((day - at).days) if day and at else -(10**9)
                    both = set(x) & set(said(name)) - {"GLOBAL"}
                    best[instrument] = max(best.get(instrument, (0,)), (s, gap, len(both) >= 2 or (set(x) == set(said(name)) and len(both) == 1)))
            order = sorted(best.items(), key=lambda i: (-i[1][0], i[0]))
            if order:
                (top, (s, _, enough)), after = order[0], order[1:]
                clear = (not after or s - after[0][1][0] >= 0.1) and (scope == "account" or (s >= 0.97 and enough))
                want[k] = (top if clear else None, s, scope, "resolved" if clear else "ambiguous")
                break
        else:
            want[k] = (None, None, None, "unmatched")
    got = {r.row_id: (r.instrument, r.score, r.scope, r.status) for r in resolve.by_name(a, b).collect()}
    assert got == want and len({v[2:] for v in want.values()}) == 5
    # a close rival keeps a portfolio name open; a single telling word that is the whole name does not
    assert got[92] == (60, 0.97, "portfolio", "resolved") and got[93] == (61, 1.0, "portfolio", "resolved")


def test_best_holding_of_the_statement(spark):
    from foliomere.operators import resolve

    trades = spark.createDataFrame([(1, 9, "DIVIDEND Acme Corp Energy ON 40 SHS", None, "CAD"), (2, 9, "nothing alike", 1.0, "CAD"), (3, 9, "Acme Mining ON 40 SHS", 7.0, "EUR"), (4, 9, "1,000 - $5", 40.0, "CAD")], "row_id int, statement_id int, line string, quantity double, currency string")
    held = spark.createDataFrame([(9, 5, "ACME ENERGY", "AE", 40.0, "CAD", True, 1), (9, 6, "ACME MINING", "AM", 7.0, "USD", False, 2), (9, 7, "", "X", 40.0, "CAD", True, 3)], "statement_id int, instrument int, name string, symbol string, quantity double, currency string, plain boolean, seq int")
    got = {r.row_id: (r.instrument, r.score) for r in resolve.by_holdings(trades, held).collect()}
    assert got == {1: (5, 12 + 35 + 25 + 8 + 8), 3: (6, 12 + 35 + 45 + 25)}  # a row's own quantity goes before the printed one


def test_printed_values_and_keys(spark):
    import hashlib
    import json

    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert [get(text.parse_money(F.lit(x)).cast("double")) for x in ("0.123456", "123456789012345.5", "(0.00000001)")] == [0.123456, 123456789012345.5, -1e-8]
    assert [get(text.parse_date(F.lit(x))) for x in ("01/17/98", "1/2/03", "12/31/68", "1/1/69", "2/29/96")] == [D(1998, 1, 17), D(2003, 1, 2), D(2068, 12, 31), D(1969, 1, 1), D(1996, 2, 29)]
    raw = "Caf\u00e9 \u2013 1 \U0001f600"
    fields = {"kind": "POSITION", "occurrence": 2, "raw": raw, "rule": "", "source": "a.txt"}
    want = "ev2:" + hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert get(identity.evidence_key(F.lit("a.txt"), F.lit("position"), F.lit(2), F.lit(raw), F.lit(None).cast("string"))) == want
    assert get(identity.quoted_token(F.lit(" \uff21\u00a0b "))) == "A%20B"
    assert [get(names.made_symbol(F.lit(x))) for x in ("Acme 5YR note 2,000.5", "5 Acme", "---")] == ["ACMEYR_NOTE", "5_ACME", "UNKNOWN"]
    assert [get(names.name_prefix(F.lit(x))) for x in ("BOUGHT Acme|Corp WO-123456 10 5.00 $50.00 rest", "sell 3 for one", "Bought")] == ["ACME CORP", "3 FOR ONE", "BOUGHT"]



def test_evidence_places_and_boxes(spark):
    from foliomere.operators import evidence

    pages = spark.createDataFrame([("a", 1, "abc"), ("a", 2, "defg")], "relpath string, page int, text string")
    offsets = evidence.page_offsets(pages)
    assert {(r.page, r.first, r.last) for r in offsets.collect()} == {(1, 0, 3), (2, 4, 8)}
    spans = spark.createDataFrame([("a", 1, 0, 2), ("a", 2, 2, 5)], "relpath string, span_id int, first int, last int")
    assert {r.span_id: r.pages for r in evidence.pages_of(spans, offsets).collect()} == {1: [1], 2: [1, 2]}
    box = lambda *v: dict(zip(("x0", "top", "x1", "bottom"), v, strict=True))
    row = spark.createDataFrame([([box(1.0, 2.0, 3.0, 4.0), box(5.0, 1.0, 6.0, 4.5)], ["a", "b", "a", "c"])], "w array<struct<x0:double,top:double,x1:double,bottom:double>>, t array<string>")
    got = row.select(evidence.union_box(F.col("w"), F.lit(0), F.lit(2)).alias("b"), evidence.subsequence_at(F.array(F.lit("a"), F.lit("c")), F.col("t")).alias("k"), evidence.subsequence_at(F.array(F.lit("z")), F.col("t")).alias("n")).first()
    assert tuple(got.b) == (1.0, 1.0, 6.0, 4.5) and got.k == 2 and got.n is None
    lines = spark.createDataFrame([("a", 1, 1, "Same line"), ("a", 2, 1, "same  LINE"), ("a", 2, 2, "A much longer line here")], "relpath string, page int, line int, text string")
    asked = spark.createDataFrame([("a", 1, "same line", None, None), ("a", 2, "same line", 2, None), ("a", 3, "much longer line", None, None), ("a", 4, "other", None, None)], "relpath string, row_id int, raw string, page_hint int, line_hint int")
    assert {r.row_id: (r.page, r.line, r.method) for r in evidence.located(asked, lines).collect()} == {1: (None, None, "ambiguous"), 2: (2, 1, "exact"), 3: (2, 2, "contained"), 4: (None, None, "unmatched")}


def test_sinks(spark, tmp_path):
    from foliomere.sinks import files

    rows = spark.createDataFrame([(2, "b", "secret"), (1, "a", None)], "k int, x string, raw string")
    files.write_index(rows, str(tmp_path / "i"), ["k"], ("raw",))
    shown = [r.value for r in spark.read.text(str(tmp_path / "i")).collect()]
    assert sorted(shown)[0] == '{"k":1,"raw_ref":null,"x":"a"}' and "secret" not in "".join(shown)
    docs = spark.createDataFrame([("f", f"d{k}") for k in range(5)] + [("g", "e")], "folder string, relpath string")
    assert {(r.folder, r.relpath) for r in files.sampled(docs, "folder", "relpath").collect()} == {("f", "d0"), ("f", "d2"), ("f", "d4"), ("g", "e")}
    for price in (1.0, 2.0):
        files.write_market(spark.createDataFrame([("A", price)] + ([("B", price)] if price == 1 else []), "symbol string, close double"), str(tmp_path / "m"))
    assert {(r.symbol, r.close) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {("A", 2.0), ("B", 1.0)}
    files.write_dumps(spark.createDataFrame([("x.txt", ["one", "two"])], "relpath string, pages array<string>"), str(tmp_path / "d"), "---")
    assert [r.value for r in spark.read.text(str(tmp_path / "d"), wholetext=True).collect()][0].strip() == "one\n---\ntwo"
    files.append_log(rows, str(tmp_path / "l"))
    files.append_log(rows, str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 4


STATEMENT = """Account number: AB-123
Period: Jan 1, 2024 to Jan 31, 2024
Canadian dollar account
Holdings
Acme Corp (ACM) 10 5.00 40.00 50.00
CALL ACM JA 25 12.5 -2 1.00 (200.00)
Broken row 1 2
Total holdings (150.00)
Activity
Opening balance $1,000.00
Jan 5 BOUGHT Acme Corp 10 5.00 50.00
Jan6 SOLD CALL ACM JA 25 -2 1.00 200.00
Jan 9 TRANSFER IN Beta 7 0.00
Feb 2 DIVIDEND Acme 3.00
Jan 10 GIFT of things 9.00
Closing balance $1,150.00
U.S. dollar account
Activity
Jan 3 FEE monthly 5.00
Important information
Jan 4 BOUGHT nothing 1 1.00 1.00"""


def test_statement_text_to_rows(spark):
    from foliomere.operators import statements

    lines = spark.createDataFrame([("a.txt", 1, k + 1, t) for k, t in enumerate(STATEMENT.split("\n"))], "relpath string, page int, line int, text string")
    layout = statements.Layout()
    rows = statements.carried(lines, layout)
    held = statements.holdings(rows, layout).orderBy("line").collect()
    assert [(r.asset_type, r.symbol, float(r.quantity), float(r.market_value), r.account, r.currency) for r in held] == [("equity", "ACM", 10.0, 50.0, "AB-123", "CAD"), ("option", "ACM", -2.0, -200.0, "AB-123", "CAD")]
    assert held[1].option_expiry == D(2025, 1, 17) and held[1].option_strike == 12.5 and held[0].period_end == D(2024, 1, 31)
    acts = {r.line: (r.trade_date, r.txn_type, r.quantity and float(r.quantity), float(r.net_amount), r.currency) for r in statements.activity(rows, layout).collect()}
    assert acts[11] == (D(2024, 1, 5), "buy", 10.0, -50.0, "CAD") and acts[12] == (D(2024, 1, 6), "option_sell_to_open", -2.0, 200.0, "CAD")
    assert acts[13] == (D(2024, 1, 9), "transfer_in", 7.0, 0.0, "CAD") and acts[19] == (D(2024, 1, 3), "fee", None, -5.0, "USD") and 21 not in acts
    money = {r.currency: (r.opening and float(r.opening), r.closing and float(r.closing), r.holdings_total and float(r.holdings_total)) for r in statements.balances(rows, layout).filter("currency is not null").collect()}
    assert money == {"CAD": (1000.0, 1150.0, -150.0), "USD": (None, None, None)}
    assert {(r.line, r.reason) for r in statements.quarantined(rows, layout).collect()} == {(7, "unreadable holding"), (14, "date outside period"), (15, "unknown activity")}
    assert {(r.currency, r.section): r.completeness for r in statements.scopes(rows, layout).collect()} == {("CAD", "positions"): "partial", ("CAD", "cash"): "partial", ("USD", "positions"): "unknown", ("USD", "cash"): "unknown"}
    assert statements.activity(statements.carried(lines.limit(0), layout), layout).count() == 0
    change = spark.range(1).select(*statements.ticker_change(F.lit("Symbol change: from abc.a into XYZ"))).first()
    assert tuple(change) == ("ABC.A", "XYZ")


def test_words_to_visual_lines(spark):
    from foliomere.operators import statements

    words = [("b", 20.0, 10.5, 25.0, 12.0), ("a", 1.0, 11.0, 5.0, 13.0), ("c", 1.0, 12.6, 5.0, 14.0), ("d", 9.0, 13.0, 12.0, 15.0)]
    df = spark.createDataFrame([("f", 1, *w) for w in words], "relpath string, page int, text string, x0 double, top double, x1 double, bottom double")
    assert {(r.line, r.text, r.box.x1) for r in statements.visual_lines(df).collect()} == {(1, "a b", 25.0), (2, "c d", 12.0)}

"""Work that must not grow faster than its input: what is computed once, written once, or kept in classes."""

import datetime as dt

from pyspark.sql import functions as F

from foliomere.functions import names, text

D = dt.date


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_name_is_split_once(spark):
    df = spark.createDataFrame([("Bought hot ring Inc rty AB-123456 100 $12.50 1,250.00 left",)], "x string").select(F.array_join(names.name_words(F.col("x")), " ").alias("w"))
    assert optimized(df).count("split(") == 1 and df.first().w == "HOT RING REALTY"


def test_lines_of_all_brokers_are_made_once(spark):
    from foliomere.operators import brokers

    lines = spark.createDataFrame([("a", 1, 0, "TD Direct Investing"), ("a", 1, 1, "Account number: A1")], "relpath string, page int, line int, text string")
    assert optimized(brokers.parsed(lines.filter("text != 'zzz'"), brokers.cash)).count("zzz") == 0


def test_a_line_is_as_long_as_its_print(spark):
    from foliomere.operators import evidence

    lines = spark.createDataFrame([("a", 1, 0, "x abcdef ghijß y")], "relpath string, page int, line int, text string")
    used = spark.createDataFrame([("a", "abcdef ghijß")], "relpath string, raw string")
    assert [(r.lines, r.matched) for r in evidence.coverage(lines, used).collect()] == [(1, 0)]  # 12 characters are no more than 12
    assert spark.range(1).select(names.plain_line(F.lit("straße  ﬁt ᾳ"))).first()[0] == "STRAẞE ﬁT ᾼ"


def test_classes_of_names_stand_for_all_pairs(spark):
    from foliomere.operators import listing

    texts = ["RED RING", "RING RED", "RED RING BOLT", "HOT", "LARGE", "LARGE RED", ""]
    rows = spark.createDataFrame([(k, texts[k * k % 7]) for k in range(140)], "id int, x string").select("id", text.name_tokens(F.col("x")).alias("t"))
    out = listing.similar_classes(rows).collect()
    head = {r.id: r.id for r in rows.filter("size(t) > 0").collect()}
    of = {r.id: tuple(r.t) for r in rows.collect()}
    head |= {r.right_id: r.left_id for r in out if of[r.left_id] == of[r.right_id]}
    score = {(r.left_id, r.right_id): r.score for r in out}
    every = {(r.left_id, r.right_id): r.score for r in listing.similar_names(rows).collect()}
    back = {}
    for i in head:
        for j in head:
            if i < j and (s := 1.0 if head[i] == head[j] else score.get(tuple(sorted((head[i], head[j]))))):
                back[i, j] = s
    assert back == every and len(out) < 160 < len(every)


def test_pairs_of_parts_are_told_by_classes(spark):
    from foliomere.operators import listing

    data = [(k, "b" if k % 5 else "c", k % 3, k % 2) for k in range(60)] + [(100, "z", 1, 0), (101, None, 1, 0)]
    rows = listing.paired_classes(spark.createDataFrame(data, "id int, brand string, size int, side int"), "id", ["brand", "size"], "side").collect()
    links = {k: sum(1 for j, b, s, d in data if (b, s) == (brand, size) and d != side) for k, brand, size, side in data if brand}
    assert {r.id: r.links for r in rows} == links and links[100] == 0
    first = {r.id: r.class_id for r in rows}
    where = {k: x for k, *x in data}
    assert all(where[r.class_id] == where[r.id] and (r.paired_class is None) == (r.links == 0) for r in rows) and all(first[c] == c for c in first.values())


def test_trades_by_name_meet_two_instruments_of_a_name(spark):
    from foliomere.operators import resolve

    a = spark.createDataFrame([(k, k % 2, "CAD", None if k == 3 else D(2024, 1, 1), "RED RING") for k in range(40)], "row_id int, account_id int, currency string, trade_date date, line string")
    b = spark.createDataFrame([(1, "CAD", k, D(2024, 1, 1), "RED RING") for k in range(300)] + [(5, "CAD", 300, D(2024, 1, 1), "BLUE RING")], "account_id int, currency string, instrument int, as_of date, line string")
    assert {(r.row_id % 2, r.instrument, r.score, r.scope, r.status) for r in resolve.by_name(a, b).collect()} == {(0, None, 1.0, "portfolio", "ambiguous"), (1, None, 1.0, "account", "ambiguous")}
    two = {(r.s, tuple(r.two)) for r in resolve._two(b.withColumnRenamed("line", "s"), ["s"]).collect()}
    assert two == {("RED RING", (0, 1)), ("BLUE RING", (300,))}


def test_texts_of_rows_and_lines_are_folded_once(spark):
    from foliomere.operators import locator

    rows = spark.createDataFrame([("d", 1, 1, "cccc dddd eeee"), ("d", 2, 2, "aaaa bbbb cccc dddd"), ("d", 3, 3, "cccc dddd eeee")], "statement_id string, row_id int, seq int, raw string").filter("raw != 'zzz'")
    lines = spark.createDataFrame([("d", 1, k, x) for k, x in enumerate(["aaaa bbbb cccc  dddd", "cccc dddd eeee", "see cccc dddd eeee"])], "statement_id string, page int, line int, text string").filter("text != 'zzz'")
    out = locator.source_places(rows, lines)
    assert optimized(out).count("zzz") == 0  # no step reads the sources again
    assert {(r.row_id, r.line) for r in out.collect()} == {(1, 1), (2, 0), (3, 2)}


def test_lines_are_read_without_failed_parses(spark):
    import re

    from foliomere.operators import activity, statements

    months = [("Jan", "5", D(1995, 1, 5)), ("dec", "31", D(1994, 12, 31)), ("Feb", "30", None), ("Feb", "", None), ("Xyz", "1", None), (None, None, None)]
    rows = spark.createDataFrame([(m, d, D(1995, 3, 31), x) for m, d, x in months], "m string, d string, e date, want date")
    got = rows.select("want", activity.with_year(F.col("m"), F.col("d"), F.col("e")).alias("got"))
    assert "gettimestamp" not in optimized(got) and all(r.want == r.got for r in got.collect())
    assert not re.search(text._shape("MMM d, yyyy"), "January 31, 1995") and re.search(text._shape("MMMM d, yyyy"), "January 31, 1995")
    layout = statements.Layout()
    said = spark.createDataFrame([("SOLD SHORT 5", "short_sell"), ("sold 5", "sell"), ("SOLDIER", None), ("", None)], "x string, want string").filter("x != 'zzz'").select("want", statements.verb(F.col("x"), layout).alias("got"))
    assert optimized(said).count("regexp") == 1 and all(r.want == r.got for r in said.collect())
    parts = spark.createDataFrame([("Jan 5 A\x1fB 1.00 2.00",), ("Jan 5 none",)], "t string").select(text.groups(F.col("t"), layout.dated, 4).alias("p"))
    assert [r.p for r in parts.collect()] == [["Jan", "5", "A\x1fB", " 1.00 2.00"], None]


def test_scopes_read_lines_once(spark):
    from foliomere.operators import statements

    layout = statements.Layout()
    said = ["Account number: A-1", "Canadian dollar account", "Holdings", "junk 1.00 2.00", "Activity", "Closing balance 5.00"]
    lines = spark.createDataFrame([("d", 1, k, x) for k, x in enumerate(said)], "relpath string, page int, line int, text string").filter("text != 'zzz'")
    out = statements.scopes(statements.carried(lines, layout), layout)
    assert optimized(out).count("zzz") == 1 and {(r.section, r.completeness) for r in out.collect()} == {("positions", "partial"), ("cash", "complete")}


def test_positions_are_not_dealt_by_statement(spark):
    from foliomere.operators import checkpoints, sweep

    s = spark.createDataFrame([(k, 1, "CAD", D(2024, k, 1), D(2024, k, 28), "complete") for k in (1, 2, 3)], "statement_id long, account_id long, currency string, period_start date, period_end date, completeness string")
    p = spark.createDataFrame([(k, 1, "CAD", 7, 10.0 * k) for k in (1, 2, 3)], "statement_id long, account_id long, currency string, instrument_id long, quantity double")
    m = spark.createDataFrame([(1, "CAD", 7, D(2024, 3, 30), 5.0)], "account_id long, currency string, instrument_id long, trade_date date, position_delta double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = [checkpoints.holdings_at(s, p, m, F.lit("2024-02-28").cast("date")), sweep.holdings_over(s, p, m, sweep.checkpoint_dates(s))]
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in held]
        rows = [{(r.anchor_date, r.quantity) for r in df.collect()} for df in held]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any("hashpartitioning(statement_id" in x for x in plans)
    assert rows == [{(D(2024, 2, 28), 20.0)}, {(D(2024, k, 28), 10.0 * k) for k in (1, 2, 3)}]


def held_to_sql(spark, name, lines, monkeypatch):
    """The query on the smallest tables dealt as if they were large, held against its SQL; its plan."""
    import oracle

    import __spark_entry__ as e
    from foliomere.sources import ledger

    monkeypatch.setattr(ledger, "TASK_LINES", lines, raising=False)
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(e.queries()[name](spark, sf), oracle.connect(sf), e.oracle_sql()[name]) == ""
    return e.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_scopes_of_a_larger_source_take_more_tasks(spark, monkeypatch):
    import re

    plan = held_to_sql(spark, "validation_scopes", 500, monkeypatch)
    dealt = re.findall(r"hashpartitioning\((.*?), (\d+)\)", plan)
    tasks = {n for keys, n in dealt if "orderkey" not in keys}
    assert dealt and len(tasks) == 1 and int(tasks.pop()) > 4  # conftest sets 4


def dealt_at_size(spark, name, monkeypatch):
    """What the query's rows are dealt by, and to how many tasks, with joins by broadcast switched off as at larger sizes."""
    import re

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = held_to_sql(spark, name, 1000, monkeypatch)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return {(re.sub(r"#\d+L?", "", keys), int(n)) for keys, n in re.findall(r"hashpartitioning\((.*?), (\d+)\)", plan)}


#: Nothing is dealt to the 4 tasks of conftest, and no page twice.
PAGES = {("l_orderkey", 6), ("o_orderkey", 6), ("account_id, currency", 6), ("relpath, page", 24)}


def test_pages_and_words_of_a_larger_source_take_more_tasks(spark, monkeypatch):
    assert dealt_at_size(spark, "column_cash", monkeypatch) == PAGES


def test_rows_and_effects_of_a_larger_source_take_more_tasks(spark, monkeypatch):
    assert dealt_at_size(spark, "column_cash_taken", monkeypatch) == PAGES | {("relpath, _key", 6), ("relpath, _key, _nth", 6)}


def test_full_sets_are_not_dealt_by_class(spark, monkeypatch):
    from foliomere.llm import near_dup

    staged = []

    def spied(df, name, keep=False, real=near_dup.stage_table):
        staged.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name, keep)

    monkeypatch.setattr(near_dup, "stage_table", spied)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[: 50 + k % 3], f"x{k}"])) for k in range(8)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for more in ([], [(3, " ".join(base)), (3, "a lone text of some few words"), (9, rows[3][1]), (2, None)]):
            staged.clear()
            out = near_dup.near_duplicates(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()
            assert {r.component_id for r in out if r.n_shingles > 40} == {0} and len(out) == 8 + len(more)
            sets = [plan for name, plan in staged if name == "sets"]
            assert "hashpartitioning(class" not in sets[0] and len(sets) == 1 + bool(more)  # again only where texts share ids
            assert all("SortAggregate" not in plan for name, plan in staged if name == "shared")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


#: Patterns as first written: what they find, the present ones must.
WRITTEN = {"mail": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "card": r"(?<![\w])\d(?:[\x20-]?\d){12,}(?![\w])"}


def test_long_runs_need_no_deep_stack(spark):
    """In a task a stack that overflows ends the executor; here it would be an error of the call."""
    from foliomere.llm import pii

    pattern = spark._jvm.java.util.regex.Pattern.compile(pii.PATTERN)
    for run in ("1" * 200_000, ("1234 " * 40_000).strip(), "1-" * 100_000 + "1", "a@b" + ".cc" * 60_000):
        found = pattern.matcher(f"see {run} there")
        assert found.find() and found.group() == run and not found.find()


def test_long_runs_find_what_the_patterns_say(spark):
    import random

    from foliomere.llm import pii

    r = random.Random(4)
    kinds = [["1", "22", "4111", "5500 ", "-", " ", "a", "_", ".", "@", "+", "A1", "(", "é", "1234567", "DE89 3704", "\n"], ["1", "22", "333 ", "4444-", "5", "a ", " ", "_"], ["a", "b.", "@", "@c", "-", "_", " ", "1", ".d", "+"]]
    rows = [("".join(r.choice(kinds[k % 3]) for _ in range(r.randint(3, 50))),) for k in range(6000)]
    written = "|".join(f"(?:{p})" for p in (pii.PATTERNS | WRITTEN).values())
    whole = [F.regexp_like("m", F.lit(f"^(?:{p[k]})$")) for k in WRITTEN for p in (pii.PATTERNS, WRITTEN)]
    df = spark.createDataFrame(rows, "t string").select(F.regexp_extract_all("t", F.lit(written), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(pii.PATTERN), F.lit(0)).alias("b"))
    assert df.filter(F.col("a") != F.col("b")).count() == 0 and df.agg(F.sum(F.size("a"))).first()[0] > 300
    each = df.select(F.explode("a").alias("m")).select("m", *(c.alias(f"c{k}") for k, c in enumerate(whole)))
    assert each.filter("c0 != c1 or c2 != c3").count() == 0 and each.filter("c0").count() > 20 and each.filter("c2").count() > 20


def test_positions_meet_statements_and_dates_where_they_lie(spark, monkeypatch):
    """Positions and their dates are many times the movements: they are dealt by scope alone, and not twice."""
    scope = {"l_orderkey", "o_orderkey", "account_id, currency"}
    dealt = {n: {keys for keys, _ in dealt_at_size(spark, n, monkeypatch)} for n in ("status_counts", "quality_counters", "holdings_over_dates", "performance_total")}
    assert dealt["status_counts"] == scope | {"status"} and dealt["holdings_over_dates"] == scope
    assert dealt["quality_counters"] == scope | {"statement_id", "account_id, currency, period_start"}  # sums of statements
    assert not any("as_of" in k and k != "as_of, currency" and k != "as_of" for k in dealt["performance_total"])


def test_prior_positions_are_those_of_the_statement_before(spark):
    from foliomere.operators import reconcile

    s = spark.createDataFrame([(k, 1, c, D(2024, m, 1), D(2024, m, 28), state) for k, c, m, state in ((1, "CAD", 1, "complete"), (2, "CAD", 2, "complete"), (3, "CAD", 3, "unknown"), (4, "CAD", 4, "complete"), (9, "USD", 4, "complete"))], "statement_id long, account_id long, currency string, period_start date, period_end date, completeness string")
    p = spark.createDataFrame([(k, 1, c, i, q) for k, c, i, q in ((1, "CAD", 7, 10.0), (2, "CAD", 7, 15.0), (2, "CAD", 8, 2.0), (4, "CAD", 8, None), (9, "USD", 7, 1.0), (77, "CAD", 7, 5.0))], "statement_id long, account_id long, currency string, instrument_id long, quantity double")
    m = spark.createDataFrame([(1, "CAD", 7, D(2024, 2, 10), 5.0), (1, "CAD", 9, D(2024, 2, 11), None), (1, "CAD", 7, D(2024, 5, 1), 3.0)], "account_id long, currency string, instrument_id long, trade_date date, position_delta double")
    got = {(r.statement_id, r.instrument_id): (r.expected, r.reported, r.status) for r in reconcile.position_rollforward(s, p, m).collect()}
    assert got == {
        (1, 7): (0.0, 10.0, "missing_prior"), (2, 7): (15.0, 15.0, "non_adjacent"), (2, 8): (0.0, 2.0, "non_adjacent"), (2, 9): (0.0, 0.0, "non_adjacent"), (3, 7): (15.0, 0.0, "current_incomplete"),
        (3, 8): (2.0, 0.0, "current_incomplete"), (4, 8): (0.0, 0.0, "prior_incomplete"), (9, 7): (0.0, 1.0, "missing_prior"),
    }


def test_rows_and_lines_are_aligned_out_of_written_tables(spark):
    from foliomere.operators import alignment

    lines = spark.createDataFrame([("d", 0, k, x, 10.0 * k, 10.0 * k + 8) for k, x in enumerate(["aa bb cc", "dd ee", "ff gg", "dd ee"])], "relpath string, page int, line int, text string, top double, bottom double").filter("text != 'zzz'")
    asked = [(1, "aa bb cc"), (2, "aa bb cc\nff gg"), (3, "cc dd"), (4, "dd ee"), (5, "ee ff gg dd"), (6, "none such"), (7, None)]
    rows = spark.createDataFrame([("d", k, x, None, None, None) for k, x in asked], "relpath string, row_id int, raw string, page_hint int, line_hint int, allowed array<int>").filter("row_id != 777")
    out = alignment.aligned(rows, lines)
    assert optimized(out).count("zzz") == 0 and optimized(out).count("777") == 0  # no step reads the sources again
    assert {(r.row_id, r.status, tuple(r.places or ())) for r in out.collect()} == {(1, "exact", (0,)), (2, "exact", (0, 2)), (3, "unique_tokens", (0, 1)), (4, "ambiguous", ()), (5, "unique_tokens", (1, 2, 3)), (6, "unmatched", ()), (7, "unmatched", ())}


def test_lines_of_a_broker_are_carried_once(spark):
    from foliomere.operators import brokers

    said = ["TD Direct Investing", "March 1, 2024 to March 31, 2024", "Account number: A1", "Account type: Direct Trading - CDN", "Holdings in your account", "junk 1", "Activity in your account", "Ending cash balance 5.00"]
    lines = spark.createDataFrame([("a", 1, k, x) for k, x in enumerate(said)], "relpath string, page int, line int, text string").filter("text != 'zzz'")
    out = brokers.scopes(brokers.read_lines(brokers.dispatched(lines), brokers.TD), brokers.TD)
    assert optimized(out).count("zzz") == 0 and {(r.section, r.completeness) for r in out.collect()} == {("positions", "partial"), ("cash", "complete")}


def test_movements_meet_an_accounts_instruments_as_one_row(spark):
    from foliomere.operators import replay

    anchors = spark.createDataFrame([(1, "CAD", "a"), (2, "CAD", "a"), (2, "CAD", "b")], "account_id long, currency string, scope_key string")
    held = spark.createDataFrame([(1, "CAD", "a", "S1"), (1, "CAD", "x", "S2"), (3, "CAD", "z", "S1"), (3, "CAD", "y", "S2"), (3, "CAD", "z", "S2"), (1, "CAD", "a", None)], "account_id long, currency string, scope_key string, instrument string")
    moves = spark.createDataFrame([(k, i) for k in (1, 2, 3, 4) for i in ("S1", "S2", "S9")], "account_id long, instrument string").withColumn("currency", F.lit("CAD"))
    out = replay.routed(moves, anchors, held)
    got = {(r.account_id, r.instrument): r.scope_key for r in out.collect()}
    assert [got[1, x] for x in ("S1", "S2", "S9")] == ["a", "x", "a"] and {got[2, x] for x in ("S1", "S2", "S9")} == {None} and [got[3, x] for x in ("S1", "S2", "S9")] == ["z", "default", "default"] and got[4, "S1"] == "default"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = replay.routed(moves, anchors, held)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Join [account_id") == 2 and "Join [account_id#" in plan and "instrument" not in "".join(x for x in plan.split("\n") if "Join [" in x)

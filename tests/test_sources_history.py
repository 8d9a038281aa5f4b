"""Alignment, source places, columns, broker layouts, ticker graph, lots and fingerprints against plain versions."""

import datetime as dt
import random
import re

import pytest

from foliomere.operators import alignment, brokers, columns, evidence, fingerprint, locator, lots, sweep, tickers

D = dt.date
SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[A-Z0-9]+(?:[.\-][A-Z0-9]+)*")
LINES = "relpath string, page int, line int, text string, top double, bottom double"
ROWS = "relpath string, row_id int, raw string, page_hint int, line_hint int, allowed array<int>"


def norm(t):
    return " ".join((t or "").replace("–", "-").replace(" ", " ").split())


def tokens(t):
    return TOKEN.findall(t.upper())


def aligned_plain(raw, lines, page, line, allowed):
    """lines: (page, line, text, top, bottom) in order."""
    parts = [p for x in (raw or "").split("\n") if (p := norm(x))]
    if not parts:
        return ("unmatched", None, None, None)
    texts, ok = [norm(x[2]) for x in lines], [allowed is None or x[0] in allowed for x in lines]
    exact = [k for k in range(len(lines) - len(parts) + 1) if texts[k : k + len(parts)] == parts and all(ok[k : k + len(parts)])]
    span = lambda k: list(range(k, k + len(parts)))
    if exact:
        own = [k for k in exact if lines[k][0] == page]
        at = [k for k in own if lines[k][1] == line]
        for found, method in ((at, "persisted_page_line"), (own, "persisted_page"), (exact, "exact_line_sequence")):
            if len(found) == 1:
                return ("exact", method, span(found[0]), None)
        return ("ambiguous", "repeated_exact_text", None, None)
    if len(parts) > 1:
        paths, stack = [], [([], 0)]
        while stack and len(paths) < 2:
            path, p = stack.pop()
            if p == len(parts):
                paths.append(path)
                continue
            steps = []
            for k in range(path[-1] + 1 if path else 0, len(lines)):
                if texts[k] == parts[p] and ok[k]:
                    steps.append([k])
                if k + 1 < len(lines) and lines[k][0] == lines[k + 1][0] and None not in (*lines[k][3:], *lines[k + 1][3:]):
                    beside = max(lines[k][3], lines[k + 1][3]) <= min(lines[k][4], lines[k + 1][4])
                    if beside and ok[k] and ok[k + 1] and tokens(texts[k + 1]) + tokens(texts[k]) == tokens(parts[p]):
                        steps.append([k, k + 1])
            stack += [(path + s, p + 1) for s in reversed(steps)]
        if len(paths) == 1:
            return ("exact", "ordered_noncontiguous_lines", paths[0], None)
        if paths:
            own = [p for p in paths if lines[p[0]][0] == page]
            return ("exact", "ordered_noncontiguous_persisted_page", own[0], None) if len(own) == 1 else ("ambiguous", "repeated_ordered_text", None, None)
    needle, found = tokens(" ".join(parts)), {}
    for k in range(len(lines)):
        for width in range(1, min(4, len(lines) - k) + 1):
            flat = [(t, w, j) for j in range(width) for w, word in enumerate(texts[k + j].split(" ")) for t in tokens(word)]
            hit = next((i for i in range(len(flat) - len(needle) + 1) if [x[0] for x in flat[i : i + len(needle)]] == needle), None) if needle and all(ok[k : k + width]) else None
            if hit is not None:
                own = flat[hit : hit + len(needle)]
                found[k] = (width, [((ws[0], ws[-1] + 1) if (ws := [w for _, w, j in own if j == n]) else None) for n in range(width)])
                break
    least = min((w for w, _ in found.values()), default=0)
    best = {k: v for k, v in found.items() if v[0] == least}
    if len(best) == 1:
        k, (width, ranges) = next(iter(best.items()))
        return ("unique_tokens", "unique_contiguous_tokens", list(range(k, k + width)), ranges)
    return ("ambiguous", "repeated_token_sequence", None, None) if best else ("unmatched", "no_unique_text_alignment", None, None)


def test_alignment_equals_a_plain_ladder(spark):
    rng = random.Random(4)
    words = ["CASH", "A-1.5", "x", "Opening", "12.50", "–", "fund", "(ABC)", "b"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, rows = {}, []
    for d in range(12):
        n = rng.randrange(6, 16)
        docs[f"d{d}"] = [(k // 6, k % 6, text(rng.randrange(0, 4)), *((None, None) if rng.random() < 0.1 else (10.0 * k, 10.0 * k + rng.choice([8.0, 12.0])))) for k in range(n)]
        for _ in range(60):
            lines = docs[f"d{d}"]
            k = rng.randrange(n)
            pick = lambda j: lines[j % n][2]
            raw = rng.choice([pick(k), pick(k) + "\n" + pick(k + 1), pick(k) + "\n\n" + pick(k + 3), pick(k + 1) + " " + pick(k) + "\n" + pick(k + 4), " ".join(pick(k).split()[1:] + pick(k + 1).split()[:1]), text(3), "", None])
            rows.append((f"d{d}", len(rows), raw, rng.choice([None, 0, 1]), rng.choice([None, k % 6]), rng.choice([None, None, [0], [0, 1]])))
    rows.append(("none", len(rows), "x", None, None, None))
    flat = [(d, *x) for d, ls in docs.items() for x in ls]
    got = {r.row_id: (r.status, r.method, r.places, None if r.ranges is None else [x and (x.first, x.last) for x in r.ranges]) for r in alignment.aligned(spark.createDataFrame(rows, ROWS), spark.createDataFrame(flat, LINES)).collect()}
    want = {i: aligned_plain(raw, docs[d], p, ln, a) if d in docs else ("no_coordinates", "pdf_has_no_coordinate_lines", None, None) for d, i, raw, p, ln, a in rows}
    assert got == want and len({v[:2] for v in want.values()}) >= 10


def test_pages_of_owners(spark):
    owners = [spark.createDataFrame([("a", 1, 7), ("a", None, 7)], "relpath string, row_id int, statement_id int"), spark.createDataFrame([("a", 1, 8), ("a", 2, 9)], "relpath string, row_id int, statement_id int")]
    pages = spark.createDataFrame([(7, 1), (7, 2), (8, 2)], "statement_id int, page int")
    assert {(r.row_id, tuple(r.allowed)) for r in alignment.allowed_pages(owners, pages).collect()} == {(1, (1, 2))}


def test_source_places_equal_a_moving_cursor(spark):
    rng = random.Random(9)
    lines = [("s", 1 + k // 10, k % 10, rng.choice(["Cash 12", "Dividend on Acme Corp", "Dividend on  Acme Corp class A", "b", "one two three four", "x one two three four y"])) for k in range(40)]
    raws = ["Cash 12", "Dividend on Acme Corp\nmore", "Acme Corp", "\n\nthree fo", "b", "one two three four and more", "", None, "a"]
    rows = [("s", k, k, rng.choice(raws)) for k in range(60)]
    cursor, want = {}, {}
    for _, i, _, raw in rows:
        key = next((p for x in (raw or "").split("\n") if (p := norm(x))), None)
        want[i] = (None, None)
        if key is None:
            continue
        fits = lambda t, strict: t == key if strict else len(t) >= 12 and len(t.split()) >= 3 and (t in key or key in t)
        at = next((j for strict in (True, False) for j in range(cursor.get(key, 0), len(lines)) if fits(norm(lines[j][3]), strict)), None)
        if at is not None:
            cursor[key], want[i] = at + 1, lines[at][1:3]
    a, b = spark.createDataFrame(rows, "statement_id string, row_id int, seq int, raw string"), spark.createDataFrame(lines, "statement_id string, page int, line int, text string")
    assert {r.row_id: (r.page, r.line) for r in locator.source_places(a, b).collect()} == want
    placed = a.selectExpr("*", "if(row_id = 0, 9, null) as page", "if(row_id = 0, 9, null) as line")
    filled = {r.row_id: (r.page, r.line) for r in locator.attached(placed, b).collect()}
    assert filled[0] == (9, 9) and len(filled) == 60 and any(v[0] for k, v in filled.items() if k)


def test_coverage_counts_lines_of_any_length_that_a_row_holds(spark):
    lines = spark.createDataFrame([("a", 1, k, t) for k, t in enumerate(["Bought Acme", "10 shares", "", "Acme Corp of the north pays", "zz", "zz"])], "relpath string, page int, line int, text string")
    used = spark.createDataFrame([("a", "BOUGHT ACME 10 SHARES"), ("a", "Corp of the north"), ("a", "y zz"), ("b", "zz")], "relpath string, raw string")
    assert [(r.lines, r.matched) for r in evidence.coverage(lines, used).collect()] == [(5, 5)]


def test_cash_by_columns(spark):
    head = [("QUANTITY", 80.0), ("\\Rate", 180.0), ("Debit", 280.0), ("Credit", 380.0)]
    words = [("a", 1, 0, t, x - 20, x) for t, x in head] + [("a", 1, 1, t, x - 20, x) for t, x in [("TAX", 30.0), ("10", 80.0), ("1.50", 285.0), ("(10.00)", 380.0)]]
    words += [("a", 1, 2, t, x - 20, x) for t, x in [("MOVED", 30.0), ("10", 80.0)]] + [("a", 2, 1, "5.00", 300.0, 320.0), ("a", 1, 3, "words", 0.0, 9.0)]
    got = {(r.page, r.line): float(r.effect) for r in columns.cash_effects(spark.createDataFrame(words, "relpath string, page int, line int, text string, x0 double, x1 double")).collect()}
    assert got == {(1, 1): 8.5, (1, 2): 0.0}


TEXT = """TD Direct Investing
March 1, 2023 to March 31, 2023
Account number: AB12
Account type: Direct Trading - US
Holdings in your account
ACME CORP 1,600 SEG 174.230 45,606.97 278,768.00 233,161.03 16.87%
(ACM)
Nobody 5 SEG 1.00 2.00 3.00 4.00 1.00%
12 stray figures
Activity in your account this period
Beginning cash balance -$10.00
Mar 02 Transfer Out ACME CORP -5 0.00
Mar 03 Cash withdrawal 7.00
more of it
(continued on next page)
Mar 04 Frobnicate 3.00
Apr 09 Fee 2.00
Mar 32 Fee 1.00
Mar 05 Sell CALL-100 ABC'23 QQ@10 -1 2.00 200.00
Ending cash balance $1.50-
Mar 06 Buy ACME CORP 1 1.00 1.00"""


def test_what_a_layout_cannot_read_is_quarantined(spark):
    docs = {"td": TEXT, "other": "Some letter\nMar 02 Bought x 1", "late": "no title\n" * 3}
    lines = spark.createDataFrame([(d, 1, k, t) for d, x in docs.items() for k, t in enumerate(x.split("\n"))], "relpath string, page int, line int, text string")
    known = {(r.relpath, r.parser) for r in brokers.dispatched(lines).select("relpath", "parser").distinct().collect()}
    assert known == {("td", "td"), ("other", None), ("late", None)}
    rows = brokers.parsed(lines, brokers.activity).collect()
    good = {r.trade_date.day: (r.txn_type, r.quantity and float(r.quantity), float(r.net_amount), r.raw_line.count("\n")) for r in rows if r.reason is None}
    assert good == {2: ("transfer_out", -5.0, 0.0, 0), 3: ("withdrawal", None, -7.0, 1)}
    assert sorted(r.reason for r in rows if r.reason) == ["date outside the statement period", "invalid date", "option identity is incomplete", "unknown verb"]
    held = brokers.parsed(lines, brokers.holdings).collect()
    assert {(r.symbol, r.reason) for r in held} == {("ACM", None), (None, "holding without printed symbol"), (None, "unrecognized holding row")}
    assert [(r.account, r.currency, float(r.opening), float(r.closing)) for r in brokers.parsed(lines, brokers.cash).collect()] == [("AB12", "USD", -10.0, -1.5)]
    assert {(r.section, r.completeness) for r in brokers.parsed(lines, brokers.scopes).collect()} == {("positions", "partial"), ("cash", "partial")}


def test_lots_fold_in_their_order(spark):
    rows = [(1, k, *x) for k, x in enumerate([("a", 1.0, 2.0, None, 1.0), ("a", 1.0, 2.0, 5.0, 1.0), ("b", 2.0, 3.0, 5.0, None), ("a\nb", 9.0, 9.0, 6.0, 9.0), ("a", 4.0, 1.0, 7.0, 1.0)])]
    df = spark.createDataFrame(rows, "id int, i int, raw_line string, quantity double, avg_cost double, price double, book_value double").selectExpr("*", "book_value as market_value", "quantity as unrealized_pnl")
    r = lots.fold_lots(df, ["id"], "i").first()
    assert (r.lots, r.quantity, r.avg_cost, r.price, r.book_value, r.raw_line, r.unrealized_pnl) == (5, 7.0, None, 7.0, None, "a\nb\na", 7.0)


def sequential(changes, kinds):
    """Records judged one after another."""
    edges, out = {}, {}
    for seq, a, b, day, ratio, sure in sorted(changes):
        if a not in kinds or b not in kinds or a == b:
            out[seq] = "not two instruments"
        elif kinds[a] != kinds[b]:
            out[seq] = "type or currency differs"
        elif not ratio > 0:
            out[seq] = "ratio is not positive"
        elif (a, b, day) in edges:
            continue
        elif any((a == x and (b, day) != (y, z)) or (b == y and (a, day) != (x, z)) for x, y, z in edges):
            out[seq] = "branches"
        else:
            at, nxt = b, {x: y for x, y, _ in edges}
            while at in nxt and at != a:
                at = nxt[at]
            out[seq] = "closes a ring" if at == a else "recorded"
            if at != a:
                edges[a, b, day] = seq
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ticker_changes_equal_judging_one_after_another(spark, seed):
    rng = random.Random(seed)
    kinds = {k: ("equity" if k < 26 else "etf", "CAD") for k in range(30)}
    changes = [(k, rng.randrange(31), rng.randrange(31), D(2020, 1, rng.randrange(1, 3)), rng.choice([1.0, 2.0, 0.0, 1.0]), 0.5) for k in range(90)]
    changes += [(100 + k, a, b, D(2020, 1, 1), 1.0, 0.5) for k, (a, b) in enumerate([(40, 41), (41, 42), (42, 40), (41, 40)])]
    kinds |= {k: ("bond", "USD") for k in (40, 41, 42)}
    a = spark.createDataFrame(changes, "seq int, from_id int, to_id int, day date, ratio double, confidence double")
    b = spark.createDataFrame([(k, *v) for k, v in kinds.items()], "instrument_id int, asset_type string, currency string")
    rows = tickers.recorded(a, b).collect()
    got, want = {r.seq: r.status for r in rows}, sequential(changes, kinds)
    # refused copies of a change stand in one row
    assert {k: v for k, v in got.items() if v not in ("branches", "closes a ring")} == {k: v for k, v in want.items() if v not in ("branches", "closes a ring")}
    assert all(want[k] == v for k, v in got.items() if v in ("branches", "closes a ring")) and {"closes a ring", "recorded", "branches"} <= set(got.values())


def test_fingerprints_know_rows_not_their_order(spark):
    rows = [(k, f"t{k % 7}", None if k % 5 else "") for k in range(200)]
    table = lambda rs, n: spark.createDataFrame(rs, "a int, b string, c string").repartition(n)
    digest = lambda df: {r.name: r.digest for r in fingerprint.semantic({"x": (df, ["b", "c"])}).collect()}
    base = digest(table(rows, 3))
    assert base == digest(table(rows[::-1], 7)) == digest(table([(k + 1, b, c) for k, b, c in rows], 2))
    for other in (rows[1:], rows + rows[:1], [(0, "t0", None), *rows[1:]], [(0, 't0",c="', ""), *rows[1:]]):
        assert digest(table(other, 3)) != base
    before, after = (fingerprint.semantic({"x": (table(r, 2), ["b"]), "y": (table(rows, 2), ["c"])}) for r in (rows, rows[1:]))
    assert {r.name for r in fingerprint.changed(before, after).collect()} == {"x", "all"}


def test_sweep_carries_a_checkpoint_no_longer_than_its_limit(spark):
    s = spark.createDataFrame([(1, 1, "CAD", D(2020, 1, 31), "complete"), (2, 1, "CAD", D(2020, 2, 29), "unknown"), (3, 2, "CAD", D(2020, 2, 29), "complete"), (4, 2, "CAD", D(2020, 9, 30), "complete")], "statement_id int, account_id int, currency string, period_end date, completeness string")
    p = spark.createDataFrame([(1, 1, "CAD", 5, 10.0), (3, 2, "CAD", 5, 1.0)], "statement_id int, account_id int, currency string, instrument_id int, quantity double")
    m = spark.createDataFrame([(1, "CAD", 5, D(2020, 1, 31), 7.0), (1, "CAD", 5, D(2020, 2, 10), 2.0), (1, "CAD", 6, D(2020, 2, 10), None), (3, "CAD", 5, D(2020, 2, 1), 4.0)], "account_id int, currency string, instrument_id int, trade_date date, position_delta double")
    got = {(r.as_of, r.account_id, r.instrument_id): (r.quantity, r.state) for r in sweep.holdings_over(s, p, m, sweep.checkpoint_dates(s)).collect()}
    assert got == {(D(2020, 1, 31), 1, 5): (10.0, "reported"), (D(2020, 2, 29), 1, 5): (12.0, "reconstructed"), (D(2020, 2, 29), 2, 5): (1.0, "reported")}

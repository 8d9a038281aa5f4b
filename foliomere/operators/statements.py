"""Statement text to rows: accounts, periods, holdings, activity, balances and totals, by expressions alone.

Lines come numbered (``sources.dumps.page_lines``). Headings set what holds for the lines below
them, so each is carried forward within its document; then every line is read by the patterns of
its section. A dated or numeric line that no pattern takes is quarantined, and its scope is no longer complete.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomere.functions.text import groups, option_expiry, parse_date, parse_money

from .activity import with_year

_MONEY = r"\(?[-–−]?\$?[0-9][0-9,]*(?:\.[0-9]+)?\)?-?"


@dataclass(frozen=True)
class Layout:
    """Patterns of one broker's statements. Groups are named in the comments."""

    account: str = r"(?i)^account (?:number|no\.?):?\s*([A-Z0-9-]+)"  # number
    period: str = r"(?i)^(?:for the )?period:?\s+(.+?\d{4})\s+to\s+(.+?\d{4})$"  # first and last day
    currency: str = r"(?i)^(canadian|u\.?s\.?) (?:dollar )?account"  # currency
    sections: tuple[tuple[str, str], ...] = (("holdings", r"(?i)^holdings"), ("activity", r"(?i)^activity"), ("end", r"(?i)^(?:important information|pending activity)"))
    opening: str = rf"(?i)^opening balance\s+({_MONEY})$"
    closing: str = rf"(?i)^closing balance\s+({_MONEY})$"
    total: str = rf"(?i)^total (portfolio|holdings|cash)\s+({_MONEY})$"  # what, amount
    holding: str = rf"^(.+?)\s+\(([A-Z0-9.-]+)\)\s+({_MONEY})\s+({_MONEY})\s+({_MONEY})\s+({_MONEY})$"  # name, symbol, quantity, price, book, value
    option: str = rf"^(CALL|PUT)[ -]+([A-Z.]+)\s+([A-Z]{{2,3}}\s?\d{{2}}|\d{{2}}\s?[A-Z]{{2,3}})\s+([0-9.]+)\s+({_MONEY})\s+({_MONEY})\s+({_MONEY})$"  # type, root, month, strike, quantity, price, value
    dated: str = rf"^([A-Z][a-z]{{2}})\s?(\d{{1,2}})\s+(.*?)((?:\s+{_MONEY}){{1,3}})$"  # month, day, text, figures
    verbs: tuple[tuple[str, str], ...] = (
        ("SOLD SHORT", "short_sell"), ("SOLD", "sell"), ("SELL", "sell"), ("BOUGHT", "buy"), ("BUY", "buy"), ("DIVIDEND", "dividend"), ("INTEREST", "interest"),
        ("TRANSFER IN", "transfer_in"), ("TRANSFER OUT", "transfer_out"), ("DEPOSIT", "deposit"), ("WITHDRAWAL", "withdrawal"), ("FEE", "fee"), ("TAX", "tax"),
        ("EXPIRED", "option_expiration"), ("ASSIGNED", "option_assignment"), ("EXERCISED", "option_exercise"),
    )


#: Names of the parts of a dated line.
DATED = ("month", "dom", "words", "figures")
#: Types whose cash leaves or enters an account, whatever sign is printed.
LEAVES = ("buy", "buy_to_cover", "withdrawal", "fee", "tax", "interest_expense", "transfer_out")
ENTERS = ("sell", "short_sell", "dividend", "interest", "deposit", "transfer_in")


def _group(line: str, pattern: str, k: int) -> Column:
    return F.when(F.regexp_like(line, F.lit(pattern)), F.regexp_extract(line, pattern, k))


def carried(lines: DataFrame, layout: Layout) -> DataFrame:
    """``lines`` (relpath, page, line, text) with account, period_start, period_end, currency, section of the headings above.

    Beside them the parts of dated lines: month, dom, words, figures and the type, verb, that the words begin with."""
    w = Window.partitionBy("relpath").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("t", F.trim("text"))
    code = F.when(F.lower(_group("t", layout.currency, 1)) == "canadian", "CAD").when(_group("t", layout.currency, 1).isNotNull(), "USD")
    section = F.coalesce(*(F.when(F.regexp_like("t", F.lit(p)), F.lit(name)) for name, p in layout.sections))
    # a new account or currency ends the section before it
    section = F.when(_group("t", layout.account, 1).isNotNull() | code.isNotNull(), "none").otherwise(section)
    heads = {"account": _group("t", layout.account, 1), "period_start": parse_date(_group("t", layout.period, 1)), "period_end": parse_date(_group("t", layout.period, 2)), "currency": code, "section": section}
    parts = groups(F.col("t"), layout.dated, len(DATED))
    own = rows.select("*", *(c.alias(f"_{k}") for k, c in heads.items()), parts.alias("_parts")).select("*", *(F.get("_parts", F.lit(k)).alias(name) for k, name in enumerate(DATED)))
    own = own.withColumn("verb", verb(F.trim("words"), layout))
    heading = F.coalesce(*(F.col(f"_{k}").cast("string") for k in heads)).isNotNull()
    out = own.select("relpath", "page", "line", "t", heading.alias("heading"), *DATED, "verb", *(F.last(f"_{k}", ignorenulls=True).over(w).alias(k) for k in heads))
    return out.withColumn("section", F.coalesce("section", F.lit("none")))


def holdings(rows: DataFrame, layout: Layout) -> DataFrame:
    """Positions printed in holdings sections; an option's symbol is its root."""
    share, contract = (lambda k: _group("t", layout.holding, k)), (lambda k: _group("t", layout.option, k))
    found = rows.filter("section = 'holdings' and not heading")
    out = found.select(
        "relpath", "page", "line", "account", "currency", "period_end", F.col("t").alias("raw_line"),
        F.when(contract(1).isNotNull(), "option").when(share(2).isNotNull(), F.when(F.regexp_like("t", F.lit(r"(?i)\betf\b")), "etf").otherwise("equity")).alias("asset_type"),
        F.coalesce(contract(2), share(2)).alias("symbol"), share(1).alias("name"), F.lower(contract(1)).alias("option_type"), option_expiry(contract(3)).alias("option_expiry"), contract(4).try_cast("double").alias("option_strike"),
        parse_money(F.coalesce(contract(5), share(3))).alias("quantity"), parse_money(F.coalesce(contract(6), share(4))).alias("price"), parse_money(share(5)).alias("book_value"), parse_money(F.coalesce(contract(7), share(6))).alias("market_value"),
    )
    return out.filter("asset_type is not null")


def verb(text: Column, layout: Layout) -> Column:
    """The type of the longest verb that begins a text."""
    kinds = dict(sorted(layout.verbs, key=lambda v: -len(v[0])))
    said = F.regexp_extract(F.upper(text), rf"^({'|'.join(map(re.escape, kinds))})\b", 1)
    return F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), said)


def opened_or_closed(kind: Column, q: Column) -> Column:
    """Buying or selling an option opens or closes a position by the printed sign."""
    return F.when(kind == "buy", F.when(q < 0, "option_buy_to_close").otherwise("option_buy_to_open")).when(kind == "sell", F.when(q > 0, "option_sell_to_close").otherwise("option_sell_to_open")).otherwise(kind)


def activity(rows: DataFrame, layout: Layout) -> DataFrame:
    """Dated rows of activity sections: of three figures quantity, price and amount, of two quantity and amount, of one the amount.

    A row without cash that is a transfer moves its quantity alone."""
    found = rows.filter("section = 'activity' and not heading and month is not null")
    figures = F.transform(F.filter(F.split(F.trim("figures"), r"\s+"), lambda x: x != ""), parse_money)
    rows = found.select("*", with_year(F.col("month"), F.col("dom"), F.col("period_end")).alias("trade_date"), F.trim("words").alias("description"), figures.alias("f"))
    n = F.size("f")
    kind = F.col("verb")
    quantity = F.when(n > 1, F.get("f", F.lit(0)))
    option = F.regexp_like("description", F.lit(r"\b(CALL|PUT)\b"))
    kind = F.when(option & kind.isin("buy", "sell"), opened_or_closed(kind, quantity)).otherwise(kind)
    amount = F.get("f", n - 1)
    in_kind = kind.isin("transfer_in", "transfer_out") & (n > 1) & (amount == 0)
    signed = F.when(kind.isin(*LEAVES) | kind.startswith("option_buy"), -F.abs(amount)).when(kind.isin(*ENTERS) | kind.startswith("option_sell"), F.abs(amount)).otherwise(amount)
    return rows.select(
        "relpath", "page", "line", "account", "currency", "period_start", "period_end", F.col("t").alias("raw_line"), "trade_date", kind.alias("txn_type"), "description",
        F.when(in_kind & (quantity < 0), "transfer_out").when(in_kind, "transfer_in").otherwise(kind).alias("direction"),
        quantity.alias("quantity"), F.when(n > 2, F.get("f", F.lit(1))).alias("price"), F.when(in_kind, F.lit(0).cast("decimal(18,4)")).otherwise(signed).alias("net_amount"),
    ).withColumn("txn_type", F.coalesce("direction", "txn_type")).drop("direction")


def balances(rows: DataFrame, layout: Layout) -> DataFrame:
    """relpath, account, currency, period_end, opening, closing and printed totals; of several prints the last counts."""
    amounts = {"opening": (layout.opening, 1), "closing": (layout.closing, 1)}
    order = F.struct("page", "line")
    value = lambda p, k: parse_money(_group("t", p, k))
    last = [F.max_by(value(p, k), F.when(value(p, k).isNotNull(), order)).alias(name) for name, (p, k) in amounts.items()]
    what = F.lower(_group("t", layout.total, 1))
    last += [F.max_by(value(layout.total, 2), F.when(what == name, order)).alias(f"{name}_total") for name in ("portfolio", "holdings", "cash")]
    return rows.filter("account is not null").groupBy("relpath", "account", "currency", "period_start", "period_end").agg(*last)


def _reason(layout: Layout) -> Column:
    """Why a line should be a row and is none; null for all others."""
    dated, shares = F.col("month").isNotNull(), F.regexp_like("t", F.lit(layout.holding)) | F.regexp_like("t", F.lit(layout.option))
    day = with_year(F.col("month"), F.col("dom"), F.col("period_end"))
    known = F.regexp_like("t", F.lit(layout.opening)) | F.regexp_like("t", F.lit(layout.closing)) | F.regexp_like("t", F.lit(layout.total))
    figures = F.regexp_like("t", F.lit(rf"{_MONEY}\s+{_MONEY}$"))
    lost = F.regexp_like("t", F.lit(layout.option)) & option_expiry(_group("t", layout.option, 3)).isNull()
    return (
        F.when(known | F.col("heading"), F.lit(None).cast("string"))
        .when((F.col("section") == "activity") & dated & day.isNull(), "invalid date")
        .when((F.col("section") == "activity") & dated & ~day.between(F.col("period_start"), F.col("period_end")), "date outside period")
        .when((F.col("section") == "activity") & dated & F.col("verb").isNull(), "unknown activity")
        .when((F.col("section") == "holdings") & lost, "incomplete option")
        .when((F.col("section") == "holdings") & figures & ~shares, "unreadable holding")
    )


def quarantined(rows: DataFrame, layout: Layout) -> DataFrame:
    """relpath, page, line, account, currency, section, raw_line, reason of the lines that should be rows and are none."""
    return rows.withColumn("reason", _reason(layout)).filter("reason is not null").select("relpath", "page", "line", "account", "currency", "section", F.col("t").alias("raw_line"), "reason")


def scopes(rows: DataFrame, layout: Layout) -> DataFrame:
    """relpath, account, currency, section, completeness: complete where the section stands (cash: a closing balance) and nothing of it is quarantined."""
    keys = ["relpath", "account", "currency"]
    own = rows.filter("account is not null and currency is not null").withColumn("reason", _reason(layout))
    bad = lambda name: F.count_if(F.col("reason").isNotNull() & (F.col("section") == name))
    # one pass, as lines are dear to read
    both = own.groupBy(*keys).agg(
        F.bool_or(F.col("section") == "holdings").alias("positions"), F.bool_or(F.regexp_like("t", F.lit(layout.closing))).alias("cash"), bad("holdings").alias("bad_positions"), bad("activity").alias("bad_cash")
    )
    state = lambda name: F.when(~F.col(name), "unknown").when(F.col(f"bad_{name}") > 0, "partial").otherwise("complete")
    sections = F.explode(F.array(*(F.struct(F.lit(name).alias("section"), state(name).alias("completeness")) for name in ("positions", "cash"))))
    return both.select(*keys, sections.alias("x")).select(*keys, "x.*")


def ticker_change(text: Column) -> tuple[Column, Column]:
    """Old and new symbol of a line that says so in words; null elsewhere."""
    form = r"(?i)\b(?:NAME|SYMBOL|TICKER)\s+CHANGE\b.*?\bFROM\s+([A-Z0-9.-]+)\s+(?:TO|INTO)\s+([A-Z0-9.-]+)"
    part = lambda k: F.nullif(F.upper(F.regexp_extract(text, form, k)), F.lit(""))
    return part(1).alias("old"), part(2).alias("new")


def visual_lines(words: DataFrame, slack: float = 2.0) -> DataFrame:
    """relpath, page, line, text, box of words (relpath, page, text, x0, top, x1, bottom) by where they stand.

    Words in order of height begin a new line where they lie more than ``slack`` below the line's first word;
    a page's words are folded in one pass."""
    word = F.struct("top", "x0", "bottom", "x1", "text")
    pages = words.groupBy("relpath", "page").agg(F.array_sort(F.collect_list(word)).alias("ws"))  # the words of one page
    kind = "array<struct<top:double,x0:double,bottom:double,x1:double,text:string,line:int>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(None).cast("double").alias("first"), F.lit(0).alias("line"))

    def step(s: Column, w: Column) -> Column:
        new = s["first"].isNull() | (F.abs(w["top"] - s["first"]) > slack)
        line = s["line"] + F.when(new, 1).otherwise(0)
        placed = F.struct(w["top"].alias("top"), w["x0"].alias("x0"), w["bottom"].alias("bottom"), w["x1"].alias("x1"), w["text"].alias("text"), line.alias("line"))
        return F.struct(F.array_append(s["out"], placed).alias("out"), F.when(new, w["top"]).otherwise(s["first"]).alias("first"), line.alias("line"))

    rows = pages.select("relpath", "page", F.explode(F.aggregate("ws", start, step, lambda s: s["out"])).alias("w"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("w.x0", "w.text"))), lambda x: x["text"])
    box = F.struct(F.min("w.x0").alias("x0"), F.min("w.top").alias("top"), F.max("w.x1").alias("x1"), F.max("w.bottom").alias("bottom"))
    return rows.groupBy("relpath", "page", "w.line").agg(F.array_join(ordered, " ").alias("text"), box.alias("box"))

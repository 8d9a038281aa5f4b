"""Canonical keys of instruments, statements and evidence, as columns.

Compatibility forms of Unicode are folded where a character has another single one; forms of several
characters (ligatures, fractions) stay as they are, as no built-in function folds these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import decimal_token, identity_token


def quoted_token(x: Column, compact: bool = False) -> Column:
    """Upper-case key part, percent-quoted but for letters, digits and ._-~"""
    quoted = F.url_encode(identity_token(x.cast("string"), compact))
    for old, new in ((r"\+", "%20"), ("%7E", "~"), (r"\*", "%2A")):
        quoted = F.regexp_replace(quoted, old, new)
    return quoted


def instrument_key(kind: Column, symbol: Column, currency: Column, root=None, expiry=None, strike=None, option_type=None, multiplier=None) -> Column:
    """ik1|TYPE|SYMBOL|CCY; an option's has root, currency, expiry, strike, type and multiplier (100 if not given)."""
    none = F.lit(None).cast("string")
    root, expiry, option_type = (none if c is None else c for c in (root, expiry, option_type))
    strike = F.lit(None).cast("decimal(18,4)") if strike is None else strike
    size = F.lit(100) if multiplier is None else F.coalesce(multiplier, F.lit(100))
    token = quoted_token(kind)
    named = F.when(F.coalesce(root, F.lit("")) != "", root).otherwise(symbol)
    option = F.concat_ws("|", F.lit("ik1"), F.lit("OPTION"), quoted_token(named, True), quoted_token(currency), quoted_token(expiry), decimal_token(strike), quoted_token(option_type), size.cast("string"))
    return F.when(token == "OPTION", option).otherwise(F.concat_ws("|", F.lit("ik1"), token, quoted_token(symbol, True), quoted_token(currency)))


def ascii_json(x: Column) -> Column:
    """JSON text with each UTF-16 unit beyond ASCII written as \\uXXXX."""
    units = F.regexp_extract_all(F.hex(F.encode(x, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    shown = lambda u: F.when(u < "0080", F.char(F.conv(u, 16, 10).cast("long"))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))
    return F.when(F.regexp_like(x, F.lit(r"[^\x00-\x7F]")), F.array_join(F.transform(units, shown), "")).otherwise(x)


def _digest(version: str, fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as compact JSON in the order of their names."""
    ordered = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.concat(F.lit(f"{version}:"), F.sha2(ascii_json(F.to_json(ordered, {"ignoreNullFields": "false"})), 256))


def statement_key(source: Column, institution: Column, account: Column, start: Column, end: Column, kind: Column) -> Column:
    """sk1: key of one account and period of a source."""
    return _digest("sk1", {
        "source": F.trim(source), "institution": quoted_token(institution), "account": quoted_token(account),
        "period_start": start.cast("string"), "period_end": end.cast("string"), "statement_type": quoted_token(kind),
    })


def evidence_key(source: Column, kind: Column, occurrence: Column, raw: Column, rule: Column) -> Column:
    """ev2: key of a printed row; pages and lines are no part of it."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return _digest("ev2", {"source": F.trim(source), "kind": quoted_token(kind), "occurrence": occurrence, "raw": blank(raw), "rule": blank(rule)})


def compact_identity(x: Column) -> Column:
    """Upper-case letters and digits alone."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]+", "")


def spaced_identity(x: Column) -> Column:
    """Upper-case letters and digits, one space for all between."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]+", " "))


def identity_terms(*parts: Column) -> Column:
    """Distinct terms of several names in their order; blank ones have none."""
    return F.array_distinct(F.filter(F.array(*map(spaced_identity, parts)), lambda t: t != ""))


def explicit_symbol(x: Column) -> Column:
    """Whether a printed symbol can stand for itself: one to nine capitals, digits, points or dashes, no underscore."""
    return F.coalesce(F.regexp_like(x, F.lit(r"^[A-Z0-9][A-Z0-9.-]{0,8}$")), F.lit(False))


def ledger_symbol(provider: Column) -> tuple[Column, Column]:
    """Symbol and exchange out of a provider's symbol; dashes become points."""
    value = F.upper(provider)
    # Suffixes of exchanges.
    suffixes = {".TO": "TSX", ".V": "TSXV", ".CN": "CSE", ".NE": "NEO"}
    symbol, exchange = value, F.lit(None).cast("string")
    for suffix, name in suffixes.items():
        ends = F.endswith(value, F.lit(suffix))
        symbol = F.when(ends, F.regexp_replace(value, rf"\{suffix}$", "")).otherwise(symbol)
        exchange = F.when(ends, name).otherwise(exchange)
    return F.translate(symbol, "-", ".").alias("symbol"), exchange.alias("exchange")

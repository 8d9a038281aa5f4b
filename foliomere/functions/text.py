"""Names, amounts, dates and keys out of statement text, as columns."""

from __future__ import annotations

import calendar
import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(x: Column, f) -> Column:
    """``f`` of a value that is computed a single time, however often ``f`` names it.

    Inside lambdas and conditions Spark computes a repeated expression anew at each place."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def groups(line: Column, pattern: str, n: int) -> Column:
    """The groups 1 to n of a pattern that takes whole lines, as an array; the pattern runs once to look and once to part. Null where it is not found."""
    mark = "\x00"
    parts = F.split(F.regexp_replace(line, pattern, mark.join(f"${k}" for k in range(1, n + 1))), mark, -1)
    return F.when(F.regexp_like(line, F.lit(pattern)), parts)


def identity_token(x: Column, compact: bool = False) -> Column:
    """Upper-case key part: white space collapsed (or taken out when compact)."""
    gap = "" if compact else " "
    return F.upper(F.regexp_replace(F.trim(compatible(F.coalesce(x, F.lit("")))), r"\s+", gap))


@functools.cache
def _single_forms() -> tuple[str, str]:
    """Characters whose compatibility form (NFKC) is one other character, and those forms."""
    forms = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    single = [(a, b) for a, b in forms if a != b and len(b) == 1]
    return "".join(a for a, _ in single), "".join(b for _, b in single)


def compatible(x: Column) -> Column:
    """Text with each character's compatibility form where that is one character; others stay."""
    return F.when(F.regexp_like(x, F.lit(r"[^\x00-\x7F]")), F.translate(x, *_single_forms())).otherwise(x)


def layout_text(x: Column) -> Column:
    """Printed text for comparing: compatibility forms, plain dashes, single spaces."""
    # Dashes that count as a hyphen.
    dashes = "\u2010\u2011\u2012\u2013\u2014\u2212"
    plain = F.translate(compatible(F.coalesce(x, F.lit(""))), "\u00a0" + dashes, " " + "-" * len(dashes))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def layout_tokens(x: Column) -> Column:
    """Upper-case runs of letters and digits, with single points or dashes within."""
    return F.regexp_extract_all(F.upper(x), F.lit(r"([A-Z0-9]+(?:[.\-][A-Z0-9]+)*)"), 1)


def decimal_token(x: Column) -> Column:
    """Plain decimal notation without trailing zeros; empty for null."""
    text = x.cast("decimal(38,10)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x.isNull(), F.lit("")).otherwise(F.when(plain == "-0", "0").otherwise(plain))


def name_tokens(x: Column) -> Column:
    """Distinct upper-case words of letters and digits, in order."""
    return F.array_distinct(F.array_remove(F.split(F.upper(F.coalesce(x, F.lit(""))), r"[^A-Z0-9]+", -1), ""))


def name_similarity(a: Column, b: Column, generic: tuple[str, ...] = ()) -> Column:
    """Score of two token arrays: equal 1.0, subset of two or more 0.97, close 0.9, same long first word 0.86 (but for generic ones)."""
    both, joined = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    small = F.least(F.size(a), F.size(b))
    first = F.get(a, F.lit(0))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .when(F.array_sort(a) == F.array_sort(b), 1.0)
        .when((both >= 2) & (both == small), 0.97)
        .when((100 * both >= 55 * joined) & (100 * both >= 75 * small), 0.9)
        .when((first == F.get(b, F.lit(0))) & (F.length(first) >= 5) & ~first.isin(*generic), 0.86)
        .otherwise(0.0)
    )


def parse_money(x: Column) -> Column:
    """Amount of a printed figure; null if it is not one.

    $ and commas are dropped; brackets, or a leading or trailing dash, negate; no other dash may stand in it."""
    dash, number = "[-\u2013\u2212]", r"(?:\d+\.?\d*|\.\d+)"
    form = rf"^(?:{dash}?\s*{number}\s*{dash}?|\(\s*{dash}?\s*{number}\s*{dash}?\s*\))$"

    def read(bare: Column) -> Column:
        value = F.regexp_replace(bare, r"[()\s\u2013\u2212-]", "").try_cast("decimal(28,10)")
        return F.when(F.regexp_like(bare, F.lit(form)), F.when(F.regexp_like(bare, F.lit(rf"^\(|{dash}")), -value).otherwise(value))

    return once(F.trim(F.regexp_replace(x, "[$,]", "")), read)


def parse_percent(x: Column) -> Column:
    """A printed percentage as a number; a lone dash is null."""
    return parse_money(F.regexp_replace(x, "%", ""))


def third_friday(year: Column, month: Column) -> Column:
    """Expiry of a monthly option."""
    first = F.make_date(year, month, F.lit(1))
    # Friday is 6 where Sunday is 1
    return F.date_add(first, F.pmod(F.lit(6) - F.dayofweek(first), F.lit(7)) + 14)


# Printed date forms in the order in which they are tried.
DATE_FORMS = ("yyyy-M-d", "yyyy/M/d", "d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "M/d/yyyy", "M/d/yy", "d/M/yyyy")
# Two-letter months of option contracts.
OPTION_MONTHS = {"JA": 1, "FE": 2, "FB": 2, "MR": 3, "AP": 4, "MY": 5, "JN": 6, "JL": 7, "AU": 8, "SP": 9, "OC": 10, "NV": 11, "DC": 12}


def _shape(form: str) -> str:
    """What every text of a date form has: its marks in their order, a month's letters where the form has them, and no letters elsewhere."""
    parts = re.findall(r"[A-Za-z]+|[^A-Za-z]+", form)
    letters = {"MMM": "[A-Za-z]{3}", "MMMM": "[A-Za-z]{3,}"}
    return "^" + "".join(letters.get(p, "[^A-Za-z]+") if p.isalpha() else p for p in parts) + "$"


def title_months(x: Column) -> Column:
    """Words with a capital first letter alone, as date forms ask for."""
    return F.initcap(F.lower(x))


def two_digit_year(day: Column) -> Column:
    """A day read with two digits of its year as one of 1969 to 2068."""
    return F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)


def parse_date(x: Column, year: Column | None = None) -> Column:
    """A printed date in any of DATE_FORMS, else a month and day of the given year; null if none fits."""

    def read(bare: Column) -> Column:
        found = []
        for form in DATE_FORMS:
            day = F.try_to_date(bare, form)
            # a failed parse costs far more than a look at the marks that the form asks for
            found.append(F.when(F.regexp_like(bare, F.lit(_shape(form))), two_digit_year(day) if form.endswith("/yy") else day))
        if year is not None:
            month, day = (F.regexp_extract(bare, r"^([A-Za-z]{3})[a-z]*[ .-]+(\d{1,2})\b", k) for k in (1, 2))
            found.append(F.try_to_date(F.concat_ws(" ", year.cast("string"), month, day), "yyyy MMM d"))
        return F.coalesce(*found)

    return once(title_months(F.rtrim(F.trim(x), F.lit(","))), read)


def option_month(x: Column) -> Column:
    """Number of a two- or three-letter month; null if it is none."""
    names = OPTION_MONTHS | {calendar.month_abbr[k].upper(): k for k in range(1, 13)}
    return F.element_at(F.create_map(*(F.lit(v) for pair in names.items() for v in pair)), F.upper(x))


def option_expiry(x: Column) -> Column:
    """Expiry of a contract: m/d/y as it is; a year and month in either order mean the third Friday."""
    token = F.trim(x)
    day = F.coalesce(F.try_to_date(token, "M/d/yyyy"), two_digit_year(F.try_to_date(token, "M/d/yy")))
    part = lambda form, k: F.nullif(F.regexp_extract(token, form, k), F.lit(""))
    first, last = r"^(\d{2})\s*([A-Za-z]{2,3})$", r"^([A-Za-z]{2,3})\s*(\d{2})$"
    year = F.coalesce(part(first, 1), part(last, 2)).cast("int") + 2000
    month = option_month(F.coalesce(part(first, 2), part(last, 1)))
    return F.coalesce(day, F.when(year.isNotNull() & month.isNotNull(), third_friday(year, month)))


def provider_symbol(symbol: Column, exchange: Column) -> Column:
    """Market data symbol of a listing: .TO for Toronto exchanges, points become dashes."""
    base = F.regexp_replace(symbol, r"\.", "-")
    return F.when(symbol.endswith(".TO"), symbol).when(exchange.isin("TSX", "TSXV", "NEO", "CSE"), F.concat(base, F.lit(".TO"))).otherwise(base)


def evidence_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)

"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

One pattern finds candidates, validators decide, and each valid value is permuted within its
format: digits stay digits at the same places, separators stay, check digits are made anew,
dates stay dates, mail names keep letters and digits. The permutation depends on the key, the
kind and the length alone, so equal values get equal pseudonyms in every document, and no two
values of one kind and length get the same. (A date with the month first, read so only when day
first is no date, is permuted among all days and may meet another's day-first pseudonym.)

Card numbers are looked for among the groups of a run of digits, from each group on the longest
span that passes, so figures beside a number (a security code, an expiry) do not hide it. Account
numbers may hold capital letters, which stay; what follows one in its candidate is searched for cards.

Edge cases: a null text is empty; values that fail validation stay; ids and repeated rows pass
through; an empty table gives no rows; extra columns are passed over.
"""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: For demonstrations alone: whoever knows the key can undo pseudonyms. Pass your own.
DEMO_KEY = "foliomere-public-demo-key"
_KEY: ContextVar[str] = ContextVar("key", default=DEMO_KEY)
ROUNDS = 8

#: Candidate patterns, tried in this order at each place. Groups without a bound are possessive (++, *+): Java goes
#: one call deeper for each turn of any other, and a stack that overflows ends the executor. Their parts exclude each other, so what is found is the same.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])(?!\.\d)",
    "date": r"(?<![\w/.-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\w])(?![/.-]\d)",
    "social": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[\x20.-]?\(?\d{2,4}\)?(?:[\x20.-]?\d{2,4}){2,4}(?![\w])|(?<![\w(])\(\d{3}\)\x20?\d{3}[-.\x20]\d{4}(?![\w])|(?<![\w-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])",
    # 13 digits, the rest of the group of the last, and further groups; none of these goes on as a word
    "card": r"(?<![\w])\d(?:[\x20-]?\d){12}\d*+(?![\w])(?:[\x20-]\d++(?![\w]))*+",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The Gregorian calendar repeats after so many days: 146097 = 189 * 773.
FIRST_DAY, LEFT, RIGHT = "1800-01-01", 189, 773


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _noise(key: Column, other: Column, i: Column) -> Column:
    """A keyed 60-bit number for a round."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, i.cast("string"), other.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, size_l: Column, size_r: Column, key: Column) -> Column:
    """struct<a, b>: a keyed permutation of all pairs below (size_l, size_r)."""

    def turn(s: Column, i: Column) -> Column:
        a = F.when(i % 2 == 0, F.pmod(s["a"] + F.pmod(_noise(key, s["b"], i), size_l), size_l)).otherwise(s["a"])
        b = F.when(i % 2 == 1, F.pmod(s["b"] + F.pmod(_noise(key, s["a"], i), size_r), size_r)).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def permute_digits(digits: Column, kind: str) -> Column:
    """A keyed permutation of digit strings of one length (2 to 30 digits)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    power = lambda k: F.element_at(F.array(*(F.lit(10**i).cast("long") for i in range(19))), k + 1)
    key = F.concat_ws("|", F.lit(_KEY.get()), F.lit(kind), n.cast("string"))
    mixed = feistel(F.substr(digits, F.lit(1), u).cast("long"), F.substr(digits, u + 1), power(u), power(v), key)
    return _once(mixed, lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), v, "0")))


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by those of ``digits``."""
    chars = F.split(shape, "")
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        is_digit = F.regexp_like(c, F.lit("^[0-9]$"))
        k = s["k"] + F.when(is_digit, 1).otherwise(0)
        return F.struct(k.alias("k"), F.concat(s["out"], F.when(is_digit, F.substr(digits, k, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(chars, start, step, lambda s: s["out"])


def luhn_ok(d: Column) -> Column:
    """Luhn's test by Spark's own function."""
    return F.call_function("luhn_check", d)


def luhn_digit(body: Column) -> Column:
    """The digit that makes ``body`` valid."""
    tens = F.sequence(F.lit(0), F.lit(9))
    return F.get(F.filter(tens, lambda k: luhn_ok(F.concat(body, k.cast("string")))), F.lit(0)).cast("string")


def mod97(digits: Column) -> Column:
    """Remainder of a long digit string, seven digits at a time."""
    parts = F.regexp_extract_all(digits, F.lit("[0-9]{1,7}"), F.lit(0))
    step = lambda r, p: F.pmod(r * F.pow(F.lit(10.0), F.length(p)).cast("long") + p.cast("long"), F.lit(97).cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), step)


def _numbers(x: Column) -> Column:
    """Digits with each capital letter as two, A = 10."""
    number = lambda c: F.when(F.regexp_like(c, F.lit("^[A-Z]$")), (F.ascii(c) - 55).cast("string")).otherwise(c)
    return F.array_join(F.transform(F.split(x, ""), number), "")


def _groups(m: Column) -> Column:
    """The groups of a candidate, each but the first with the separator before it."""
    return F.split(m, "(?=[\\x20-])")


def _span(groups: Column, i: Column, j: Column) -> Column:
    return F.array_join(F.slice(groups, i + 1, j - i + 1), "")


def _account_ok(m: Column) -> Column:
    bare = F.regexp_replace(m, "\\x20", "")
    body = F.substr(bare, F.lit(5))
    return F.length(body).between(11, 30) & (F.length(only_digits(body)) >= 2) & (mod97(_numbers(F.concat(body, F.substring(bare, 1, 4)))) == 1)


def _account(m: Column) -> Column:
    """An account number with its digits permuted and its check digits made anew."""
    country, rest = F.substring(m, 1, 2), F.substr(m, F.lit(5))
    check = lambda b: F.lpad((98 - mod97(_numbers(F.concat(F.regexp_replace(b, "\\x20", ""), country, F.lit("00"))))).cast("string"), 2, "0")
    return _once(refill(rest, permute_digits(only_digits(rest), "iban")), lambda b: F.concat(country, check(b), b))


def _accounts(m: Column) -> Column:
    """struct<valid, made, n>. The longest span from the start that is an account number; cards are sought in what follows."""

    def cut(g: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda j: _account_ok(_span(g, F.lit(0), j)))
        return _once(F.array_max(ends), lambda j: F.struct(_span(g, F.lit(0), j).alias("own"), _span(g, F.coalesce(j, F.lit(-1)) + 1, F.size(g) - 1).alias("rest")))

    def both(x: Column) -> Column:
        own = F.when(x["own"].isNotNull(), _account(x["own"])).otherwise("")
        return _once(cards(x["rest"]), lambda c: F.struct(x["own"].isNotNull().alias("valid"), F.concat(own, c["out"]).alias("made"), c["n"].alias("n")))

    return _once(_once(_groups(m), cut), both)


def _iban(m: Column) -> tuple[Column, Column]:
    out = _accounts(m)
    return out["valid"], out["made"]


def _card_number(m: Column) -> Column:
    d = only_digits(m)
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    return refill(m, _once(permute_digits(body, "card"), lambda b: F.concat(b, luhn_digit(b))))


def cards(m: Column) -> Column:
    """struct<skip, n, out>: the text with the card numbers among its groups made anew, and how many."""

    def scan(g: Column) -> Column:
        def ok(x: Column) -> Column:
            d = only_digits(x)
            return F.length(d).between(13, 19) & F.regexp_like(x, F.lit(r"^[\x20-]?[0-9][0-9\x20-]*$")) & luhn_ok(d)

        def step(s: Column, i: Column) -> Column:
            # a span has 19 groups at most
            ends = F.filter(F.sequence(i, F.least(i + 18, F.size(g) - 1)), lambda j: ok(_span(g, i, j)))

            def turn(j: Column) -> Column:
                new = F.when(j.isNull(), F.get(g, i)).otherwise(_card_number(_span(g, i, j)))
                return F.struct((F.coalesce(j, i) + 1).alias("skip"), (s["n"] + F.when(j.isNull(), 0).otherwise(1)).alias("n"), F.concat(s["out"], new).alias("out"))

            return F.when(i < s["skip"], s).otherwise(_once(F.array_max(ends), turn))

        start = F.struct(F.lit(0).alias("skip"), F.lit(0).alias("n"), F.lit("").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), start, step)

    return _once(_groups(m), scan)


def _card(m: Column) -> tuple[Column, Column]:
    out = cards(m)
    return out["n"] > 0, out["out"]


def _phone(m: Column) -> tuple[Column, Column]:
    """The country code stays; national digits are permuted."""
    head = F.regexp_extract(m, r"^\+\d{1,3}(?=[\x20.(-])", 0)
    rest = F.substr(m, F.length(head) + 1)
    d = only_digits(rest)
    return F.length(only_digits(m)).between(7, 15) & (F.length(d) >= 6), F.concat(head, refill(rest, permute_digits(d, "phone")))


def _ip(m: Column) -> tuple[Column, Column]:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    half = lambda i: F.get(parts, F.lit(i)) * 256 + F.get(parts, F.lit(i + 1))
    mixed = feistel(half(0), half(2), F.lit(65536), F.lit(65536), F.lit(f"{_KEY.get()}|ip"))
    text = lambda s: F.concat_ws(".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)
    return F.forall(parts, lambda p: p <= 255), _once(mixed, text)


def _social(m: Column) -> tuple[Column, Column]:
    area = F.substring(m, 1, 3).cast("int")
    valid = (area > 0) & (area != 666) & (area < 900) & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    # areas without 666 are numbered from 0, groups and serials from 0
    left = F.when(area > 666, area - 2).otherwise(area - 1) * 99 + F.substring(m, 5, 2).cast("int") - 1
    mixed = feistel(left, F.substring(m, 8, 4).cast("int") - 1, F.lit(898 * 99), F.lit(9999), F.lit(f"{_KEY.get()}|social"))

    def text(s: Column) -> Column:
        k = F.floor(s["a"] / 99)
        back = F.when(k >= 665, k + 2).otherwise(k + 1)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(back, 3), pad(s["a"] % 99 + 1, 2), pad(s["b"] + 1, 4))

    return valid, _once(mixed, text)


def _date(m: Column) -> tuple[Column, Column]:
    """Year first, or two pairs and the year: day first unless only month first is a date."""
    year_first = F.regexp_like(m, F.lit(r"^\d{4}"))
    sep = F.when(year_first, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
    d = only_digits(m)
    parse = lambda y, mo, da: F.try_to_timestamp(F.concat_ws("-", y, mo, da), F.lit("yyyy-MM-dd")).cast("date")
    iso = parse(F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))
    dmy = parse(F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2))
    mdy = parse(F.substring(d, 5, 4), F.substring(d, 1, 2), F.substring(d, 3, 2))
    found = F.when(year_first, iso).otherwise(F.coalesce(dmy, mdy))
    order = F.when(year_first, F.lit("yyyyMMdd")).when(dmy.isNotNull(), F.lit("ddMMyyyy")).otherwise(F.lit("MMddyyyy"))
    day = F.datediff(found, F.lit(FIRST_DAY).cast("date"))
    mixed = feistel(F.floor(day / RIGHT), day % RIGHT, F.lit(LEFT), F.lit(RIGHT), F.lit(f"{_KEY.get()}|date"))

    def text(s: Column) -> Column:
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * RIGHT + s["b"]).cast("int"))
        y, mo, da = (F.date_format(new, p) for p in ("yyyy", "MM", "dd"))
        return (
            F.when(order == "yyyyMMdd", F.concat_ws("", y, sep, mo, sep, da))
            .when(order == "ddMMyyyy", F.concat_ws("", da, sep, mo, sep, y))
            .otherwise(F.concat_ws("", mo, sep, da, sep, y))
        )

    return found.isNotNull() & day.between(0, LEFT * RIGHT - 1), _once(mixed, text)


def _mail(m: Column) -> tuple[Column, Column]:
    """Letters and digits of the name are moved along keyed by the whole rest, place by place.

    Two passes, forward and back, make each character depend on all others."""
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def shift(c: Column, by: Column) -> Column:
        low = F.instr(F.lit(letters), F.lower(c))  # 1 to 26, else 0
        moved = F.substr(F.lit(letters), F.pmod(low - 1 + by, F.lit(26)).cast("int") + 1, F.lit(1))
        moved = F.when(F.lower(c) == c, moved).otherwise(F.upper(moved))
        digit = F.pmod(F.when(F.regexp_like(c, F.lit("^[0-9]$")), c.cast("long")) + by, F.lit(10)).cast("string")
        return F.when(F.regexp_like(c, F.lit("^[A-Za-z]$")), moved).when(digit.isNotNull(), digit).otherwise(c)

    def one_way(s: Column, tag: str) -> Column:
        def step(out: Column, c: Column) -> Column:
            return F.concat(out, shift(c, F.pmod(_noise(F.lit(f"{_KEY.get()}|mail|{tag}"), out, F.length(out)), F.lit(26 * 10).cast("long"))))

        return F.aggregate(F.split(s, ""), F.lit(""), step)

    twice = one_way(F.reverse(one_way(name, "on")), "back")
    return F.length(name) > 0, F.concat(F.reverse(twice), F.lit("@"), host)


RULES = {"mail": _mail, "iban": _iban, "ip": _ip, "date": _date, "social": _social, "phone": _phone, "card": _card}


def replaced(m: Column) -> Column:
    """struct<kind, made, cards> of one candidate; kind is null if no validator takes it."""
    kind, made = F.lit(None).cast("string"), m
    account, card = _accounts(m), cards(m)  # built once: they are large
    built = {"iban": (account["valid"], account["made"]), "card": (card["n"] > 0, card["out"])}
    for name, rule in reversed(RULES.items()):
        valid, new = built.get(name) or rule(m)
        test = F.regexp_like(m, F.lit("^(?:" + PATTERNS[name] + ")$")) & valid
        kind, made = F.when(test, F.lit(name)).otherwise(kind), F.when(test, new).otherwise(made)
    # what an account number leaves of its candidate, or all of one that is none, may hold cards
    run = F.regexp_like(m, F.lit("^(?:" + PATTERNS["iban"] + ")$"))
    made = F.when(run, account["made"]).otherwise(made)
    n = F.when(run, account["n"]).when(kind == "card", card["n"]).otherwise(0)
    return F.struct(kind.alias("kind"), made.alias("made"), n.alias("cards"))


def pseudonyms(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """doc_id, counts of each kind, the rewritten text.

    The key becomes part of the query's plan, so who may read plans and event logs may read it."""
    token = _KEY.set(key)
    try:
        return _pseudonyms(docs)
    finally:
        _KEY.reset(token)


def _pseudonyms(docs: DataFrame) -> DataFrame:
    text = whole_text()
    rows = docs.select("doc_id", text.alias("_t"))
    gaps = F.when(F.regexp_like("_t", F.lit(PATTERN)), F.split("_t", PATTERN, -1))
    found = F.regexp_extract_all("_t", F.lit(PATTERN), F.lit(0))
    # candidates are rewritten behind the split, so that each is worked out once
    rows = rows.select("doc_id", "_t", gaps.alias("_g")).select(
        "doc_id", "_t", "_g", F.when(F.col("_g").isNotNull(), F.transform(found, replaced)).alias("_f")
    )
    parts = F.transform(F.col("_g"), lambda g, i: F.concat(g, F.coalesce(F.get(F.col("_f"), i)["made"], F.lit(""))))
    number = lambda k: F.aggregate("_f", F.lit(0), lambda n, x: n + x["cards"]) if k == "card" else F.size(F.filter("_f", lambda x: x["kind"] == k))
    count = lambda k: F.when(F.col("_f").isNull(), 0).otherwise(number(k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, RULES), F.coalesce(F.array_join(parts, ""), F.col("_t")).alias("text"))

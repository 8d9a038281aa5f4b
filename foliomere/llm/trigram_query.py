"""Boolean trigram queries out of regular expressions.

What every match of a pattern must hold is worked out from its parts upwards. A part has the set of
all lower-case strings that it stands for, as long as those are few; else the sets of what it can
begin and end with. Alternatives are ORed, neighbours ANDed, and where two parts meet the trigrams
across their border count too. Parts that may be missing, and wide character classes, ask for nothing.

A query is an OR of ANDs: a set of sets of trigrams. The set with the empty set in it holds always.
Where a query or a set of strings would grow beyond MOST, it is made weaker, never stronger.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

#: Strings or branches that a part may have.
MOST = 48
#: Characters of a class up to which its strings are listed.
NARROW = 8
ALWAYS = frozenset({frozenset()})


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[k : k + 3] for k in range(len(s) - 2))


def either(*queries: frozenset) -> frozenset:
    branches = frozenset().union(*queries)
    least = frozenset(b for b in branches if not any(a < b for a in branches))
    return least if len(least) <= MOST else ALWAYS


def both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > MOST:
        return min(a, b, key=lambda q: (q == ALWAYS, len(q)))  # one of the two alone is weaker
    return either(frozenset(x | y for x, y in product(a, b)))


def of_strings(strings: frozenset[str]) -> frozenset:
    return either(frozenset(map(trigrams, strings))) if strings else ALWAYS


@dataclass(frozen=True)
class Part:
    """``all``: the strings that it stands for, if few; what it begins and ends with; what it must hold."""

    all: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    query: frozenset


def known(strings: frozenset[str]) -> Part:
    return Part(strings, strings, strings, of_strings(strings))


NOTHING = known(frozenset({""}))
ANYTHING = Part(None, frozenset({""}), frozenset({""}), ALWAYS)


def sized(strings: frozenset[str]) -> frozenset[str]:
    return strings if len(strings) <= MOST else frozenset({""})


def then(a: Part, b: Part) -> Part:
    """a followed by b."""
    if a.all is not None and b.all is not None and len(a.all) * len(b.all) <= MOST:
        return known(frozenset(x + y for x, y in product(a.all, b.all)))
    begins = sized(frozenset(x + y for x, y in product(a.all, b.begins))) if a.all is not None and len(a.all) * len(b.begins) <= MOST else a.begins
    ends = sized(frozenset(x + y for x, y in product(a.ends, b.all))) if b.all is not None and len(a.ends) * len(b.all) <= MOST else b.ends
    border = frozenset(x[-2:] + y[:2] for x, y in product(a.ends, b.begins))
    return Part(None, begins, ends, both(both(a.query, b.query), of_strings(sized(border))))


def either_part(parts: list[Part]) -> Part:
    strings = [p.all for p in parts]
    if all(s is not None for s in strings) and len(frozenset().union(*strings)) <= MOST:
        return known(frozenset().union(*strings))
    join = lambda sets: sized(frozenset().union(*sets))
    return Part(None, join(p.begins for p in parts), join(p.ends for p in parts), either(*(p.query for p in parts)))


def repeated(p: Part, least: int, most: int) -> Part:
    if least == 0:
        return either_part([NOTHING, p]) if most == 1 else ANYTHING
    out = p
    for _ in range(min(least, 3) - 1):  # more copies ask for nothing new
        out = then(out, p)
    return out if least == most <= 3 else Part(None, out.begins, out.ends, out.query)


def class_part(items: list) -> Part:
    codes: set[int] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            codes.add(value)
        elif str(op) == "RANGE" and value[1] - value[0] < NARROW:
            codes.update(range(value[0], value[1] + 1))
        else:
            return ANYTHING
    letters = frozenset(chr(c).lower() for c in codes)
    return known(letters) if len(letters) <= NARROW else ANYTHING


def part(tokens) -> Part:
    out = NOTHING
    for op, value in tokens:
        match str(op):
            case "LITERAL":
                one = known(frozenset({chr(value).lower()}))
            case "IN":
                one = class_part(value)
            case "BRANCH":
                one = either_part([part(x) for x in value[1]])
            case "SUBPATTERN":
                one = part(value[3])
            case "MAX_REPEAT" | "MIN_REPEAT" | "POSSESSIVE_REPEAT":
                one = repeated(part(value[2]), value[0], int(value[1]))
            case "AT" | "ASSERT" | "ASSERT_NOT":
                one = NOTHING
            case _:
                one = ANYTHING
        out = then(out, one)
    return out


def query_of(regex: str) -> list[list[str]]:
    """OR of ANDs of lower-case trigrams that the lower-cased text of any match satisfies; empty if a match need hold none."""
    found = part(re._parser.parse(regex)).query
    return [] if frozenset() in found else sorted(sorted(b) for b in found)

"""Secret scan through a trigram inverted index.

From each rule's regex a Boolean query over lower-case trigrams is derived, an OR of ANDs that every
match satisfies. Postings (trigram, document) are made for the trigrams that some
query asks for; intersecting them gives each document's candidate rules, and the regex is
verified there alone. Rules without mandatory trigrams scan every document.

Edge cases: a null text is empty; null ids are verified by every rule, as they can't be joined;
repeated ids share their candidates and are verified each by its own text; an empty table gives
no rows; other columns are passed over. Spans count code points, ends excluded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .trigram_query import query_of


@dataclass(frozen=True)
class Rule:
    """A match counts if ``group`` has ``least`` characters."""

    name: str
    regex: str
    group: int = 0
    least: int = 1

    def query(self) -> list[list[str]]:
        """OR of ANDs of trigrams; empty if a match need hold none."""
        return query_of(self.regex)


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The fixed base kinds come first; a run of fewer than the least characters can't hold a longer
#: one for access and hex, so the length stands in the pattern.
BASE = (
    Rule(
        "assign",
        "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
)
EXTRA = (
    Rule("temporary", "ASIA[A-Z0-9]{14,}"),
    Rule("forge", "(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", "-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("maps", "AIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", "[Bb]earer\\x20+[A-Za-z0-9+/_.=-]{20,}"),
    Rule("in_url", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]{6,}@"),
)
RULES = BASE + EXTRA


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """trigram, doc_id: the part of the inverted index that the rules' queries read."""
    asked = sorted({t for r in rules for one in r.query() for t in one})
    low = docs.select("doc_id", F.lower(whole_text()).alias("_low"))
    here = F.filter(F.array(*map(F.lit, asked)), lambda t: F.contains(F.col("_low"), t))
    return low.select("doc_id", F.explode(here).alias("trigram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, rules: documents in the intersection of some AND of each rule's query."""
    asked = [(t, r.name, k, len(one)) for r in rules for k, one in enumerate(r.query()) for t in one]
    # the query table: one short row for each trigram of the fixed rules
    terms = index.sparkSession.createDataFrame(asked, "trigram string, rule string, branch int, need int")
    met = (
        index.join(F.broadcast(terms), "trigram")
        .groupBy("doc_id", "rule", "branch")
        .agg(F.countDistinct("trigram").alias("have"), F.first("need").alias("need"))
        .filter("have = need")
    )
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kept>> of leftmost non-overlapping matches.

    The texts between the matches and the matches alternate, so their lengths give the places."""
    pattern = F.lit(rule.regex)
    gaps, found = F.split(text, rule.regex, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    empty = F.array().cast("array<struct<start:int,end:int,kept:boolean>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + x["m"]
        one = F.struct(begin.alias("start"), end.alias("end"), (x["t"] >= rule.least).alias("kept"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    rows = F.transform(
        found,
        lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("g"), F.length(m).alias("m"), F.length(F.get(tested, i)).alias("t")),
    )
    placed = F.aggregate(rows, start, step, lambda acc: acc["out"])
    return F.filter(placed, lambda s: s["kept"])


def _named(found: Column, kind: int, name: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), s["end"].alias("end")))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, text and ``found``: array<struct<start, kind, name, end>> in order of place."""
    given = candidates(postings(docs, rules), rules)
    rows = docs.select("doc_id", whole_text().alias("text")).join(given, "doc_id", "left")
    kinds = []
    for k, r in enumerate(rules):
        may = F.regexp_like("text", F.lit(r.regex))
        if r.query():
            may = (F.col("doc_id").isNull() | F.array_contains(F.coalesce("rules", F.array().cast("array<string>")), r.name)) & may
        kinds.append(F.when(may, _named(spans(F.col("text"), r), k, r.name)).otherwise(F.array().cast("array<struct<start:int,kind:int,name:string,end:int>>")))
    return rows.select("doc_id", "text", F.sort_array(F.concat(*kinds)).alias("found"))


def listing(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """The digest of the query: counts of the base kinds, their hash, and all spans."""
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    count = lambda name: F.size(F.filter("found", lambda s: s["name"] == name)).cast("long").alias(f"n_{name}")
    return scan(docs).select(
        "doc_id", *(count(r.name) for r in BASE), F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("found")).alias("spans")
    )

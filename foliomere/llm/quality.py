"""Quality rules: a table of thresholds compiled into one projection, no user functions.

Edge cases: a null text counts as empty; an empty text has no words, so it fails the
base rule; null ids and extra columns are passed over; repeated rows give repeated rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, whole_text, words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the of and to in a is that for it was on with as be by at this from or an are not "
    "de la le les et des en du un une que pour dans est qui sur pas par au "
    "der die und das von zu den mit ist auf ein eine nicht für sich dem "
    "el los las y por con del se su al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie within [low, high]; a null bound is open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. Ratios are integers per thousand so that no rounding differs between engines.
RULES = (
    Rule("n_words", 50, 200_000),
    Rule("mean_word_mille", 1_500, 15_000),
    Rule("symbol_mille", None, 100),
    Rule("stop_mille", 20, None),
    Rule("dup_line_mille", None, 500),
    Rule("bullet_mille", None, 900),
    Rule("ellipsis_mille", None, 300),
)


def repeated_window_words(ws: Column) -> Column:
    """How many words stand in a 3-word window that the text holds twice or more.

    Windows are sorted with their places; equal neighbours are repeats. Work per text is
    n log n and needs no shuffle."""
    n = F.size(ws)
    # `transform(ws, (w, i))` walks the array once; the next two words come by index
    keyed = F.transform(
        F.slice(ws, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")),
    )

    def covered(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        places = F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    # the lambda argument binds the sorted array once
    return F.when(n < 4, F.lit(0)).otherwise(
        F.get(F.transform(F.array(F.sort_array(keyed)), covered), F.lit(0))
    )


def measures(docs: DataFrame) -> DataFrame:
    """All measures of each text beside ``doc_id``."""
    blank = F.lit(f"[^{SPACES}]")
    base = docs.select("doc_id", whole_text().alias("_t"))
    base = base.select("doc_id", "_t", words(F.col("_t")).alias("_w"), F.split("_t", "\n", -1).alias("_all"))
    base = base.withColumn("_l", F.filter("_all", lambda x: F.regexp_like(x, blank)))
    n = F.size("_w").cast("long")
    lines = F.size("_l").cast("long")
    chars = F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))
    stop = F.array(*[F.lit(x) for x in STOP_WORDS])
    body = F.length(F.translate("_t", SPACES, "")).cast("long")

    def mille(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.expr("1000") * part.cast("long")).otherwise(0) / F.greatest(whole, F.lit(1))

    return base.select(
        "doc_id",
        n.alias("n_words"),
        body.alias("word_chars"),
        chars.cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        mille(body, n).alias("mean_word_mille"),
        mille(chars, body).alias("symbol_mille"),
        mille(F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))), n).alias("stop_mille"),
        mille(lines - F.size(F.array_distinct("_l")), lines).alias("dup_line_mille"),
        mille(F.size(F.filter("_l", lambda x: F.regexp_like(x, F.lit(r"^[ \t]*[-*•]")))), lines).alias("bullet_mille"),
        mille(F.size(F.filter("_l", lambda x: F.regexp_like(x, F.lit(r"(\.\.\.|…)[ \t\r]*$")))), lines).alias("ellipsis_mille"),
    )


def verdict(rules=RULES) -> Column:
    """The threshold table as one Boolean column."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (F.col(r.measure) >= F.lit(r.low))
        if r.high is not None:
            out = out & (F.col(r.measure) <= F.lit(r.high))
    return out


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measures, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measures(docs).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))

"""Where the text of a row stands among the lines of its document: a ladder from equal lines to token windows.

Every step is an equi-join on line texts or token pairs; no row is held against all lines. Texts that several rows share
are aligned once. Steps, of which the first that answers counts:

1. the text's lines stand in the document one after another;
2. they stand there in order with others between, where two lines of one visual row may be joined in reverse;
3. the text's tokens run through up to WIDEST lines, and one window of the fewest lines holds them.

Several answers of a step are told apart by the row's hints of page and line, else the row is ambiguous.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from foliomere.functions.text import layout_text, layout_tokens

from .asof import asof_join
from .cut import cut

#: Lines that a window of tokens may take.
WIDEST = 4
_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
_DOC, _TEXT = ["relpath"], ["relpath", "tid"]


def allowed_pages(owners: list[DataFrame], pages: DataFrame) -> DataFrame:
    """relpath, row_id, allowed: the pages of the statements that own a row.

    ``owners``: relpath, row_id, statement_id of each kind of row, ``pages``: statement_id, page; a row may have several owners."""
    both = owners[0]
    for o in owners[1:]:
        both = both.unionByName(o)
    rows = both.filter("row_id is not null").distinct().join(pages, "statement_id")
    return rows.groupBy("relpath", "row_id").agg(F.array_sort(F.collect_set("page")).alias("allowed"))


def _word_tokens(s: str) -> Column:
    """Tokens of a line, each with the number of its word."""
    token = lambda word, k: F.transform(layout_tokens(word), lambda t: F.struct(t.alias("t"), k.alias("w")))
    return F.flatten(F.transform(F.split(s, " ", -1), token))


def numbered(lines: DataFrame) -> DataFrame:
    """relpath, idx (place in the document), page, line, s, tokens (structs t, w: the word a token is of), base (tokens before), joins.

    ``lines``: relpath, page, line, text, top, bottom. ``joins`` is the next line's tokens and this line's, where both share a visual row."""
    w = Window.partitionBy("relpath").orderBy("page", "line")
    rows = lines.select(*_DOC, "page", "line", "top", "bottom", layout_text(F.col("text")).alias("s"))
    rows = rows.withColumn("tokens", _word_tokens("s"))
    after = lambda c: F.lead(c).over(w)
    beside = (after("page") == F.col("page")) & (F.greatest("top", after("top")) <= F.least("bottom", after("bottom")))
    beside &= F.col("top").isNotNull() & F.col("bottom").isNotNull() & after("top").isNotNull() & after("bottom").isNotNull()
    texts = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), " ")
    joins = F.when(beside, F.trim(F.concat(texts(after("tokens")), F.lit(" "), texts(F.col("tokens")))))
    before = F.coalesce(F.sum(F.size("tokens")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(*_DOC, (F.row_number().over(w) - 1).alias("idx"), "page", "line", "s", "tokens", before.alias("base"), joins.alias("joins"))


def _allowed(page: str = "page") -> Column:
    return F.col("allowed").isNull() | F.array_contains("allowed", F.col(page))


def equal_runs(parts: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that equal a part (relpath, tid, k, idx), and the runs of a text's parts (relpath, tid, start, page, line)."""
    hit = parts.join(lines.select(*_DOC, "s", "idx", "page", "line"), [*_DOC, "s"]).filter(_allowed())
    first = lambda c: F.max(F.when(F.col("k") == 0, F.col(c))).alias(c)
    runs = hit.groupBy(*_TEXT, "n", (F.col("idx") - F.col("k")).alias("start")).agg(F.count("*").alias("c"), first("page"), first("line"))
    return hit.select(*_TEXT, "n", "k", "idx"), runs.filter("c = n").select(*_TEXT, "start", "page", "line")


def _first_paths(steps: list, n: int) -> list[list[int]]:
    """The first two increasing choices of one (k, lo, hi) for each of n parts, in order of their places."""
    by_part = [[] for _ in range(n)]
    for s in steps:
        by_part[s["k"]].append((s["lo"], s["hi"]))
    bound = float("inf")
    for k in range(n - 1, -1, -1):  # what leads to no full choice is left out before
        by_part[k] = sorted(c for c in by_part[k] if c[1] < bound)
        if not by_part[k]:
            return []
        bound = by_part[k][-1][0]
    out: list[list[int]] = []

    def follow(path: list[int], k: int) -> None:
        if k == n:
            out.append(path)
            return
        for lo, hi in by_part[k]:
            if len(out) == 2:
                return
            if not path or lo > path[-1]:
                follow([*path, *range(lo, hi + 1)], k + 1)

    follow([], 0)
    return out


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def first_paths(steps: pd.Series, n: pd.Series) -> pd.Series:
    """The lines of the first two ordered choices of each text's parts."""
    return pd.Series([_first_paths(list(s), k) for s, k in zip(steps, n)])


def ordered_parts(parts: DataFrame, hit: DataFrame, lines: DataFrame) -> DataFrame:
    """relpath, tid, paths of texts of several lines: up to two choices of lines in order."""
    several = parts.filter("n > 1")
    single = hit.filter("n > 1").select(*_TEXT, "n", "k", F.col("idx").alias("lo"), F.col("idx").alias("hi"))
    turned = several.withColumn("joins", F.array_join(layout_tokens(F.col("s")), " ")).join(lines.filter("joins is not null").select(*_DOC, "joins", "idx", "page"), [*_DOC, "joins"])
    turned = turned.filter(_allowed()).select(*_TEXT, "n", "k", F.col("idx").alias("lo"), (F.col("idx") + 1).alias("hi"))
    each = single.union(turned).groupBy(*_TEXT, "n").agg(F.collect_list(F.struct("k", "lo", "hi")).alias("steps"), F.count_distinct("k").alias("met"))
    return each.filter("met = n").select(*_TEXT, first_paths("steps", "n").alias("paths")).filter(F.size("paths") > 0)


def token_windows(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """relpath, tid, n_windows, places, ranges: the narrowest windows of lines that hold a text's tokens, and the one if single.

    The rarest pair of neighbouring tokens (the token, if there is one only) leads to the places that are compared."""
    needles = cut(texts.select(*_TEXT, "allowed", layout_tokens(F.array_join("parts", " ")).alias("needle")).filter(F.size("needle") > 0))
    pairs = F.transform(F.slice("needle", 2, F.size("needle")), lambda t, i: F.concat(F.lit("2 "), F.get("needle", i), F.lit(" "), t))
    keys = F.when(F.size("needle") == 1, F.transform("needle", lambda t: F.concat(F.lit("1 "), t))).otherwise(pairs)
    each = needles.select(*_TEXT, F.size(keys).alias("asked"), F.posexplode(keys).alias("j", "key"))
    # tokens go out by what a text of their document asks for, not by all they could be asked
    wanted = each.groupBy(*_DOC).agg(F.collect_set("key").alias("_keys"))
    down = Window.partitionBy("relpath").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.get("tokens", F.lit(0))["t"], ignorenulls=True).over(down)
    rows = lines.select(*_DOC, "idx", "base", F.transform("tokens", lambda x: x["t"]).alias("ts"), after.alias("after")).filter(F.size("ts") > 0).join(wanted, _DOC)
    one = lambda t: F.concat(F.lit("1 "), t)
    two = lambda t, i: F.concat(F.lit("2 "), t, F.lit(" "), F.coalesce(F.get("ts", i + 1), F.col("after")))
    of_token = lambda t, i: F.array(*(F.struct((F.col("base") + i).alias("pos"), k.alias("key")) for k in (one(t), two(t, i))))
    rows = rows.select(*_DOC, "_keys", F.flatten(F.transform("ts", of_token)).alias("at"))
    rows = rows.withColumn("_met", F.array_intersect(F.transform("at", lambda x: x["key"]), "_keys"))
    listed = cut(rows.select(*_DOC, F.inline(F.filter("at", lambda x: F.array_contains("_met", x["key"])))))
    often = listed.groupBy(*_DOC, "key").agg(F.count("*").alias("c"))
    rarest = each.join(often, [*_DOC, "key"]).groupBy(*_TEXT, "asked").agg(F.count("*").alias("met"), F.min(F.struct("c", "j", "key")).alias("x")).filter("met = asked")
    near = rarest.select(*_TEXT, "x.j", "x.key").join(listed, [*_DOC, "key"]).select(*_TEXT, (F.col("pos") - F.col("j")).alias("pos")).filter("pos >= 0")
    # the line of a place is the last that begins at or before it
    near = asof_join(near, lines.filter(F.size("tokens") > 0).select(*_DOC, "base", "idx"), _DOC, "pos", "base", ["idx", "base"])
    near = cut(near.select(*_TEXT, "idx", (F.col("pos") - F.col("base")).cast("int").alias("off")))
    # only the lines of windows that begin somewhere are brought together
    begins = near.select(*_DOC, "idx").distinct().select(*_DOC, F.col("idx").alias("start"), F.explode(F.sequence(F.col("idx"), F.col("idx") + WIDEST - 1)).alias("idx"))
    shown = begins.join(lines.select(*_DOC, "idx", "page", "s"), [*_DOC, "idx"]).withColumn("tokens", _word_tokens("s"))
    around = shown.groupBy(*_DOC, F.col("start").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "page", "tokens"))), lambda x: F.struct(x["page"].alias("page"), x["tokens"].alias("tokens"))).alias("ls"))
    begun = near.join(needles, _TEXT).join(around, [*_DOC, "idx"])
    flat = F.flatten(F.transform("ls", lambda x, k: F.transform(x["tokens"], lambda t: F.struct(t["t"].alias("t"), t["w"].alias("w"), k.alias("k")))))
    found = begun.withColumn("own", F.slice(flat, F.col("off") + 1, F.size("needle"))).filter(F.transform("own", lambda x: x["t"]) == F.col("needle"))
    found = found.withColumn("width", F.array_max(F.transform("own", lambda x: x["k"])) + 1)
    pages = F.transform(F.slice("ls", 1, F.col("width")), lambda x: x["page"])
    found = found.filter(F.col("allowed").isNull() | F.forall(pages, lambda p: F.array_contains("allowed", p)))

    def words(k: Column) -> Column:
        of_line = F.transform(F.filter("own", lambda x: x["k"] == k), lambda x: x["w"])
        return F.when(F.size(of_line) > 0, F.struct(F.array_min(of_line).alias("first"), (F.array_max(of_line) + 1).alias("last")))

    ranges = F.transform(F.sequence(F.lit(0), F.col("width") - 1), words)
    first = found.groupBy(*_TEXT, "idx").agg(F.min(F.struct("width", "off", ranges.alias("ranges"))).alias("x")).select(*_TEXT, "idx", "x.width", "x.ranges")
    least = F.min("width").over(Window.partitionBy(*_TEXT))
    narrow = first.withColumn("least", least).filter("width = least")
    places = F.sequence(F.col("idx"), F.col("idx") + F.col("width") - 1)
    return narrow.groupBy(*_TEXT).agg(F.count("*").alias("n_windows"), F.min(F.struct(places.alias("places"), "ranges")).alias("x")).select(*_TEXT, "n_windows", "x.places", "x.ranges")


def aligned(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """relpath, row_id, status, method, confidence, places, ranges of each row.

    ``rows``: relpath, row_id, raw, page_hint, line_hint, allowed (pages of its statement; null: all); ``lines``: relpath, page,
    line, text, top, bottom. ``places`` are lines counted from 0 in the document, ``ranges`` the words taken of each
    (null: the whole line). A text without tokens or lines is unmatched; a document without lines has no_coordinates."""
    # what several steps read is written once: folded texts and lines, what equals them, what is left for the next step
    tid = F.sha2(F.to_json(F.struct("raw", "allowed")), 256)
    asked = cut(rows.select("relpath", "row_id", "raw", "page_hint", "line_hint", "allowed").withColumn("tid", tid))
    parts = F.filter(F.transform(F.split(F.coalesce("raw", F.lit("")), _BREAKS, -1), layout_text), lambda x: x != "")
    texts = cut(asked.dropDuplicates(_TEXT).select(*_TEXT, "allowed", parts.alias("parts")).filter(F.size("parts") > 0))
    shown = cut(numbered(lines))
    each = texts.select(*_TEXT, "allowed", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "s"))
    hit, runs = equal_runs(each, shown)
    runs = cut(runs)
    all_runs = runs.groupBy(*_TEXT).agg(F.count("*").alias("n_all"), F.min("start").alias("all"))
    page_runs = runs.groupBy(*_TEXT, F.col("page").alias("page_hint")).agg(F.count("*").alias("n_page"), F.min("start").alias("of_page"))
    line_runs = runs.groupBy(*_TEXT, F.col("page").alias("page_hint"), F.col("line").alias("line_hint")).agg(F.count("*").alias("n_line"), F.min("start").alias("of_line"))
    left = cut(texts.join(all_runs.select(*_TEXT), _TEXT, "left_anti"))
    paths = cut(ordered_parts(each.join(left.select(*_TEXT), _TEXT, "left_semi"), hit.join(left.select(*_TEXT), _TEXT, "left_semi"), shown))
    firsts = paths.select(*_TEXT, F.explode("paths").alias("path")).select(*_TEXT, "path", F.get("path", F.lit(0)).alias("idx"))
    pages = firsts.join(shown.select(*_DOC, "idx", "page"), [*_DOC, "idx"]).groupBy(*_TEXT).agg(F.collect_list(F.struct("page", "path")).alias("chosen"))
    windows = token_windows(left.join(paths.select(*_TEXT), _TEXT, "left_anti"), shown)

    met = asked.join(texts.select(*_TEXT, F.size("parts").alias("n")), _TEXT, "left").join(all_runs, _TEXT, "left")
    met = met.join(page_runs, [*_TEXT, "page_hint"], "left").join(line_runs, [*_TEXT, "page_hint", "line_hint"], "left")
    met = met.join(pages, _TEXT, "left").join(windows, _TEXT, "left").join(shown.groupBy(*_DOC).agg(F.lit(True).alias("printed")), _DOC, "left")
    own_page = F.filter("chosen", lambda c: c["page"].eqNullSafe(F.col("page_hint")))
    none = F.lit(None)
    rules = [  # condition, status, method, confidence, places, ranges
        (F.col("printed").isNull(), "no_coordinates", "pdf_has_no_coordinate_lines", none, none),
        (F.col("n").isNull(), "unmatched", None, none, none),
        (F.col("n_line") == 1, "exact", "persisted_page_line", F.col("of_line"), none),
        (F.col("n_page") == 1, "exact", "persisted_page", F.col("of_page"), none),
        (F.col("n_all") == 1, "exact", "exact_line_sequence", F.col("all"), none),
        (F.col("n_all") > 1, "ambiguous", "repeated_exact_text", none, none),
        (F.size("chosen") == 1, "exact", "ordered_noncontiguous_lines", none, F.get("chosen", F.lit(0))["path"]),
        ((F.size("chosen") > 1) & (F.size(own_page) == 1), "exact", "ordered_noncontiguous_persisted_page", none, F.get(own_page, F.lit(0))["path"]),
        (F.size("chosen") > 1, "ambiguous", "repeated_ordered_text", none, none),
        (F.col("n_windows") == 1, "unique_tokens", "unique_contiguous_tokens", none, F.col("places")),
        (F.col("n_windows") > 1, "ambiguous", "repeated_token_sequence", none, none),
        (F.lit(True), "unmatched", "no_unique_text_alignment", none, none),
    ]
    status, method, start, listed = (F.lit(None) for _ in range(4))
    for cond, s, m, at, path in reversed(rules):
        status, method = F.when(cond, s).otherwise(status), F.when(cond, F.lit(m)).otherwise(method)
        start, listed = F.when(cond, at).otherwise(start), F.when(cond, path).otherwise(listed)
    out = met.select("relpath", "row_id", status.alias("status"), method.alias("method"), "n", start.cast("int").alias("start"), listed.cast("array<int>").alias("listed"), "ranges")
    places = F.when(F.col("start").isNotNull(), F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).otherwise(F.col("listed"))
    confidence = F.when(F.col("status") == "exact", 1.0).when(F.col("status") == "unique_tokens", 0.95)
    return out.select("relpath", "row_id", "status", "method", confidence.alias("confidence"), places.alias("places"), F.when(F.col("status") == "unique_tokens", F.col("ranges")).alias("ranges"))

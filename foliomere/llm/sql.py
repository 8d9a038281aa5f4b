"""DuckDB SQL for the text queries that SQL can express over whole tables."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from . import lexical_search as lexical
from . import near_dup
from . import vector_codes as vc
from .common import SPACES
from .quality import RULES, STOP_WORDS, SYMBOLS

_BLANKS = r"[ \t\n\x0B\f\r]"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_BLANKS}+'), lambda x: x <> '')"


def _bounds() -> str:
    """The threshold table as conditions."""
    low = [f"{r.measure} >= {r.low}" for r in RULES if r.low is not None]
    high = [f"{r.measure} <= {r.high}" for r in RULES if r.high is not None]
    return " AND ".join(low + high)


def _mille(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN 1000 * {part} ELSE 0 END) / greatest({whole}, 1)"


def quality() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return f"""WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS t FROM documents),
 parted AS (SELECT *, {_words("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANKS[1:-1]}]')) AS ls FROM texts),
 placed AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM parted),
 windows AS (SELECT rid, i, w, lead(w) OVER k AS w2, lead(w, 2) OVER k AS w3 FROM placed WINDOW k AS (PARTITION BY rid ORDER BY i)),
 again AS (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM windows WHERE w3 IS NOT NULL),
 covered AS (SELECT rid, COUNT(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY rid),
 counts AS (SELECT doc_id, len(ws) AS n_words, length(translate(t, '{SPACES}', '')) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, COALESCE(n, 0) AS n_repeat_words, len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[ \\t]*[-*•]'))) AS n_bullets, len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t\\r]*$'))) AS n_ellipses
  FROM parted LEFT JOIN covered USING (rid)),
 measures AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_mille("word_chars", "n_words")} AS mean_word_mille, {_mille("n_symbols", "word_chars")} AS symbol_mille,
  {_mille("n_stop", "n_words")} AS stop_mille, {_mille("n_dup_lines", "n_lines")} AS dup_line_mille, {_mille("n_bullets", "n_lines")} AS bullet_mille, {_mille("n_ellipses", "n_lines")} AS ellipsis_mille,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND {_bounds()} AS kept FROM measures"""


def near_duplicates() -> str:
    """All pairs that share a shingle, exact similarity, then reachability."""
    n, percent = near_dup.SHINGLE, near_dup.PERCENT
    lower = f"translate(COALESCE(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
    return f"""WITH RECURSIVE parted AS (SELECT doc_id, {_words(lower)} AS ws FROM documents),
 sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')) END) AS s FROM parted),
 shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, COUNT(*) AS i FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM shared WHERE 100 * i >= {percent} * (na + nb - i) UNION ALL SELECT b, a FROM shared WHERE 100 * i >= {percent} * (na + nb - i)),
 reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
 least_ids AS (SELECT a AS doc_id, MIN(b) AS low FROM reach GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, COALESCE(low, doc_id)) AS component_id, doc_id = least(doc_id, COALESCE(low, doc_id)) AS kept FROM sets LEFT JOIN least_ids USING (doc_id)"""


def exact_duplicates() -> str:
    return """WITH rows AS (SELECT doc_id, sha256(COALESCE(text, '')) AS text_sha256 FROM documents),
 seen AS (SELECT *, MAX(doc_id) OVER w AS keep_id, COUNT(*) OVER w AS group_size FROM rows WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM seen"""


def vector_codes() -> str:
    """The rounds written out; squared distances of whole numbers are exact in doubles."""
    parts, scale, rounds = vc.PARTS, vc.SCALE, vc.ROUNDS
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM parts QUALIFY e < {vc.ENTRIES})",
    ]
    for k in range(rounds + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT r, p, x, any_value(vec_id) AS vec_id, min(d * 256 + e) AS de FROM (SELECT r, vec_id, parts.p, x, e, list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y) AS d FROM parts JOIN book{k} b ON parts.p = b.p) GROUP BY r, p, x)")
        if k < rounds:
            steps.append(f"at{k} AS (SELECT p, de % 256 AS e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM near{k})")
            steps.append(f"mean{k} AS (SELECT p, e, list(f ORDER BY i) AS y FROM (SELECT p, e, i, floor(SUM(c) / COUNT(*)) AS f FROM at{k} GROUP BY ALL) GROUP BY p, e)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, COALESCE(m.y, b.y) AS y FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)")
    steps += [
        f"codes AS (SELECT vec_id, string_agg(printf('%02x', CAST(de % 256 AS BIGINT)), '' ORDER BY p) AS code, CAST(SUM(floor(de / 256)) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})",
    ]
    return "WITH " + ",\n ".join(steps) + """
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), digest"""


def _terms(text: str) -> str:
    lower = f"translate(COALESCE({text}, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def lexical_search() -> str:
    return f"""WITH docs AS MATERIALIZED (SELECT doc_id, {_terms("text")} AS ts FROM documents),
 items AS (SELECT item_id, unnest(list_distinct({_terms("text")})) AS t FROM benchmark),
 totals AS (SELECT COUNT(*) AS n_docs, CAST(SUM(len(ts)) AS BIGINT) AS n_terms FROM docs WHERE len(ts) > 0),
 held AS MATERIALIZED (SELECT doc_id, n, t, COUNT(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM docs) WHERE t IN (SELECT t FROM items) GROUP BY ALL),
 weights AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT t, COUNT(*) AS df FROM held GROUP BY t), totals),
 impacts AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS s FROM held JOIN weights USING (t), totals),
 scores AS (SELECT item_id, doc_id, CAST(SUM(s) AS BIGINT) AS score FROM items JOIN impacts USING (t) GROUP BY ALL HAVING SUM(s) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores QUALIFY rank <= {lexical.TOP}"""

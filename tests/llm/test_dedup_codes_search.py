"""Exact duplicates, vector codes and lexical search against plain versions, with odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import ODD, SF, lines_plain

from foliomere.llm import decontaminate, exact_dedup, lexical_search, line_dedup, near_dup, vector_codes
from foliomere.llm.common import drop_staged, join_groups, table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def duplicates_plain(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    low = lambda ids: max(ids, key=lambda x: (x is not None, x or 0))
    return sorted(((d, low(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g), key=repr)


def test_exact_duplicates(spark):
    rows = [*ODD, *[(100 + k, "same") for k in range(400)], (None, "same"), *[(1000 + k, f"own {k}") for k in range(300)], (3, "case"), (4, "Case"), (5, "case ")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, h string, text_sha256 int").repartition(7)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == duplicates_plain(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept) and len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    one = exact_dedup.dedup(docs).collect()
    assert sorted((r.text or "" for r in one)) == sorted({t or "" for _, t in rows}) and one[0].h == "x"
    assert {r.doc_id for r in one if r.text == "same"} == {499}
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0 and exact_dedup.dedup(docs.limit(0)).count() == 0


def test_filter_holds_all_repeated_hashes_and_few_others(spark, monkeypatch):
    rows = spark.createDataFrame([(random.Random(k // 2 if k < 4000 else k).getrandbits(62),) for k in range(24_000)], "h long")
    for blocks in (exact_dedup.BROADCAST_BLOCKS, 0):  # by broadcast and by a shuffle
        monkeypatch.setattr(exact_dedup, "BROADCAST_BLOCKS", blocks)
        bloom = exact_dedup.bloom_filter(rows)
        seen = exact_dedup.marked(rows.withColumn("k", rows.h), bloom)
        repeated = {r.h for r in rows.groupBy("h").count().filter("count > 1").collect()}
        found = [r.h for r in seen.filter("_again").collect()]
        assert seen.count() == 24_000 and repeated <= set(found) and len(found) - 2 * len(repeated) < 200


def test_groups_join_by_broadcast_and_by_shuffle(spark):
    rows = spark.range(5000).selectExpr("id", "if(id < 2000, 0, id div 2) as g")
    groups = rows.groupBy("g").count()
    got = join_groups(rows, groups, ["g"], "count").collect()
    assert len(got) == 5000 and all(r["count"] == (2000 if r.g == 0 else 2) for r in got)


def codes_plain(rows, rounds=4):
    rows = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in rows), default=0)
    w = -(-longest // 4)
    rows = [(i, v + [0] * (4 * w - len(v)), lab) for i, v, lab in rows]
    first = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[:256]
    books = [[r[1][p * w : (p + 1) * w] for r in first] for p in range(4)]
    part = lambda r, p: r[1][p * w : (p + 1) * w]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(4):
            took = collections.defaultdict(list)
            for r in rows:
                took[near(p, part(r, p))[1]].append(part(r, p))
            books[p] = [[sum(c) // len(took[k]) for c in zip(*took[k])] if k in took else e for k, e in enumerate(books[p])]
    labels, out = collections.Counter(), []
    for r in rows:
        best = [near(p, part(r, p)) for p in range(4)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), r[2]))
        labels[r[2]] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[lab], digest) for i, c, e, lab in out), key=repr)


def codes_got(vectors):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compressed(vectors).collect()), key=repr)


def test_vector_codes_equal_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK_VECTORS", 100)  # several chunks a task
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(k, [c + rnd.gauss(0, 0.1) for c in rnd.choice(centres)], rnd.choice([0, 1, None])) for k in range(600)]
    rows += [(600 + k, centres[0], 7) for k in range(200)]  # a third of the rows alike
    rows += [(5, centres[1], 1), (5, centres[1], 1), (None, centres[2], 2), (-1, centres[0], 2), (900, None, 1), (901, [None] * 8, 1), (902, [math.nan] * 8, 1), (903, [math.inf] + [0.0] * 7, 1), (904, [], 1), (905, [0.5] * 5, 1)]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, v int").repartition(3)
    assert codes_got(vectors) == codes_plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0, 3.0, 4.0], 1)], [(1, [], None), (2, [], None)], [(k, [3e9 * (k % 3), 1.0, 2.0, 5.0 * k], 1) for k in range(40)]])
def test_vector_codes_of_few_and_of_large_vectors(spark, rows):
    got, want = codes_got(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), codes_plain(rows)
    if rows and rows[0][1] and max(map(abs, rows[-1][1])) > 1e9:  # errors leave 64 bits; codes do not
        got, want = [x[:2] for x in got], [x[:2] for x in want]
    assert got == want


def test_only_parts_with_passed_bounds_are_popped(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(256, 16))
    rows = [(k, (centres[k % 256] + (rnd.normal(scale=0.01, size=16) if k >= 256 else 0)).tolist(), 0) for k in range(4000)]
    whole = vector_codes.kept_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    start = np.array([r.v for r in whole.orderBy("vec_id").limit(256).collect()]).reshape(256, 4, 4).transpose(1, 0, 2)
    book = vector_codes.Codebook(start)
    state = vector_codes.assigned(vector_codes.chunks(whole, 4), book, first=True).cache()
    again = vector_codes.assigned(state, book.moved(start + 1), first=False).collect()
    assert sum(r.popped for r in state.collect()) == 16_000 and sum(r.popped for r in again) < 4_000
    still = np.concatenate([np.frombuffer(r.codes, np.uint8) for r in again])
    assert len(still) == 16_000


def search_plain(docs, items, top=50):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = lambda t: TERM.findall((t or "").translate(fold))
    docs = [(d, collections.Counter(ts), len(ts)) for d, t in docs if (ts := terms(t))]
    n, total = len(docs), sum(x[2] for x in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for i, text in set(items):
        found = []
        for d, c, m in docs:
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + (50 * m * n) // total))) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, d is not None, d or 0, d))
        out += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def search_got(docs, items, **kw):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.search(docs, items, **kw).collect()), key=repr)


def test_lexical_search_equals_plain_ranking(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()] + [x for x in ODD if x[0] != 4] + [(-70_000, "Word, a b-c"), (2**40, "word")]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()] + [(900, "word WORD a b"), (901, None), (902, "..."), (903, "ınever xyzzy"), (900, "word WORD a b"), (None, "é k")]
    docs = spark.createDataFrame([(d, t, 1, "t") for d, t in rows], "doc_id long, text string, n int, terms string").repartition(5)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    want = search_plain(rows, items)
    assert search_got(docs, bench) == want
    monkeypatch.setattr(lexical_search, "SLOTS", 16)  # several arrays a window
    assert search_got(docs, bench, terms_per_block=2000) == want
    assert search_got(docs.limit(0), bench) == [] and search_got(docs, bench.limit(0)) == []


def test_documents_under_one_id_are_ranked_each(spark):
    rows = [(7, "x " * (k % 5 + 1) + "y" * (k % 3)) for k in range(3000)] + [(k, "z") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = search_got(docs, spark.createDataFrame([(1, "x")], "item_id long, text string"))
    want = search_plain([(r.doc_id, r.text) for r in docs.collect()], [(1, "x")])
    assert got == want and len(got) == 50


def related_lines(rnd, n, common):
    """Lines of one topic: some share most of their words, all share the rare ones."""
    base = [f"w{k}" for k in range(24)]
    out = []
    for k in range(n):
        words = [*common, *base] if k % 3 else [*common, *(f"x{k}-{j}" for j in range(24))]
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(common), len(words))] = f"y{rnd.randrange(40)}"
        rnd.shuffle(words)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_long_lists_inside_one_document(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    topics = [f"z{k}" for k in range(4)]
    lines = related_lines(rnd, 90, topics)
    filler = [(100 + k, " ".join(f"w{j}" for j in range(24)) + f" f{k}") for k in range(60)]
    one = [(5, "\n".join(lines)), *filler]
    each = [(10 + k, x) for k, x in enumerate(lines)] + [(d + 1000, t) for d, t in filler]
    same_id = [(7, x) for x in lines]
    for rows in (one, each):
        got = {r.doc_id: r.removed for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        want = lines_plain(rows, line_dedup.PERCENT)
        assert {d: [int(x) for x in g.split(",") if x] for d, g in got.items()} == {d: sorted(want[d]) for d, _ in rows}
        assert sum(map(len, want.values())) > 30
    # texts of one id, or of none, come in the order of 32 bits of their hashes
    ordered = spark.createDataFrame(same_id, "doc_id long, text string").select("text", line_dedup.order_part(F.xxhash64("text")).alias("o")).orderBy("o").collect()
    want = lines_plain([(k, r.text) for k, r in enumerate(ordered)], line_dedup.PERCENT)
    for d in (7, None):
        got = {r.kept_sha256 for r in line_dedup.line_report(spark.createDataFrame([(d, x) for x in lines], "doc_id long, text string")).collect() if r.n_removed}
        gone = collections.Counter(bool(want[k]) for k in range(len(ordered)))
        report = line_dedup.line_report(spark.createDataFrame([(d, x) for x in lines], "doc_id long, text string")).collect()
        assert sum(r.n_removed for r in report) == gone[True] and len(got) == 1


def test_clean_rows_that_share_an_id_stay(spark):
    item = " ".join(f"b{k}" for k in range(40))
    rows = [(None, item), (None, "clean one"), (None, "clean two"), (7, item + " more"), (7, "clean text"), (8, "x")]
    docs = spark.createDataFrame([(d, t, "r", 1) for d, t in rows], "doc_id long, text string, _row string, _r int")
    left = decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r.text for r in left) == ["clean one", "clean text", "clean two", "x"] and left[0]._row == "r"
    near = [(1, item), (2, item + " more"), (2, "other"), (None, item + " again"), (None, "own")]
    docs = spark.createDataFrame([(d, t, "r", 1, 2) for d, t in near], "doc_id long, text string, _row string, _later int, _id int")
    kept = near_dup.keep_first(docs).collect()
    assert sorted(r.text for r in kept) == sorted([item, "other", "own"]) and docs.columns == near_dup.keep_first(docs).columns


def test_staged_tables_can_be_dropped(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    out = exact_dedup.exact_duplicates(docs)
    assert out.count() == len(ODD)
    left = drop_staged(spark)
    assert left > 0 and drop_staged(spark) == 0
    with pytest.raises(Exception):
        out.count()


def test_lists_that_may_be_long(spark):
    """Every list of more than SHORT sets is among those to count, and those of rare tokens are not."""
    n = 2 * line_dedup.SHORT
    docs = spark.createDataFrame([(k, " ".join(["often", *(f"x{k}-{j}" for j in range(9))])) for k in range(n)], "doc_id long, text string")
    sets = line_dedup.distinct_sets(line_dedup.line_sets(docs, line_dedup.rarity_classes(docs)))
    whole = sets.withColumn("prefix", F.sequence(F.lit(0), F.lit(0)).cast("array<long>"))
    assert line_dedup.postings(whole).filter(line_dedup.may_be_long()).count() == 0
    lists = line_dedup.postings(sets).groupBy("key").count().withColumn("long", line_dedup.may_be_long())
    assert lists.filter("not long").count() == lists.count() > n and lists.filter(f"count > {line_dedup.SHORT} and not long").count() == 0
    least = (line_dedup.SHORT + 1).bit_length()
    assert 2 ** (least - 1) - 1 <= line_dedup.SHORT < 2**least - 1

"""The stages of the corpus pipeline against plain versions, on the smallest tables and on odd rows."""

import collections
import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_text_operators import ODD, SF, classes_plain, crc, lines_plain, plain_ids

from foliomere.llm import decontaminate, line_dedup, toxicity, warc
from foliomere.llm.common import table


def agreeing_plain(doc, item):
    """Most tokens that agree in a window of ``item`` laid anywhere on ``doc``, also partly outside."""
    w = min(16, len(item))
    if not w or not len(doc):
        return 0
    pad = np.full(w, -1)
    same = np.concatenate([pad, doc, pad])[:, None] == item[None, :]
    along = same.astype(np.int32)
    for j in range(1, len(item)):
        along[1:, j] += along[:-1, j - 1]
    best = along[w - 1 :, w - 1].max()
    for j in range(w, len(item)):
        best = max(best, (along[w:, j] - along[:-w, j - w]).max())
    return int(best)


def overlaps_plain(rows, items):
    numbers = collections.defaultdict(lambda: len(numbers))
    coded = lambda t: np.array([numbers[x] for x in (t or "").lower().translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x], np.int64)
    items = [(k, coded(t)) for k, t in items]
    out = {}
    for d, t in rows:
        doc = coded(t)
        for k, item in items:
            need = 75 * min(16, len(item))
            if len(item) and 100 * np.isin(doc, item).sum() >= need and 100 * (n := agreeing_plain(doc, item)) >= need:
                out[(d, k)] = max(n, out.get((d, k), 0))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_overlaps_of_documents_and_benchmark(spark, docs):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = {(r.doc_id, r.item_id): r.agreeing for r in decontaminate.overlaps(docs, table(spark, SF, "benchmark")).collect()}
    assert got == overlaps_plain(texts(docs), items) and got


def test_stages_equal_plain_versions(spark, docs):
    labels = table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    scored = {r.doc_id: r.predicted for r in toxicity.scored(docs, model).collect()}
    assert sorted(texts(clean)) == sorted(x for x in texts(docs) if not scored[x[0]])

    lined = corpus_pipeline.drop_lines(spark, docs, SF)
    gone = lines_plain(texts(docs), line_dedup.PERCENT)
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in texts(docs)}
    assert dict(texts(lined)) == want and all(r.n_chars == len(r.text) for r in lined.collect() if gone[r.doc_id])

    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(d for d, _ in texts(near)) == sorted(d for d, _, low in classes_plain(texts(docs)) if d == low)

    found = {d for d, _ in overlaps_plain(texts(docs), [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])}
    assert sorted(d for d, _ in texts(corpus_pipeline.drop_contaminated(spark, docs, SF))) == sorted(d for d, _ in texts(docs) if d not in found)
    for out in (clean, lined, near):
        assert out.columns == corpus_pipeline.COLUMNS


def test_pipeline_packs_what_the_stages_keep(spark, docs):
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
    want = collections.Counter()
    for d, ids in plain_ids(texts(left), 0):
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[(d, k, crc(ids[at : at + 2048]))] += 1
    got = corpus_pipeline.run(spark, SF)
    assert collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in got.collect()) == want and 0 < left.count() < docs.count()


def test_stages_take_odd_rows(spark):
    odd = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "clash", 1) for d, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, gone string, _gone int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == corpus_pipeline.COLUMNS and stage(spark, odd.limit(0), SF).count() == 0
    assert line_dedup.dedup_lines(odd).columns == odd.columns
    assert corpus_pipeline.pack_sequences(spark, odd, SF).count() == len(ODD) + 1  # one text is longer than a sequence


def test_segments_are_those_of_the_definition():
    """Maximal segments by splitting at the best one, again and again, as the definition has it."""
    rng = np.random.default_rng(4)
    scan = toxicity.Scanner(toxicity.Model())

    def plain(x, first):
        best = (0.0, 0, 0)
        for a in range(len(x)):
            for z in range(a + 1, len(x) + 1):
                best = max(best, (round(float(x[a:z].sum()), 9), -(z - a), -a))
        if best[0] <= 0:
            return []
        a, z = -best[2], -best[2] - best[1]
        return [*plain(x[:a], first), (first + a, first + z), *plain(x[z:], first + z)]

    for _ in range(200):
        x = rng.normal(-0.3, 1, rng.integers(0, 25))
        assert [(a, z) for a, z, _ in scan.segments(list(x))] == plain(x, 0)


def test_held_out_accuracy(spark):
    """Texts that nothing was learned from; most are clean, so both kinds are asked for."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = toxicity.scored(docs, toxicity.train(docs, labels)).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    share = lambda kind: np.mean([r.predicted == kind for r in out if r.toxic == kind])
    assert share(1) >= 0.85 and share(0) >= 0.98
    none = toxicity.train(docs.limit(0), labels)
    assert toxicity.scored(docs.limit(0), none).count() == 0 and 0 <= none.probability(0.0) <= 1


def test_archive_records_of_pages(spark):
    pages = [(r.page_id, (r.html or "").encode()) for r in table(spark, SF, "pages").collect()]
    first = {}
    for p, data in pages:
        first[data] = max(p, first.get(data, p))
    got = {r.page_id: r for r in warc.round_trip(table(spark, SF, "pages")).collect()}
    assert len(got) == len(pages)
    for p, data in pages:
        r = got[p]
        assert r.payload_bytes == len(data) and (r.record_type, r.refers_to) == (("response", None) if first[data] == p else ("revisit", first[data])) and zlib.crc32(data) >= 0

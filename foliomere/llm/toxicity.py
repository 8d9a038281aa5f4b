"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts in how many labelled texts each feature (a word, or the first letters of a
longer one) occurs, toxic and not, and takes log-odds under a Dirichlet prior in proportion to
the corpus. Scanning gives each token its score less a drift and finds all maximal scoring
segments in one pass. Segment scores of clean labelled texts follow an extreme-value law, whose
parameters turn scores into expected numbers of chance segments; significant segments are added
up and calibrated to a probability.

Edge cases: null and empty texts have no tokens and get the lowest score; without usable labels
every text gets the prior; rows with null or repeated ids are scored each; labels with null
values are passed over, and of repeated labels the largest counts; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table, whole_text

#: Labelled texts that training reads at most, chosen by a hash of their ids.
SAMPLE = 20_000
#: Parts of the sample: one is calibrated on, the others are counted.
FOLDS = 5
#: Strength of the Dirichlet prior, in texts, and the z-value from which a feature counts.
PRIOR, Z = 100.0, 3.0
#: Taken from each token, so that chance segments stay short.
DRIFT = 0.3
#: Expected chance segments in a text below which a segment is significant.
SIGNIFICANT = 0.05
#: Lengths of the stems that stand for words not met in training, longest first.
STEMS = (6, 5, 4)
TOKEN = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)  # words, and stems behind a mark
    lam: float = 1.0
    k: float = 0.1
    middle: float = 0.0
    slope: float = 1.0
    prior: float = 0.5

    def probability(self, stat: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * (stat - self.middle)))))


def features(text: Column) -> Column:
    """Distinct features of a text, as the scan looks them up."""
    ws = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    stems = [F.transform(F.filter(ws, lambda w: F.length(w) > k), lambda w: F.concat(F.lit("^"), F.substring(w, 1, k))) for k in STEMS]
    return F.array_distinct(F.concat(ws, *stems))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, toxic of the labelled texts that are learned from."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


class Scanner:
    """Scores of tokens, kept for those seen lately, and the segment search."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def score(self, w: str) -> float:
        s = self.model.scores
        own = s.get(w)
        if own is None:
            own = next((s[x] for k in STEMS if len(w) > k and (x := "^" + w[:k]) in s), 0.0)
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[w] = own = own - DRIFT
        return own

    def tokens(self, text: str) -> list[float]:
        known, score = self.known, self.score
        return [known[w] if w in known else score(w) for w in TOKEN.findall(text.lower())]

    def segments(self, scores: list[float]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first token, end, score), in time linear in the text.

        Each candidate keeps the running sum before and after it; a new one is joined with
        earlier ones as long as that raises its score."""
        out: list[list[float]] = []  # start, end, sum before, sum after
        back: list[int] = []  # for each, the last earlier one with a smaller sum before
        total = 0.0
        for i, x in enumerate(scores):
            if x <= 0:
                total += x
                continue
            seg = [i, i + 1, total, total + x]
            total += x
            while True:
                j = len(out) - 1
                while j >= 0 and out[j][2] >= seg[2]:
                    j = back[j]
                if j < 0 or out[j][3] >= seg[3]:
                    break
                seg = [out[j][0], seg[1], out[j][2], seg[3]]
                del out[j:], back[j:]
            out.append(seg)
            back.append(j)
        return [(int(a), int(b), y - x) for a, b, x, y in out]

    def chance(self, score: float, n: int) -> float:
        """How many segments of this score a clean text of n tokens is expected to have."""
        return self.model.k * max(n, 1) * math.exp(-min(700.0, self.model.lam * score))

    def passages(self, text: str) -> tuple[list[tuple[int, int, float, float]], float]:
        """Significant segments (start, end, score, chance) and the text's statistic."""
        scores = self.tokens(text)
        n = len(scores)
        found = self.segments(scores) if max(scores, default=0) > 0 else []
        sure = [(a, b, s, e) for a, b, s in found if (e := self.chance(s, n)) <= SIGNIFICANT]
        best = max((s for *_, s in found), default=0.0)
        total = max(best, sum(s for _, _, s, _ in sure))
        return sure, self.model.lam * total - math.log(self.model.k * max(n, 1) + 1e-9)


def _decay(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of mean(exp(lam * score)) = 1 over background tokens, whose scores occur ``counts`` times."""
    if not counts.sum() or values.max() <= 0 or (values * counts).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    mean = lambda lam: float((counts * np.exp(np.minimum(700, lam * values))).sum() / counts.sum())
    while mean(high) < 1 and high < 100:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return max(high, 1e-3)


def sample_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """_t, toxic, fold of the sample's texts, read once and written; fold 0 is calibrated on, the others are counted.

    The sample is bounded, so its ids are broadcast; documents are not shuffled."""
    ids = rows.select(F.col("doc_id").cast("long").alias("_id"), "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), whole_text().alias("_t")).join(F.broadcast(ids), "_id")
    fold = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    return stage_table(texts.select("_t", (F.col("toxic") > 0).cast("int").alias("toxic"), fold.alias("fold")), "toxicity-sample")


def log_odds(counted: DataFrame) -> tuple[dict[str, float], int, int]:
    """Scores of the features that pass the z-test, and how many texts are toxic and not."""
    n1, n0 = counted.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not n1 or not n0:
        return {}, n1, n0
    seen = counted.select("toxic", F.explode(features(F.col("_t"))).alias("f"))
    counts = seen.groupBy("f").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
    a = PRIOR * (F.col("c1") + F.col("c0")) / (n1 + n0)
    y1, y0 = F.col("c1") + a + 0.01, F.col("c0") + a + 0.01
    odds = F.log(y1 / (n1 + PRIOR - y1 + 0.02)) - F.log(y0 / (n0 + PRIOR - y0 + 0.02))
    kept = counts.filter("c1 >= 3").select("f", odds.alias("odds"), F.sqrt(1 / y1 + 1 / y0).alias("sd"))
    # the sample bounds the number of features that pass
    found = {r["f"]: float(r["odds"]) for r in kept.filter(F.col("odds") >= Z * F.col("sd")).select("f", "odds").collect()}
    return found, n1, n0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts on Spark, over the sample's texts; the chance of segments and the probability on a fold that is not counted.

    Where a part of the sample lacks a label, all of it is counted and calibrated on."""
    texts = sample_texts(docs, training_rows(docs, labels, sample))
    found, n1, n0 = log_odds(texts.filter("fold > 0"))
    tested = texts.filter("fold = 0")
    if not n1 or not n0 or tested.select("toxic").distinct().count() < 2:
        found, n1, n0 = log_odds(texts)
        tested = texts
    if not n1 or not n0:
        return Model(prior=1.0 if n1 else 0.0, middle=-1e9 if n1 else 1e9)
    model = Model(found, prior=n1 / (n1 + n0))

    def clean_figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scanner(model)
        for b in batches:
            texts = [scan.tokens(t) for t in b["_t"]]
            best = [max((x for *_, x in scan.segments(s)), default=0.0) for s in texts]
            high = Counter(round(x, 9) for s in texts for x in s if x > -DRIFT)  # the others are all -DRIFT
            yield pd.DataFrame({"n": [len(s) for s in texts], "best": best, "high": [high if k == 0 else {} for k in range(len(texts))]})

    # a row for each clean text of the bounded sample; the scores' counts are bounded by the features
    clean = tested.filter("toxic = 0").select("_t").mapInPandas(clean_figures, "n long, best double, high map<double,long>").toPandas()
    clean = clean[clean.n > 0] if len(clean) else clean
    high = Counter()
    for c in clean.high if len(clean) else ():
        high.update(dict(c))
    rest = int(clean.n.sum()) - sum(high.values()) if len(clean) else 0
    model.lam = _decay(np.array([*high, -DRIFT]), np.array([*high.values(), rest])) if rest else 1.0
    # K by the mean of the largest scores: mean = (log(K n) + 0.5772) / lam
    model.k = float(np.clip(np.exp(np.mean(model.lam * clean.best - 0.5772 - np.log(clean.n))), 1e-9, 1.0)) if len(clean) else 0.1

    def statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scanner(model)
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "stat": [scan.passages(t)[1] for t in b["_t"]]})

    # the statistic that texts are scored by, now that lambda and K are known
    seen = tested.select("_t", "toxic").mapInPandas(statistics, "toxic int, stat double").toPandas()
    model.middle, model.slope = _calibrate(seen.stat.to_numpy(), seen.toxic.to_numpy())
    return model


def _calibrate(stat: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Middle and slope of the logistic curve with least loss on the sample."""
    best = (math.inf, 0.0, 1.0)
    for middle in np.quantile(stat, np.linspace(0.01, 0.999, 200)):
        for slope in (0.25, 0.5, 1.0, 2.0, 4.0):
            z = np.clip(slope * (stat - middle), -50, 50)
            loss = float(np.mean(np.log1p(np.exp(np.where(y > 0, -z, z)))))
            best = min(best, (loss, float(middle), slope))
    return best[1], best[2]


def scored(docs: DataFrame, model: Model, with_passages: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages (and passages) of every document."""
    schema = "doc_id long, score double, n_passages int" + ", passages array<struct<first:int,end:int,score:double,chance:double>>" * with_passages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scanner(model)
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"].tolist(), b["_t"].tolist(), strict=True):
                sure, stat = scan.passages(t)
                row = [None if pd.isna(d) else int(d), model.probability(stat), len(sure)]
                out.append(row + [[{"first": a, "end": z, "score": s, "chance": e} for a, z, s, e in sure]] * with_passages)
            yield pd.DataFrame(out, columns=["doc_id", "score", "n_passages"] + ["passages"] * with_passages).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("_t")).mapInPandas(run, schema)
    extra = ["n_passages"] + ["passages"] * with_passages
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *extra)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = Scanner(model)
        for texts in batches:
            yield pd.Series([model.probability(scan.passages(t)[1]) < 0.5 for t in texts], dtype=bool)

    return docs.filter(F.pandas_udf(run, "boolean")(whole_text()))

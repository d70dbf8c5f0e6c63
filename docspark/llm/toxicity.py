"""Toxic passages by maximum-scoring segments.

The features of a word are itself and its beginnings, so that words never seen score by the stem they share with others. A feature has
the log-odds of the training documents that hold it, toxic against clean, under a Dirichlet prior of the pooled counts, and counts
where they stand clear of their deviation; a text that several training rows share is one document. A word scores as its best feature,
and a word without any loses a drift, so that clean text loses on average. A linear scan finds all maximal scoring segments of a text.
How likely a segment of that score is in clean text of that length follows an extreme-value law, whose decay comes from the scores of
clean words and whose size is fitted on clean documents; a document's evidence is that of its best segment and of all significant ones
together, which a logistic curve turns into a score from 0 to 1.

Features are counted over about ``TRAIN_DOCS`` labelled training rows at most, chosen by hash (all of them, if they are fewer), added
up in each task before counts are shuffled; law and curve are fitted on about ``FIT_DOCS`` of these. These bounds on labelled rows are the
only ones: every feature that is clear in them counts, and every document is scored in full.

Defined cases: a null or empty text has no words and scores as clean; a null doc_id is no training row and not held out; labels that repeat
a doc_id count once, toxic if any says so; without both classes every score is 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import map_rows, materialize, some_rows, utf8

#: Labelled training rows, and those of the calibration, about at most.
TRAIN_DOCS, FIT_DOCS = 200_000, 20_000
#: Ids are broadcast only after they were counted and found to be at most this many.
BROADCAST_IDS = 100_000
#: Deviations that log-odds must stand clear of; least drift a word; chance of a significant segment.
CLEAR, DRIFT, CHANCE = 3.0, 0.08, 0.01
PREDICT = 0.7
#: Code points of the beginnings of words that are features.
STEMS = range(3, 10)
#: Words whose score a worker remembers.
CACHE = 400_000

_PUNCTUATION = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words; ASCII punctuation divides."""
    return text.translate(_PUNCTUATION).lower().split()


def features_of(word: bytes) -> list[str]:
    """A word, marked as whole, and its beginnings."""
    w = word.decode("utf-8", "replace")
    return [w + "$", *(w[:k] for k in STEMS if k <= len(w))]


def segments(places: list[int], scores: list[float], n: int, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of n words: scores at places, minus ``drift`` elsewhere. Linear time.

    Candidates are kept with the running totals before and after them; a new one swallows those that it can only gain from.
    """
    out: list[tuple[int, int, float, float]] = []
    # before[k]: the nearest candidate to the left whose total before it is lower.
    before: list[int] = []
    total, last = 0.0, 0
    for at, s in zip(places, scores, strict=True):
        total -= drift * (at - last)
        start, left = at, total
        total += s
        last = at + 1
        right = total
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = before[j]
            if j < 0 or out[j][3] >= right:
                break
            start, left = out[j][0], out[j][2]
            del out[j:], before[j:]
            j = len(out) - 1
        out.append((start, last, left, right))
        before.append(j)
    return [(a, b, r - x) for a, b, x, r in out]


@dataclass
class Model:
    """Scores of features, drift, extreme-value law (decay, size) and logistic curve."""

    score: dict[str, float]
    drift: float
    decay: float = 1.0
    size: float = 1.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        self.known: dict[bytes, float | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def scores(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(place, score) of the words that have one."""
        known = self.known
        if len(known) >= CACHE:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = max((x for f in features_of(w) if (x := self.score.get(f)) is not None), default=None)
        get = known.get
        return [(k, s) for k, w in enumerate(words) if (s := get(w)) is not None]

    def passages(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal segments of the words with their evidence: minus log10 of how many such segments clean text would hold."""
        found = self.scores(words)
        if not found:
            return []
        known = segments([k for k, _ in found], [s for _, s in found], len(words), self.drift)
        return [(a, b, (self.decay * s - math.log(self.size * len(words))) / math.log(10)) for a, b, s in known]

    def evidence(self, words: list[bytes]) -> tuple[float, float]:
        """Of the best segment, and of all significant ones together."""
        each = [e for _, _, e in self.passages(words)]
        return max(0.0, max(each, default=0.0)), math.log1p(sum(e for e in each if e > -math.log10(CHANCE)))

    def probability(self, evidence: tuple[float, float]) -> float:
        z = self.curve[0] + self.curve[1] * evidence[0] + self.curve[2] * evidence[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labelled rows that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    mine = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 != 1)
    return mine.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, n1, n0: toxic and clean rows (toxic, text) that hold it."""

    def make():
        def step(batch):
            counts = Counter(), Counter()
            for toxic, text in zip(batch["toxic"].to_pylist(), utf8(batch["text"]), strict=True):
                counts[toxic].update({f for w in set(words_of(text)) for f in features_of(w)})
                if len(counts[0]) + len(counts[1]) > 400_000:
                    for k in (0, 1):
                        yield from ((w, n * k, n * (1 - k)) for w, n in counts[k].items())
                        counts[k].clear()
            for k in (0, 1):
                yield from ((w, n * k, n * (1 - k)) for w, n in counts[k].items())

        return step

    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("n1", T.LongType()), T.StructField("n0", T.LongType())])
    return map_rows(rows, make, schema, 20_000).groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    chosen = some_rows(materialize(training_rows(labels), "toxic-rows"), TRAIN_DOCS, "train", "doc_id")
    chosen = materialize(chosen, "toxic-chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    texts = texts.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen, "doc_id")
    # A text that several rows share is one, toxic if any of them says so.
    once = texts.groupBy(F.xxhash64("text").alias("same"), F.length("text").alias("n")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    once = materialize(once, "toxic-texts")
    counts = materialize(feature_counts(once.select("toxic", "text")), "toxic-features")
    n1, n0 = counts.agg(F.sum("n1"), F.sum("n0")).first()
    if not n1 or not n0:
        return None
    # The prior weighs as much as the toxic side itself: a feature's share of it is what chance would put there.
    prior = F.lit(float(n1)) * (F.col("n1") + F.col("n0")) / F.lit(float(n1 + n0))
    a1, a0 = F.col("n1") + prior, F.col("n0") + prior
    odds = F.log(a1 / (F.lit(2.0 * n1) - a1)) - F.log(a0 / (F.lit(float(n0 + n1)) - a0))
    clear = odds / F.sqrt(1 / a1 + 1 / a0)
    table = counts.select("feature", odds.alias("odds"), clear.alias("clear")).where(F.col("clear") >= CLEAR).select("feature", "odds").collect()
    model = Model({r.feature: r.odds for r in table}, DRIFT)

    some = materialize(some_rows(once, FIT_DOCS, "fit", "same", "n"), "toxic-sample")
    clean = some.where("toxic = 0")

    # Drift and decay from the scores of clean words: one row for each score of the table, and one for no score.
    def tally():
        def step(batch):
            found: Counter = Counter()
            for text in utf8(batch["text"]):
                words = words_of(text)
                mine = [s for _, s in model.scores(words)]
                found.update(mine)
                found[0.0] += len(words) - len(mine)
            yield from found.items()

        return step

    pairs = T.StructType([T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    seen = {r.s: r.n for r in map_rows(clean, tally, pairs).groupBy("s").agg(F.sum("n").alias("n")).collect()}
    total = sum(seen.values())
    share = {s: n / total for s, n in seen.items() if s and n}
    model.drift = DRIFT + sum(s * p for s, p in share.items())
    if share:  # the decay solves E exp(decay * score) = 1; without scored words among clean ones any law will do
        low, high = 1e-6, 50.0
        for _ in range(100):
            model.decay = (low + high) / 2
            e = (1 - sum(share.values())) * math.exp(-model.decay * model.drift) + sum(p * math.exp(min(model.decay * s, 500.0)) for s, p in share.items())
            low, high = (model.decay, high) if e < 1 else (low, model.decay)

    # Size of the law: as many segments as clean documents show for their lengths, by maximum likelihood.
    def best():
        def step(batch):
            for d, text in zip(batch["same"].to_pylist(), utf8(batch["text"]), strict=True):
                words = words_of(text)
                yield d, max((e for _, _, e in model.passages(words)), default=None)

        return step

    schema = T.StructType([T.StructField("same", T.LongType()), T.StructField("best", T.DoubleType())])
    scored = [r.best for r in sorted(map_rows(clean, best, schema).collect()) if r.best is not None]
    if scored:
        model.size = max(1e-9, len(scored) / sum(10.0**-e for e in scored))

    def evidence():
        def step(batch):
            for d, toxic, text in zip(batch["same"].to_pylist(), batch["toxic"].to_pylist(), utf8(batch["text"]), strict=True):
                yield d, toxic, list(model.evidence(words_of(text)))

        return step

    schema = T.StructType([T.StructField("same", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = sorted(map_rows(some, evidence, schema).collect())
    model.curve = fit_curve(np.array([r.x for r in got]), np.array([float(r.toxic) for r in got]))
    return model


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on two kinds of evidence with a little shrinkage; slopes are not negative."""
    z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(3)
    shrink = np.array([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + np.diag(shrink), z.T @ (y - p) - shrink * w)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and best_passage (words [start, end)) of every row."""
    model = train(docs, labels)

    def make():
        def step(batch):
            for d, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
                if model is None:
                    yield d, 0.0, 0, 0, None
                    continue
                words = words_of(text)
                found = [(e, a, b) for a, b, e in model.passages(words) if e > -math.log10(CHANCE)]
                score = model.probability(model.evidence(words))
                best = max(found, default=None)
                yield d, score, int(score >= PREDICT), len(found), list(best[1:]) if best else None

        return step

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_passages", T.IntegerType()), T.StructField("best_passage", T.ArrayType(T.LongType()))])
    out = map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "n_passages", "best_passage")

"""Quality rules: document statistics, fixed base rules, and gradient-boosted trees that judge what passes them.

Trees are grown here in numpy on about ``TRAIN_DOCS`` labelled documents at most (a bounded sample by hash of doc_id, the only bound; every
document is scored). They are flattened into node arrays, so a batch is scored by a few vector steps. The score may only fall as the
shares of symbols, repeated lines and repeated words rise (monotonic constraints).

Defined cases: a null or empty text has no words and fails the base rules; a row with a null doc_id is judged like any other but never
trains; repeated rows are judged each; with no usable labels, or one class only, the base rules alone decide; an empty table gives an
empty result; other columns are carried by ``keep_good`` and ignored by ``quality_report``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import SPACES, bounded_batches, map_rows, materialize, some_rows, utf8

TRAIN_DOCS = 20_000
TREES, DEPTH, RATE, BINS, MIN_LEAF, L2 = 60, 3, 0.2, 48, 5, 1.0
#: Documents under this score are rejected; low, so that only clear junk goes.
THRESHOLD = 0.4
#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "words_a_line")
#: -1: the score may only fall as the feature rises; 0: free.
MONOTONE = (0, 0, -1, -1, -1, 0, 0)

_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The five base statistics of a UTF-8 text, and the features of the trees."""
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(bytes([c])) for c in SPACES)
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen: set = set()
        twice = {w for w in windows if w in seen or seen.add(w)} if len(set(windows)) < len(windows) else ()
        if twice:
            at = np.fromiter((w in twice for w in windows), bool, len(windows))
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(windows)] |= at
            repeat = int(covered.sum())
    m = max(n, 1)
    return [n, chars, symbols, dup, repeat], [np.log1p(n), chars / m, symbols / m, dup / max(len(lines), 1), repeat / m, len(set(words)) / m, n / max(len(lines), 1)]


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words


@dataclass
class Trees:
    """Flattened trees: one row of nodes a tree. A leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for rows of features."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for k in range(len(self.feature)):
            at = np.zeros(len(x), np.int32)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[k][at]] <= self.cut[k][at], self.left[k][at], self.right[k][at])
            total += self.value[k][at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = MONOTONE) -> Trees | None:
    """Boosted trees on the logistic loss with histogram splits; None without two classes."""
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    raw, size = np.full(len(y), start), 2 ** (DEPTH + 1) - 1
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        nodes = [np.zeros(size, int), np.full(size, np.inf), np.arange(size), np.arange(size), np.zeros(size)]
        step = np.zeros(len(y))
        todo = [(0, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            k, rows, depth, lo, hi = todo.pop()
            weight = lambda g, h, lo=lo, hi=hi: float(np.clip(g / (h + L2), lo, hi))
            g, h = grad[rows].sum(), hess[rows].sum()
            best = None
            for j in range(x.shape[1]) if depth < DEPTH and len(rows) >= 2 * MIN_LEAF else ():
                n_bins = len(cuts[j]) + 1
                gs, hs, ns = (np.cumsum(np.bincount(binned[rows, j], w, n_bins))[:-1] for w in (grad[rows], hess[rows], None))
                wl, wr = np.clip(gs / (hs + L2), lo, hi), np.clip((g - gs) / (h - hs + L2), lo, hi)
                gain = gs * wl - (hs + L2) * wl**2 / 2 + (g - gs) * wr - (h - hs + L2) * wr**2 / 2
                fine = (ns >= MIN_LEAF) & (len(rows) - ns >= MIN_LEAF) & (monotone[j] * (wr - wl) >= 0)
                if fine.any():
                    b = int(np.argmax(np.where(fine, gain, -np.inf)))
                    if best is None or gain[b] > best[0]:
                        best = (gain[b], j, b, wl[b], wr[b])
            w = weight(g, h)
            if best is None or best[0] <= g * w - (h + L2) * w**2 / 2 + 1e-6:
                nodes[4][k] = RATE * w
                step[rows] = RATE * w
                continue
            _, j, b, wl, wr = best
            nodes[0][k], nodes[1][k], nodes[2][k], nodes[3][k] = j, cuts[j][b], 2 * k + 1, 2 * k + 2
            middle, low = (wl + wr) / 2, binned[rows, j] <= b
            left, right = (lo, hi), (lo, hi)
            if monotone[j]:  # keeps everything below on its side of the middle
                left, right = ((middle, hi), (lo, middle)) if monotone[j] < 0 else ((lo, middle), (middle, hi))
            todo += [(2 * k + 1, rows[low], depth + 1, *left), (2 * k + 2, rows[~low], depth + 1, *right)]
        raw += step
        trees.append(nodes)
    return Trees(*(np.stack([t[i] for t in trees]) for i in range(5)), start)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Trees | None:
    """Trees from about ``most`` labelled documents at most, by hash of doc_id; a doc_id that rows repeat counts once."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    few = some_rows(materialize(known, "quality-labels"), most, "quality", "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")

    def make():
        def step(batch):
            for d, q, text in zip(batch["doc_id"].to_pylist(), batch["quality"].to_pylist(), utf8(batch["text"]), strict=True):
                yield d, float(q), [float(v) for v in statistics(text)[1]]

        return step

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = sorted(map_rows(rows, make, schema).groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect())
    if not got:
        return None
    return fit(np.array([r.x for r in got]), np.array([float(r.y > 0) for r in got]))


def _verdicts(texts: list[bytes], trees: Trees | None) -> list[tuple]:
    found = [statistics(t) for t in texts]
    scores = trees.score(np.array([f for _, f in found])) if trees is not None and found else np.ones(len(found))
    out = []
    for (base, _), s in zip(found, scores, strict=True):
        failed = base_failed(base[0], base[4])
        out.append((*base, failed, not failed and bool(s >= THRESHOLD), float(s)))
    return out


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five statistics, base_failed, kept and the trees' score of every row."""
    trees = train(docs, labels)

    def make():
        def step(batch):
            yield from ((d, *v) for d, v in zip(batch["doc_id"].to_pylist(), _verdicts(list(utf8(batch["text"])), trees), strict=True))

        return step

    long = [T.StructField(n, T.LongType()) for n in ["doc_id", *_BASE]]
    schema = T.StructType([*long, T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, all columns kept."""
    trees = train(docs, labels)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def kept(text):
        import pandas as pd

        return pd.Series([v[6] for v in _verdicts([(t or "").encode() for t in text], trees)], dtype=bool)

    return docs.where(kept("text"))

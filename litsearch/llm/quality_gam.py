"""Quality by a generalised additive model with pairwise interactions.

Features of a text are cut into bins at quantiles of the training sample. The
model is a look-up table per feature plus one per chosen pair of features:

1. Cyclic boosting: round after round, each feature in turn gets a shallow
   tree over its own bins, fitted to the current residuals (logistic loss,
   Newton steps), and the tree's leaves are added to the feature's table.
2. Pairs are ranked by how much a split of both features would still gain on
   the residuals; the best ones are boosted the same way over their own grid.

Scoring adds up table entries, for a whole batch of texts at once. It is fitted
on a bounded sample of labelled rows: ``SAMPLE_DOCS`` of each class, by a hash
of the id; weights restore the classes' true shares, so scores are probabilities.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import hash_sample, narrow

FEATURES = ("log_chars", "log_words", "word_length", "symbols", "pipes", "upper", "digits", "stops", "exclaims",
            "distinct_words", "repeated_pairs", "repeated_lines", "line_length", "top_word", "other_ascii",
            "not_ascii", "wordless")
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAST = 32, 12, 40, 25, 6, 0.15, 3.0
SAMPLE_DOCS, THRESHOLD = 6000, 0.3

_KINDS = np.zeros(256, np.int64)  # 1 white space, 2 lower, 3 upper, 4 digit, 5 .,;:?, 6 !, 7 |, 8 #*$%&<>, 9 other ASCII
_KINDS[:128] = 9
for _k, _chars in ((1, b" \t\n\x0b\x0c\r"), (2, bytes(range(97, 123))), (3, bytes(range(65, 91))),
                   (4, b"0123456789"), (5, b".,;:?"), (6, b"!"), (7, b"|"), (8, b"#*$%&<>")):
    _KINDS[list(_chars)] = _k


def features(text: str) -> list[float]:
    """The features of a whole text; shares of an empty text are 0."""
    data = text.encode()
    kinds = np.bincount(_KINDS, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=10)
    words = data.split()
    n, chars = len(words), len(data) - kinds[1]
    lines = [x for x in data.split(b"\n") if x.strip()]
    count = Counter(words)
    per = lambda x, y: float(x) / float(y) if y else 0.0
    return [float(np.log1p(len(data))), float(np.log1p(n)), per(chars, n), per(kinds[8], chars), per(kinds[7], chars),
            per(kinds[3], kinds[2] + kinds[3]), per(kinds[4], chars), per(kinds[5], n), per(kinds[6], n),
            per(len(count), n), per(n - 1 - len(set(zip(words, words[1:]))), n - 1) if n > 1 else 0.0,
            per(len(lines) - len(set(lines)), len(lines)), per(n, len(lines)),
            per(max(count.values(), default=0), n), per(kinds[9], chars), per(kinds[0], len(data)),
            per(sum(c for w, c in count.items() if w.isascii() and not any(97 <= b | 32 <= 122 for b in w)), n)]


@dataclass
class AdditiveModel:
    cuts: list[np.ndarray]  # per feature: bin k holds values from cuts[k-1] up to below cuts[k]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            out += table[np.searchsorted(self.cuts[k], x[:, k], side="right")]
        for a, b, table in self.pairs:
            out += table[np.searchsorted(self.pair_cuts[a], x[:, a], side="right"),
                         np.searchsorted(self.pair_cuts[b], x[:, b], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -40, 40)))


def quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + 1.0)


def best_cut(g: np.ndarray, h: np.ndarray, axis: int) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram along an axis (sums over the others)."""
    other = tuple(k for k in range(g.ndim) if k != axis)
    gl, hl = np.cumsum(g.sum(axis=other))[:-1], np.cumsum(h.sum(axis=other))[:-1]
    if not len(gl):
        return 0.0, 0
    total_g, total_h = g.sum(), h.sum()
    gain = _gain(gl, hl) + _gain(total_g - gl, total_h - hl) - _gain(total_g, total_h)
    gain[(hl < LEAST / 10) | (total_h - hl < LEAST / 10)] = 0.0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> tuple[np.ndarray, float]:
    """Leaf values over a histogram of gradients, cut ``depth`` times, and the total gain."""
    cuts = [(*best_cut(g, h, axis), axis) for axis in range(g.ndim)] if depth else []
    gain, at, axis = max(cuts, default=(0.0, 0, 0))
    if gain <= 1e-9:
        return np.full(g.shape, g.sum() / (h.sum() + 1.0)), 0.0
    parts = [np.split(v, [at], axis) for v in (g, h)]
    done = [shallow_tree(a, b, depth - 1) for a, b in zip(*parts)]
    return np.concatenate([d[0] for d in done], axis), gain + sum(d[1] for d in done)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pairs: int = PAIRS) -> AdditiveModel:
    n, width = x.shape
    model = AdditiveModel([quantile_cuts(x[:, k], BINS) for k in range(width)] if n else [])
    if not n or y.min() == y.max():
        model.base = 4.0 if n and y.min() else -4.0 if n else 0.0
        return model
    share = float((y * weight).sum() / weight.sum())
    model.base = float(np.log(share / (1 - share)))
    bins = [np.searchsorted(model.cuts[k], x[:, k], side="right") for k in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    logit = np.full(n, model.base)

    def slopes():
        p = 1.0 / (1.0 + np.exp(-logit))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(width):
            g, h = slopes()
            size = len(model.tables[k])
            leaf, _ = shallow_tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size))
            model.tables[k] += RATE * leaf
            logit += RATE * leaf[bins[k]]
    model.pair_cuts = [quantile_cuts(x[:, k], PAIR_BINS) for k in range(width)]
    coarse = [np.searchsorted(model.pair_cuts[k], x[:, k], side="right") for k in range(width)]

    def grid(a: int, b: int, g, h):
        shape = len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1
        cell = coarse[a] * shape[1] + coarse[b]
        return [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]

    g, h = slopes()
    ranked = sorted(((shallow_tree(*grid(a, b, g, h))[1], a, b) for a, b in itertools.combinations(range(width), 2)),
                    key=lambda r: (-r[0], r[1:]))
    chosen = [(a, b, np.zeros((len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)))
              for gain, a, b in ranked[:pairs] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in chosen:
            leaf, _ = shallow_tree(*grid(a, b, *slopes()), depth=3)
            table += RATE * leaf
            logit += RATE * leaf[coarse[a], coarse[b]]
    model.pairs = chosen
    return model


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, sample_docs: int = SAMPLE_DOCS) -> AdditiveModel:
    """Fit on a bounded sample of ``docs`` with a ``quality`` label where ``learn_from`` (on doc_id) holds."""
    marked = (labels.where(learn_from & F.col("quality").isNotNull())
              .select("doc_id", (F.col("quality") > 0).cast("int").alias("good")))
    sizes = {r.good: r.n for r in marked.groupBy("good").agg(F.count("*").alias("n")).collect()}
    sample = hash_sample(marked, sample_docs, ["good"])

    def measured(batches):
        for b in batches:
            yield pd.DataFrame({"good": b["good"], "x": [features(t) for t in b["text"]]})

    rows = (narrow(docs).join(F.broadcast(sample), "doc_id").select("good", "text")
            .mapInPandas(measured, "good int, x array<double>").collect())
    rows = sorted((r.good, list(r.x)) for r in rows)
    y = np.array([r[0] for r in rows], float)
    x = np.array([r[1] for r in rows], float).reshape(len(rows), len(FEATURES))
    found = Counter(r[0] for r in rows)
    scale = {k: sizes[k] / found[k] for k in found}
    top = max(scale.values(), default=1.0)
    return train(x, y, np.array([scale[r[0]] / top for r in rows]))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row.

    Null and empty texts have all features 0 and are scored like any other;
    repeated rows get equal scores. Without any labelled row every score is 0.5.
    """

    @F.pandas_udf("score double, predicted int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            p = model.scores(x)
            yield pd.DataFrame({"score": p, "predicted": (p >= threshold).astype(np.int32)})

    return narrow(docs).select("doc_id", run("text").alias("_s")).select("doc_id", "_s.*")

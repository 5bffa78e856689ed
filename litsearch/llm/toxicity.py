"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read as words (ASCII letters lowered, other ASCII punctuation and
white space as separators). A word's input is a learned vector of the word
(words in fewer than ``LEAST_TEXTS`` training texts share one, so that no text
is learned by its rare words) plus the mean of learned vectors of its
character 3- and 5-grams, so that unseen spellings resemble known ones. The network reads windows of ``WINDOW`` words
that overlap by ``OVERLAP``; attention pools a window's states into one score.
A text's score is that of its most toxic window, over all windows of the whole
text. It is trained in numpy on whole labelled texts, where the gradient goes
to each text's most toxic window.

The training sample is bounded: ``SAMPLE_DOCS`` texts of each class, chosen by
a hash of the id, none longer than ``SAMPLE_CHARS`` characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import hash_sample, narrow
from litsearch.llm.gru import Adam, backward, forward, scatter_rows, sigmoid

WINDOW, OVERLAP = 48, 12
DIM, HIDDEN, ATTENTION = 10, 8, 8
GRAMS, GRAM_ROWS, LEAST_TEXTS, DECAY = (3, 5), 1 << 14, 4, 1e-4
SHRINK, WARM = 6.0, 0.5
BATCH, STEPS, RATE, SEED = 40, 400, 0.02, 23
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 60_000
WORDS_REMEMBERED = 300_000
THRESHOLD = 0.3

_SEPARATED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32
                   for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_SEPARATED).split()


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character n-grams of all words, and the number of the word each belongs to."""
    data = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    rows, owners = [], []
    for n in GRAMS:
        key = np.full(max(len(data) - n + 1, 0), n, np.uint64)
        for k in range(n):
            key = key * np.uint64(257) + data[k:k + len(key)]
        inside = owner[:len(key)] == owner[n - 1:]  # but those that reach into the next word
        rows.append((key[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % GRAM_ROWS)
        owners.append(owner[:len(key)][inside])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(rows)[order], np.concatenate(owners)[order]


def windows_of(n: int) -> np.ndarray:
    """First word of each window over ``n`` words: all of them overlap, together they cover the text."""
    stride = WINDOW - OVERLAP
    return np.arange(0, max(n - WINDOW, 0) + stride, stride)


def laid_out(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Windows of a coded text (windows, WINDOW); -1 beyond its end."""
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < len(codes), codes[np.minimum(at, len(codes) - 1)], -1)


@dataclass
class WindowNetwork:
    vocabulary: dict[bytes, int]  # row of each frequent word, from 1; row 0 is for all others
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(words: list[bytes], seed: int = SEED) -> WindowNetwork:
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        w = {"words": normal(0.05, len(words) + 1, DIM),
             "grams": normal(0.1, GRAM_ROWS, DIM)}
        for d in "fb":
            w["in_" + d], w["start_" + d] = normal(0.4, DIM, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
            w["u_" + d] = normal(1 / np.sqrt(HIDDEN), HIDDEN, 3 * HIDDEN)
        w["look"], w["pick"] = normal(0.4, 2 * HIDDEN, ATTENTION), normal(0.4, ATTENTION)
        w["out"], w["bias"] = normal(0.4, 2 * HIDDEN), np.full(1, -1, np.float32)
        return WindowNetwork({x: k for k, x in enumerate(words, 1)}, w)

    def word_vectors(self, words: list[bytes]):
        rows = np.array([self.vocabulary.get(x, 0) for x in words], np.int64)
        grams, owner = grams_of(words)
        count = np.bincount(owner, minlength=len(words))[:, None].astype(np.float32)  # none is 0: "<x>" is a gram
        first = np.searchsorted(owner, np.arange(len(words)))
        w = self.weights
        return w["words"][rows] + np.add.reduceat(w["grams"][grams], first, axis=0) / count, (rows, grams, owner, count)

    def gate_table(self, x: np.ndarray) -> np.ndarray:
        """Gate pre-activations of both directions per word, and a last row for what is beyond the end."""
        w = self.weights
        table = np.concatenate([x @ w["in_f"] + w["start_f"], x @ w["in_b"] + w["start_b"]], axis=1)
        return np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])

    def run(self, table: np.ndarray, windows: np.ndarray):
        """Logit per window; ``windows`` holds rows of ``table``, -1 beyond a text's end."""
        w, at = self.weights, windows.T
        mask = (at >= 0).astype(table.dtype)[:, :, None]
        gates = table[at]
        hf, mf = forward(gates[:, :, :3 * HIDDEN], mask, w["u_f"], False)
        hb, mb = forward(gates[:, :, 3 * HIDDEN:], mask, w["u_b"], True)
        h = np.concatenate([hf, hb], axis=2)
        seen = np.tanh(h @ w["look"])
        weight = np.where(mask[:, :, 0] > 0, seen @ w["pick"], -np.inf)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * h).sum(axis=0)
        return pooled @ w["out"] + w["bias"][0], (mask, mf, mb, h, seen, weight, pooled)

    def gradients(self, words: list[bytes], windows: np.ndarray, label: np.ndarray):
        """Mean log loss of windows with a label each, and its gradients; ``windows`` index ``words``."""
        w = self.weights
        x, (rows, grams, owner, count) = self.word_vectors(words)
        table = self.gate_table(x)
        logit, (mask, mf, mb, h, seen, weight, pooled) = self.run(table, windows)
        p = sigmoid(logit)
        loss = float(-(label * np.log(p + 1e-9) + (1 - label) * np.log(1 - p + 1e-9)).mean())
        d = ((p - label) / len(label)).astype(table.dtype)
        g = {"bias": d.sum(keepdims=True), "out": pooled.T @ d}
        d_pooled = d[:, None] * w["out"]
        d_weight = (h * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["pick"] = np.einsum("tba,tb->a", seen, d_score)
        d_seen = d_score[:, :, None] * w["pick"] * (1 - seen * seen)
        g["look"] = np.einsum("tbh,tba->ha", h, d_seen)
        d_h = weight[:, :, None] * d_pooled + d_seen @ w["look"].T
        d_gf, g["u_f"] = backward(np.ascontiguousarray(d_h[:, :, :HIDDEN]), mf, mask, w["u_f"], False)
        d_gb, g["u_b"] = backward(np.ascontiguousarray(d_h[:, :, HIDDEN:]), mb, mask, w["u_b"], True)
        at, real = windows.T.reshape(-1), windows.T.reshape(-1) >= 0
        per_word = scatter_rows(at[real], np.concatenate([d_gf, d_gb], axis=2).reshape(len(at), -1)[real], len(words))
        d_f, d_b = per_word[:, :3 * HIDDEN], per_word[:, 3 * HIDDEN:]
        g["in_f"], g["start_f"] = x.T @ d_f, d_f.sum(axis=0)
        g["in_b"], g["start_b"] = x.T @ d_b, d_b.sum(axis=0)
        d_x = d_f @ w["in_f"].T + d_b @ w["in_b"].T
        g["words"] = scatter_rows(rows, d_x, len(w["words"])) + DECAY * w["words"]
        g["grams"] = scatter_rows(grams, (d_x / count)[owner], GRAM_ROWS) + DECAY * w["grams"]
        return loss, g


def train(texts: list[list[bytes]], labels: list[int], steps: int = STEPS, seed: int = SEED) -> WindowNetwork:
    """Fit on whole texts: in a batch, both classes are equally frequent and each text's top window counts."""
    seen = [Counter(w for t, y in zip(texts, labels) if y == k for w in set(t)) for k in (0, 1)]
    frequent = sorted(w for w in seen[0].keys() | seen[1].keys() if seen[0][w] + seen[1][w] >= LEAST_TEXTS)
    net = WindowNetwork.fresh(frequent, seed)
    # warm start: the first component is the word's shrunk log odds between the classes
    share = [len([1 for t, y in zip(texts, labels) if t and y == k]) + 1 for k in (0, 1)]
    odds = np.zeros(len(frequent) + 1, np.float32)
    for k, w in enumerate(frequent, 1):
        a, b = seen[1][w], seen[0][w]
        odds[k] = (np.log((a + 0.5) / share[1]) - np.log((b + 0.5) / share[0])) * (a + b) / (a + b + SHRINK)
    net.weights["words"][:, 0] = odds / max(1.0, float(np.abs(odds).max()))
    rng = np.random.default_rng(seed)
    classes = [[i for i, (t, y) in enumerate(zip(texts, labels)) if t and y == k] for k in (0, 1)]
    optimiser = Adam(net.weights, RATE)
    for step in range(steps if all(classes) else 0):
        chosen = [int(i) for c in classes for i in rng.choice(c, BATCH // 2)]
        vocabulary = sorted({w for i in chosen for w in texts[i]})
        number = {w: k for k, w in enumerate(vocabulary)}
        table = net.gate_table(net.word_vectors(vocabulary)[0])
        parts = [laid_out(np.array([number[w] for w in texts[i]]), windows_of(len(texts[i]))) for i in chosen]
        if step >= WARM * steps:
            logit, _ = net.run(table, np.concatenate(parts))
        ends = np.cumsum([len(p) for p in parts])
        if step < WARM * steps:  # first, the window with the most telling word
            value = np.array([net.vocabulary.get(w, 0) for w in vocabulary] + [0])
            logit = odds[value][np.concatenate(parts)].max(axis=1)
        top = np.stack([p[int(v.argmax())] for p, v in zip(parts, np.split(logit, ends[:-1]))])
        used, top = np.unique(top, return_inverse=True)
        top = top.reshape(len(chosen), WINDOW) - int(used[0] < 0)
        label = np.array([labels[i] for i in chosen], np.float32)
        _, g = net.gradients([vocabulary[k] for k in used if k >= 0], top, label)
        optimiser.step(g, RATE * (1 - 0.9 * step / steps))
    return net


class Scorer:
    """Scores texts and remembers what a word's gates are."""

    def __init__(self, net: WindowNetwork):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.table = self.net.gate_table(np.zeros((0, DIM), np.float32))

    def learn(self, words: set[bytes]) -> None:
        if len(self.code) > WORDS_REMEMBERED:
            self.forget()
        new = [w for w in words if w not in self.code]
        if new:
            for w in new:
                self.code[w] = len(self.code)
            self.table = np.concatenate([self.table[:-1], self.net.gate_table(self.net.word_vectors(new)[0])])

    def window_scores(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Per text the logits of all its windows; texts without words have none."""
        self.learn(set().union(*texts))
        code = self.code
        parts = [laid_out(np.array([code[w] for w in t]), windows_of(len(t))) if t
                 else np.zeros((0, WINDOW), np.int64) for t in texts]
        windows = np.concatenate(parts) if parts else np.zeros((0, WINDOW), np.int64)
        logits = [self.net.run(self.table, windows[k:k + 2048])[0] for k in range(0, len(windows), 2048)]
        ends = np.cumsum([len(p) for p in parts])
        return np.split(np.concatenate(logits or [np.zeros(0, np.float32)]), ends[:-1]) if parts else []


def _scored(batches: Iterator[pd.Series], net: WindowNetwork, threshold: float) -> Iterator[pd.DataFrame]:
    scorer = Scorer(net)
    for texts in batches:
        rows, values = [], texts.tolist()
        for k in range(0, len(values), 400):
            for logits in scorer.window_scores([words_of(t) for t in values[k:k + 400]]):
                best = int(logits.argmax()) if len(logits) else -1
                score = float(sigmoid(np.float64(logits[best]))) if len(logits) else 0.0
                rows.append((score, int(score >= threshold), len(logits), best * (WINDOW - OVERLAP) if len(logits) else -1))
        yield pd.DataFrame(rows, columns=["score", "predicted", "n_windows", "top_word"])


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, sample_docs: int = SAMPLE_DOCS) -> WindowNetwork:
    """Train on a bounded sample of ``docs`` with a ``toxic`` label where ``learn_from`` (on doc_id) holds."""
    marked = labels.where(learn_from & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int"))
    sample = hash_sample(marked, sample_docs, ["toxic"])
    rows = (narrow(docs).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(sample), "doc_id")
            .select("toxic", "text").collect())
    rows = sorted((int(r.toxic), r.text) for r in rows)
    return train([words_of(t) for _, t in rows], [int(y > 0) for y, _ in rows])


def score(docs: DataFrame, net: WindowNetwork, threshold: float = THRESHOLD, *columns: str) -> DataFrame:
    """doc_id, score, predicted, n_windows and the first word of the most toxic window, for every row.

    A null or empty text, or one without words, has score 0 and no window (top_word
    -1). Of equal windows the first counts. Repeated rows get equal scores.
    """

    @F.pandas_udf("score double, predicted int, n_windows int, top_word int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _scored(batches, net, threshold)

    return narrow(docs, *columns).select("doc_id", *columns, run("text").alias("_t")).select("doc_id", *columns, "_t.*")


def drop_toxic(docs: DataFrame, net: WindowNetwork, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic."""

    @F.pandas_udf("score double, predicted int, n_windows int, top_word int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _scored(batches, net, threshold)

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select(row, run(text).alias("verdict")).where("verdict.predicted = 0").select("row.*"))

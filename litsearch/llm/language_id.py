"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as UTF-8, with ASCII letters lowered and other ASCII characters
as separators. The network reads each run of the remaining bytes (cut every
``WINDOW`` bytes) in both directions and gives every byte a distribution over
the languages; a document's distribution is the mean over all its bytes.

As a window is all that a label depends on, equal windows get equal labels:
each task remembers the windows it has labelled (bounded), and the network
only runs on new ones. The network is trained in numpy by backpropagation
through time on windows of a bounded sample of labelled documents:
``SAMPLE_DOCS`` per language, chosen by a hash of the id, and up to
``SAMPLE_WINDOWS`` windows from anywhere in each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import hash_sample, narrow
from litsearch.llm.gru import Adam, backward, forward, scatter_rows

HIDDEN, WINDOW, BATCH, STEPS, RATE, SEED = 10, 24, 256, 350, 0.02, 11
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 40
WINDOWS_REMEMBERED = 400_000
UNKNOWN = "und"

_SEPARATED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def windows_of(text: str) -> list[bytes]:
    """The byte runs that the network reads, in order."""
    runs = text.encode().translate(_SEPARATED).split()
    if runs and max(map(len, runs)) > WINDOW:
        return [r[k:k + WINDOW] for r in runs for k in range(0, len(r), WINDOW)]
    return runs


def packed(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (steps, batch) and mask (steps, batch, 1), left-aligned."""
    steps = max(map(len, windows))
    data = np.frombuffer(b"".join(w.ljust(steps, b"\0") for w in windows), np.uint8).reshape(len(windows), steps)
    length = np.array([len(w) for w in windows])
    mask = (np.arange(steps)[:, None] < length).astype(np.float32)
    return np.ascontiguousarray(data.T), mask[:, :, None]


@dataclass
class ByteNetwork:
    languages: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(languages: list[str], seed: int = SEED) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        size, n = HIDDEN, len(languages)
        w = {}
        for d in "fb":
            w["in_" + d] = rng.normal(0, 0.3, (256, 3 * size)).astype(np.float32)
            w["u_" + d] = rng.normal(0, 1 / np.sqrt(size), (size, 3 * size)).astype(np.float32)
            w["out_" + d] = rng.normal(0, 0.3, (size, n)).astype(np.float32)
        w["bias"] = np.zeros(n, np.float32)
        return ByteNetwork(languages, w)

    def run(self, data: np.ndarray, mask: np.ndarray):
        w = self.weights
        hf, mf = forward(w["in_f"][data], mask, w["u_f"], False)
        hb, mb = forward(w["in_b"][data], mask, w["u_b"], True)
        logits = hf @ w["out_f"] + hb @ w["out_b"] + w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        return p, (hf, mf, hb, mb)

    def gradients(self, data, mask, label) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients."""
        w, n = self.weights, float(mask.sum())
        p, (hf, mf, hb, mb) = self.run(data, mask)
        steps, batch, _ = p.shape
        picked = p[:, np.arange(batch), label]
        loss = float(-(np.log(picked + 1e-12) * mask[:, :, 0]).sum() / n)
        d = p.copy()
        d[:, np.arange(batch), label] -= 1
        d *= mask / n
        flat = d.reshape(steps * batch, -1)
        g = {"bias": flat.sum(axis=0)}
        at = data.reshape(-1)
        for k, h, m, rev in (("f", hf, mf, False), ("b", hb, mb, True)):
            g["out_" + k] = h.reshape(steps * batch, -1).T @ flat
            d_gates, g["u_" + k] = backward(d @ w["out_" + k].T, m, mask, w["u_" + k], rev)
            g["in_" + k] = scatter_rows(at, d_gates.reshape(steps * batch, -1), 256)
        return loss, g


def train(windows: list[bytes], labels: list[str], steps: int = STEPS, seed: int = SEED) -> ByteNetwork:
    """Fit on labelled windows; every language weighs alike whatever its share of the sample."""
    languages = sorted(set(labels))
    net = ByteNetwork.fresh(languages, seed)
    rng = np.random.default_rng(seed)
    by_language = [[i for i, x in enumerate(labels) if x == lang] for lang in languages]
    optimiser = Adam(net.weights, RATE)
    for step in range(steps if len(languages) > 1 else 0):
        label = rng.integers(0, len(languages), BATCH)
        chosen = [windows[by_language[k][rng.integers(len(by_language[k]))]] for k in label]
        data, mask = packed(chosen)
        _, g = net.gradients(data, mask, label)
        optimiser.step(g, RATE * (1 - 0.9 * step / steps))
    return net


class Labeller:
    """Labels windows with a network and remembers them."""

    def __init__(self, net: ByteNetwork):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(self.net.languages)), np.float32)  # of the positions' distributions
        self.labels: list[bytes] = []  # per position the most likely language's number

    def learn(self, windows: set[bytes], keep_labels: bool) -> None:
        if len(self.code) > WINDOWS_REMEMBERED:
            self.forget()
        new = sorted((w for w in windows if w not in self.code), key=len)
        parts = [self.sums]
        for k in range(0, len(new), 4096):
            some = new[k:k + 4096]
            data, mask = packed(some)
            p, _ = self.net.run(data, mask)
            parts.append((p * mask).sum(axis=0))
            if keep_labels:
                best = p.argmax(axis=2).astype(np.uint8).T
                self.labels += [best[i, :len(w)].tobytes() for i, w in enumerate(some)]
            for w in some:
                self.code[w] = len(self.code)
        self.sums = np.concatenate(parts)

    def pooled(self, windows: list[bytes]) -> np.ndarray:
        """Mean distribution over all positions of a text."""
        total = self.sums[[self.code[w] for w in windows]].sum(axis=0, dtype=np.float64)
        return total / sum(map(len, windows))


def label_runs(text: str, labeller: Labeller) -> list[tuple[int, int, str]]:
    """Runs of equally labelled bytes (begin, end, language); separators belong to no run."""
    windows = windows_of(text)
    labeller.learn(set(windows), True)
    data, at, out = text.encode().translate(_SEPARATED), 0, []
    for w in windows:
        at = data.index(w, at)
        for k, label in enumerate(labeller.labels[labeller.code[w]]):
            lang = labeller.net.languages[label]
            if out and out[-1][1] == at + k and out[-1][2] == lang:
                out[-1] = (out[-1][0], at + k + 1, lang)
            else:
                out.append((at + k, at + k + 1, lang))
        at += len(w)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _predicted(batches: Iterator[pd.Series], net: ByteNetwork) -> Iterator[pd.DataFrame]:
    labeller = Labeller(net)
    for texts in batches:
        rows, values = [], texts.tolist()
        for k in range(0, len(values), 300):
            part = values[k:k + 300]
            windows = [windows_of(t) if net.languages and has_letter(t) else [] for t in part]
            labeller.learn(set().union(*windows), False)
            for w in windows:
                if w:
                    p = labeller.pooled(w)
                    best = int(p.argmax())
                    rows.append((net.languages[best], float(min(1.0, p[best]))))
                else:
                    rows.append((UNKNOWN, 0.0))
        yield pd.DataFrame(rows, columns=["lang_pred", "score"])


def fit(docs: DataFrame, learn_from: Column, sample_docs: int = SAMPLE_DOCS,
        sample_windows: int = SAMPLE_WINDOWS) -> ByteNetwork:
    """Train on a bounded sample of the rows where ``learn_from`` holds and ``lang`` is not null."""
    known = narrow(docs.where(learn_from & F.col("lang").isNotNull()), "lang")
    sample = hash_sample(known, sample_docs, ["lang"])

    def drawn(batches):
        for b in batches:
            rows = []
            for lang, text in zip(b["lang"], b["text"]):
                windows = windows_of(text)
                rng = np.random.default_rng(zlib.crc32(text.encode()))
                rows += [(lang, windows[i]) for i in rng.integers(0, len(windows), sample_windows)] if windows else []
            yield pd.DataFrame(rows, columns=["lang", "window"])

    rows = sorted(map(tuple, sample.select("lang", "text").mapInPandas(drawn, "lang string, window binary").collect()))
    return train([bytes(w) for _, w in rows], [lang for lang, _ in rows])


def identify(docs: DataFrame, net: ByteNetwork) -> DataFrame:
    """doc_id, lang_pred, score for every row.

    ``und`` with score 0 if the text is null, empty or has no letter (or nothing
    was learned). Repeated rows get equal answers; equal probabilities go to the
    language that sorts first.
    """

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _predicted(batches, net)

    return narrow(docs).select("doc_id", run("text").alias("_l")).select("doc_id", "_l.*")

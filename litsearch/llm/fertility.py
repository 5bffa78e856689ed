"""Quality rules from tokeniser fertility, beside simple count rules.

Two public vocabularies read every word: a piece vocabulary with byte fallback
and a byte-level one for many languages. A text's figures are

- ``chars_per_token`` and ``chars_per_token_bytes``: code points of its words
  per token of either vocabulary (low: the vocabulary does not know such text),
- ``byte_share``: share of piece tokens that are byte fallbacks,
- ``token_entropy``: entropy of the piece tokens in bits, over the logarithm of
  how many tokens there are (at most 600: beyond that a language's entropy
  hardly grows with the text). Repetition and lists of junk lower it.

A text is rejected when a figure leaves the band of its script. The script is
that of most letters in the text. Words repeat, so each task remembers what
the vocabularies said of a word; memory is bounded by ``WORDS_REMEMBERED``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import narrow
from litsearch.llm.piece_codec import MARK, PieceCodec, model_path

WORDS_REMEMBERED = 300_000
LETTER = re.compile("[A-Za-z]")
SYMBOLS = "#*$%&|<>"
ENTROPY_TOKENS = 600
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

# script: (least and most characters per piece token, the same per byte-level token,
#          most byte fallbacks, least relative entropy)
BANDS = {
    "latin": (1.5, 9.0, 1.75, 9.0, 0.12, 0.67),
    "cyrillic": (1.2, 8.0, 1.0, 8.0, 0.20, 0.60),
    "greek": (0.7, 6.0, 0.7, 6.0, 0.40, 0.55),
    "arabic": (0.7, 6.0, 0.6, 6.0, 0.40, 0.50),
    "hebrew": (0.7, 6.0, 0.6, 6.0, 0.40, 0.50),
    "devanagari": (0.5, 6.0, 0.4, 6.0, 0.60, 0.45),
    "hangul": (0.3, 3.0, 0.3, 3.0, 0.95, 0.40),
    "cjk": (0.3, 3.0, 0.3, 3.0, 0.95, 0.40),
    "other": (0.25, 9.0, 0.25, 9.0, 0.99, 0.35),
}
# first and last code point of each script's main blocks
BLOCKS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF),
          ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("latin", 0x1E00, 0x1EFF),
          ("cjk", 0x3040, 0x30FF), ("cjk", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))


def script_of(text: str) -> str:
    """The script that most letters belong to; ``other`` without letters."""
    if text.isascii():
        return "latin" if LETTER.search(text) else "other"
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letters = {}
    for name, low, high in BLOCKS:
        n = int(((points >= low) & (points <= high)).sum())
        if name == "latin" and low == 0x41:  # not letters: between and after the two cases, and signs
            n -= int(((points >= 0x5B) & (points <= 0x60)).sum() + ((points >= 0x7B) & (points <= 0xBF)).sum())
        letters[name] = letters.get(name, 0) + n
    best = max(letters, key=letters.get)
    return best if letters[best] else "other"


class WordFigures:
    """What the two vocabularies make of a word, remembered per task."""

    def __init__(self, piece_path: str, bytes_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        self.codec = PieceCodec(piece_path)
        with open(bytes_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_level = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                            special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.ids: list[bytes] = []
        self.fallbacks: list[int] = []
        self.byte_tokens: list[int] = []

    def learn(self, words: set[bytes]) -> None:
        if len(self.code) > WORDS_REMEMBERED:
            self.forget()
        new = [w for w in words if w not in self.code]
        plain = [w.decode() for w in new]
        byte_ids, encode = self.codec.byte_ids, self.byte_level.encode_ordinary
        for word, text, ids in zip(new, plain, self.codec.units.encode([MARK + w for w in plain], num_threads=1)
                                   if new else []):
            self.code[word] = len(self.ids)
            self.ids.append(np.array(ids, "<u4").tobytes())
            self.fallbacks.append(sum(i in byte_ids for i in ids))
            self.byte_tokens.append(len(encode(" " + text)))


def repeated_words(codes: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more (first occurrences included)."""
    if len(codes) < 4:
        return 0
    if codes.max() < 1 << 21:
        windows = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    else:  # three codes do not fit into 64 bits: number the pairs first
        _, own = np.unique(codes, return_inverse=True)
        _, pairs = np.unique(own[:-1] * (own.max() + 1) + own[1:], return_inverse=True)
        windows = pairs[:-1] * (own.max() + 1) + own[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[which] > 1
    marked = np.zeros(len(codes), bool)
    for k in range(3):
        marked[k:len(codes) - 2 + k] |= twice
    return int(marked.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def figures(text: str, words: list[bytes], known: WordFigures) -> tuple:
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    coded = [known.code[w] for w in words]
    codes = np.array(coded, np.int64)
    repeats = repeated_words(codes)
    tokens = np.frombuffer(b"".join([known.ids[c] for c in coded]), "<u4")
    total = len(tokens)
    share = entropy = per_token = per_byte_token = 0.0
    if total:
        _, count = np.unique(tokens, return_counts=True)
        p = count / total
        entropy = float(-(p * np.log2(p)).sum()) / math.log2(min(total, ENTROPY_TOKENS) + 1)
        share = sum([known.fallbacks[c] for c in coded]) / total
        per_token = chars / total
        per_byte_token = chars / max(1, sum([known.byte_tokens[c] for c in coded]))
    script = script_of(text)
    low, high, low_b, high_b, most_bytes, least_entropy = BANDS[script]
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    inside = (low <= per_token <= high and low_b <= per_byte_token <= high_b and share <= most_bytes
              and entropy >= least_entropy)
    return (n, chars, symbols, duplicate_lines(text), repeats, failed, not failed and inside,
            script, per_token, per_byte_token, share, entropy)


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
           "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "script": "string",
           "chars_per_token": "double", "chars_per_token_bytes": "double", "byte_share": "double",
           "token_entropy": "double"}


def _rows(batches: Iterator[pd.Series], piece_path: str, bytes_path: str) -> Iterator[pd.DataFrame]:
    known = WordFigures(piece_path, bytes_path)
    for texts in batches:
        rows, values = [], texts.tolist()
        for k in range(0, len(values), 200):
            part = values[k:k + 200]
            words = [t.encode().split() for t in part]  # on exactly \x20 and \x09 to \x0D
            known.learn(set().union(*words))
            rows += [figures(t, w, known) for t, w in zip(part, words)]
        yield pd.DataFrame(rows, columns=list(COLUMNS))


def fertility_rules(docs: DataFrame, piece_path: str | None = None, bytes_path: str | None = None) -> DataFrame:
    """doc_id, the count rules' figures, ``base_failed``, ``kept`` and the fertility figures.

    One row per input row (repeated rows too). A null or empty text has no words
    and fails the base rule; figures of a text without tokens are 0.
    """
    piece_path = piece_path or model_path()
    bytes_path = bytes_path or model_path("byte_bpe_multi_50k.tiktoken")

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in COLUMNS.items()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _rows(batches, piece_path, bytes_path)

    return narrow(docs).select("doc_id", run("text").alias("_q")).select("doc_id", "_q.*")

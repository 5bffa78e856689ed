"""Word-shingle sets and the signatures by which similar sets find each other (numpy, per batch of texts).

Two sets link when ``PERCENT`` per cent of their union is in both. With sizes n
and m that is an intersection of at least ``ceil(P (n + m) / (100 + P))``, so at
most ``floor((100 - P) (n + m) / (100 + P))`` elements are in only one of them.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from functools import lru_cache

import numpy as np

WORDS_REMEMBERED = 300_000
SEGMENTS_FROM = 87  # least percentage at which segments take fewer than a quarter key per element
GROWTH = 1.5  # size classes of large sets: each reaches to this multiple of its start
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    x = (x ^ (x >> np.uint64(31))) * _K1
    x = (x ^ (x >> np.uint64(29))) * _K2
    return x ^ (x >> np.uint64(32))


def words_of(text: str) -> list[bytes]:
    """Runs of other than space and \\x09 to \\x0D, with A-Z lowered."""
    return text.encode().translate(_LOWER).split()


class Shingler:
    """Sets of shingle hashes (64 bits, sorted); word hashes are remembered."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > WORDS_REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.array([known[w] for w in words], np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        """The set of a text; with fewer words than a shingle has, the whole sequence is the one element."""
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        h = self.hashes(words)
        width = min(self.words, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = mix(out * _K3 + h[k:k + len(out)])
        return np.unique(out)


def least_overlap(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


@lru_cache(maxsize=100_000)
def overlaps_of(n: int, boundary: int, percent: int) -> tuple[int, ...]:
    """Overlap sizes c by which a set of size n links with another, where the smaller one has at most ``boundary``."""
    out = {least_overlap(n, m, percent) for m in range(math.ceil(percent * n / 100), n * 100 // percent + 1)
           if min(n, m) <= boundary}
    return tuple(sorted(c for c in out if 0 < c <= n))


def subset_count(n: int, boundary: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in overlaps_of(n, boundary, percent))


@lru_cache(maxsize=1000)
def classes(boundary: int, upto: int) -> tuple[int, ...]:
    """Starts of the size classes of large sets."""
    out = [boundary + 1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * GROWTH)))
    return tuple(out)


def segments_of(end: int, percent: int) -> tuple[int, int]:
    """Segments for a class whose sets are smaller than ``end``, and how many of them may be empty.

    A linked pair differs in at most k elements, so of k + 1 + spare segments of
    the universe it has at least 1 + spare with the same elements in both.
    """
    n = end - 1
    k = (100 - percent) * (n + n * 100 // percent) // (100 + percent)
    spare = max(2, k // 20)
    return k + 1 + spare, spare


def subset_keys(u: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    """Keys of a small set: every subset of each size by which it may link."""
    n, out = len(u), []
    total, mixed = np.uint64(0), mix(u + _K3)
    with np.errstate(over="ignore"):
        total = mixed.sum(dtype=np.uint64)
        for c in overlaps_of(n, boundary, percent):
            left_out = np.array(list(itertools.combinations(range(n), n - c)), np.int64).reshape(math.comb(n, c), n - c)
            out.append(mix((total - mixed[left_out].sum(axis=1, dtype=np.uint64)) * _K1 + np.uint64(c)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def segment_keys(u: np.ndarray, number: int, end: int, percent: int) -> np.ndarray:
    """Keys of a large set in class ``number``: one per segment with elements.

    With more empty segments than are spare, also one per choice of spare + 1
    empty ones: two such sets may agree in nothing but empty segments.
    """
    count, spare = segments_of(end, percent)
    segment = ((u >> np.uint64(20)) % np.uint64(count)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    with np.errstate(over="ignore"):
        present, first = np.unique(segment[order], return_index=True)
        sums = np.add.reduceat(mix(u + _K3)[order], first)
        tag = np.uint64(number + 1) << np.uint64(40)
        keys = mix(sums * _K1 + present.astype(np.uint64) + tag)
        empty = np.setdiff1d(np.arange(count), present)
        if len(empty) > spare:
            chosen = np.array(list(itertools.combinations(empty, spare + 1)), np.uint64)
            more = np.full(len(chosen), tag, np.uint64)
            for k in range(spare + 1):
                more = mix(more + chosen[:, k] * _K2 + np.uint64(7))
            keys = np.concatenate([keys, more])
    return keys


def uses_segments(percent: int) -> bool:
    """Whether segments are the lists of large sets: while they take few keys per element.

    Below, single elements are: those of least hash, one more than a set of this
    size may have that its partner lacks. They are fewer, but less telling.
    """
    return percent >= SEGMENTS_FROM


def prefix_keys(u: np.ndarray, percent: int) -> np.ndarray:
    """The least elements (by hash) of a large set, of which linked sets share one."""
    n = len(u)
    return mix(u[:n + percent * n // -100 + 1] + _K2)


def keys_of(u: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    """All keys of a set: linked sets share at least one."""
    n = len(u)
    if not n:
        return np.zeros(0, np.uint64)
    if n <= boundary:
        return subset_keys(u, boundary, percent)
    parts = []
    if not uses_segments(percent):
        parts.append(prefix_keys(u, percent))
        if percent * n <= 100 * boundary:
            parts.append(subset_keys(u, boundary, percent))
        return np.concatenate(parts)
    starts = classes(boundary, n)
    own = next(k for k in range(len(starts) - 1) if n < starts[k + 1])
    parts.append(segment_keys(u, own, starts[own + 1], percent))
    if percent * n <= 100 * (starts[own] - 1):  # it may link with a smaller set of the class before
        parts.append(segment_keys(u, own - 1, starts[own], percent) if own else subset_keys(u, boundary, percent))
    return np.concatenate(parts)


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Linked pairs of sets by scanning inverted lists: (i, j) of left and right, or i < j within left.

    Each set's elements are looked up in the sorted elements of the other side;
    the hits are counted per partner, so no pair without a common element is touched.
    """
    same = right is None
    right = left if same else right
    if not left or not right:
        return []
    sizes = np.array([len(r) for r in right])
    owner = np.repeat(np.arange(len(right)), sizes)
    pool = np.concatenate(right)
    order = np.argsort(pool, kind="stable")
    pool, owner = pool[order], owner[order]
    out = []
    for i, u in enumerate(left):
        if not len(u):
            continue
        low, high = np.searchsorted(pool, u, "left"), np.searchsorted(pool, u, "right")
        width = high - low
        total = int(width.sum())
        if not total:
            continue
        at = np.repeat(high - np.cumsum(width), width) + np.arange(total)
        both = np.bincount(owner[at], minlength=len(right))
        good = (both > 0) & (100 * both >= percent * (len(u) + sizes - both))
        out += [(i, int(j)) for j in np.flatnonzero(good) if not same or j > i]
    return out

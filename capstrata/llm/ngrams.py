"""Hashed character and word n-grams of many texts at once, in numpy, and logistic regression on them.

Texts are laid end to end as code points with zeros between them, in chunks of bounded size, so that the work for
each text is a slice of a few long arrays. A feature is the share of a text's n-grams of one order that fall in a
bucket, so the score of a linear model is a mean of gathered weights, and no vector of a text is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Zeros between two texts; longer than any character n-gram, so that none spans two texts.
PAD = 5
#: Code points that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 19
_P, _Q, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def chunks(texts: Sequence[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` code points together."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t) + PAD
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Layout:
    """Texts end to end: code points, and where each text starts and ends."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[str]) -> Layout:
        joined = ("\0" * PAD).join(texts) + "\0" * PAD
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(lengths + PAD)[:-1]]).astype(np.int64)
        return cls(points, starts, starts + lengths)

    def sums(self, values: np.ndarray, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Sums of values over each text; values has one entry for each code point (or for each of own ranges)."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
        return total[self.ends if ends is None else ends] - total[self.starts if starts is None else starts]


@dataclass
class Words:
    """Words of a layout: a hash for each, the text that holds it, and the range of words of each text."""

    hashes: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def spaces(points: np.ndarray) -> np.ndarray:
    """Blank, the five control characters from tab to carriage return, and the zeros between texts."""
    return (points == 32) | ((points >= 9) & (points <= 13))


def words(layout: Layout) -> Words:
    points = layout.points
    step = np.zeros(len(points) + 2, np.int32)
    np.add.at(step, layout.starts, 1)
    np.add.at(step, layout.ends, -1)
    inside = np.zeros(len(points) + 1, np.int8)
    inside[:-1] = ~spaces(points) & (np.cumsum(step)[: len(points)] > 0)
    edges = np.diff(np.concatenate([[0], inside]))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), _P, np.uint64)]))
        total = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), _P_INVERSE, np.uint64)]))
        hashes = (total[end] - total[begin]) * back[begin]
        hashes ^= hashes >> np.uint64(29)
        hashes *= _MIX
    starts = np.searchsorted(begin, layout.starts)
    ends = np.searchsorted(begin, layout.ends)
    return Words(hashes, np.repeat(np.arange(len(layout.starts)), ends - starts), starts, ends)


def char_buckets(points: np.ndarray, orders: Sequence[int], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each order the bucket of the n-gram that begins at each code point."""
    code = points.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        h = np.zeros(len(points), np.uint64)
        for n in range(1, max(orders) + 1):
            shifted = np.concatenate([code[n - 1 :], np.ones(n - 1, np.uint64)])[: len(points)]
            h = h * _Q + shifted
            if n in orders:
                yield n, ((h * _P) >> np.uint64(64 - bits)).astype(np.int64)


def word_buckets(found: Words, orders: Sequence[int], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the bucket of the n-gram at each word, and the range of n-grams of each text."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(found.hashes), np.uint64)
        for n in range(1, max(orders) + 1):
            shifted = np.concatenate([found.hashes[n - 1 :], np.zeros(n - 1, np.uint64)])[: len(h)]
            h = h * _Q + shifted
            if n in orders:
                yield n, ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64), found.starts, np.maximum(found.starts, found.ends - (n - 1))


@dataclass
class Grams:
    """Which n-grams a model looks at: orders of characters and of words, 2**bits buckets for each order."""

    chars: tuple[int, ...]
    words: tuple[int, ...]
    bits: int

    @property
    def size(self) -> int:
        return (len(self.chars) + len(self.words)) << self.bits

    def columns(self, layout: Layout) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The first column, the bucket of each n-gram, and each text's range of n-grams, for each order."""
        for at, (_, buckets) in enumerate(char_buckets(layout.points, self.chars, self.bits)):
            yield at << self.bits, buckets, layout.starts, layout.ends
        if self.words:
            for at, (_, buckets, s, e) in enumerate(word_buckets(words(layout), self.words, self.bits), len(self.chars)):
                yield at << self.bits, buckets, s, e

    def scores(self, layout: Layout, weights: np.ndarray) -> np.ndarray:
        """(texts, classes): the sum over orders of the mean weight of a text's n-grams. weights: (size, classes)."""
        out = np.zeros((len(layout.starts), weights.shape[1]))
        for first, buckets, s, e in self.columns(layout):
            count = np.maximum(e - s, 1)
            for k in range(weights.shape[1]):
                column = np.ascontiguousarray(weights[first : first + (1 << self.bits), k])
                out[:, k] += layout.sums(column[buckets], s, e) / count
        return out

    def sparse(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(columns, shares) of one text."""
        layout = Layout.of([text])
        columns, shares = [], []
        for first, buckets, s, e in self.columns(layout):
            found, n = np.unique(buckets[s[0] : e[0]], return_counts=True)
            columns.append(found + first)
            shares.append(n / max(1, n.sum()))
        return np.concatenate(columns).astype(np.int32), np.concatenate(shares).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

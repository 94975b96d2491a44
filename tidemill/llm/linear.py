"""Hashed sparse features and a follow-the-regularised-leader logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import text as T

_U = np.uint64


def _const(n: int) -> np.uint64:
    return T.mix(np.array([n], np.uint64))[0]


_REPEAT, _CAPS, _PREFIX = _const(101), _const(102), _const(103)


def word_ngrams(s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(doc, 64-bit feature): word 1- and 2-grams, a marker for each repeated word and each word in capitals.

    A word is a run of letters, of digits or of other marks. A 2-gram of one word twice
    becomes the repeat marker, so that what is learnt does not hang on the word itself.
    """
    t = T.runs(s)
    if not len(t.hash):
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    at, pair = T.ngrams(t.doc, t.hash, 2)
    pair = np.where(t.hash[at] == t.hash[at + 1], _REPEAT, pair) if len(at) else pair
    upper = np.add.reduceat(((s.buf >= 65) & (s.buf <= 90)).astype(np.int32), t.start) if len(t.start) else np.zeros(0)
    # reduceat runs to the next start, which only adds white space, never a letter
    caps = np.flatnonzero((upper >= 2) & (upper * 2 > t.size))
    return (
        np.concatenate([t.doc, t.doc[at], t.doc[caps]]),
        np.concatenate([t.hash, pair, np.full(len(caps), _CAPS, np.uint64)]),
    )


def word_prefixes(s: T.Slice, lengths: tuple[int, ...] = (4, 5, 6, 7, 8)) -> tuple[np.ndarray, np.ndarray]:
    """(doc, 64-bit feature): letter runs and their beginnings of the given byte lengths."""
    t = T.runs(s)
    keep = T.KIND[s.buf[t.start]] == 1 if len(t.start) else np.zeros(0, bool)
    doc, start, size, h = t.doc[keep], t.start[keep], t.size[keep], t.hash[keep]
    docs, feats = [doc], [h]
    for k in lengths:
        long = np.flatnonzero(size > k)
        with np.errstate(over="ignore"):
            g = T.hash_spans(s.buf, start[long], np.full(len(long), k, np.int64)) + _PREFIX
        docs.append(doc[long])
        feats.append(T.mix(g))
    return np.concatenate(docs), np.concatenate(feats)


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal state over ``2**bits`` hashed weights."""

    bits: int = 18
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 1.0

    def __post_init__(self) -> None:
        self.z = np.zeros(1 << self.bits)
        self.n = np.zeros(1 << self.bits)
        self.z0 = self.n0 = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return -self.z0 / ((self.beta + self.n0**0.5) / self.alpha)

    def step(self, at: np.ndarray, x: np.ndarray, gradient: float, w: np.ndarray) -> None:
        """One update with d loss / d score = ``gradient`` on the features ``at`` (distinct) of value ``x``."""
        g = gradient * x
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w
        root0 = self.n0**0.5
        b = self.bias()
        self.n0 += gradient * gradient
        self.z0 += gradient - (self.n0**0.5 - root0) / self.alpha * b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))

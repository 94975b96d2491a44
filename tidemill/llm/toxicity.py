"""Toxicity classifier with a counterfactual penalty on identity terms.

A labelled text that names a group is paired with the same text in which the term is swapped for
another of its set; besides the logistic loss the training minimises ``penalty * (s(x) - s(x'))**2``,
s being the score before the sigmoid, so a neutral mention of a group cannot carry the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from . import text as T
from .quality import by_document, labelled_sample, train_in_one_task

#: Terms that can stand for one another in a neutral sentence.
IDENTITY_SETS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "mujeres", "hombres", "femmes", "hommes", "frauen", "männer"),
    ("woman", "man", "mujer", "hombre", "femme", "homme", "frau", "mann"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "citizens", "foreigners", "locals"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "sighted"),
    ("germans", "french", "spaniards", "americans", "mexicans", "turks", "poles", "chinese"),
)


@dataclass(frozen=True)
class ToxicityModel:
    """The features with a weight (ascending 64-bit hashes, exact match), their weights and a bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Probability of label 1: the summed weights of the distinct features of each whole text."""
        out = np.full(len(texts), float(linear.sigmoid(np.array(self.bias))))
        if not len(self.keys):
            return out
        # a bitmap over the hashes' first 16 bits passes by nearly all features without a search
        maybe = np.zeros(1 << 16, bool)
        maybe[self.keys >> np.uint64(48)] = True
        for s in T.slices(texts):
            doc, f = linear.word_prefixes(s)
            some = maybe[f >> np.uint64(48)]
            doc, f = doc[some], f[some]
            at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            hit = self.keys[at] == f
            doc, at = T.distinct_per_doc(doc[hit], at[hit])
            out[s.first : s.first + s.n] = linear.sigmoid(self.bias + T.sum_per_doc(doc, self.weights[at], s.n))
        return out


def identity_features() -> list[tuple[int, np.uint64, np.ndarray]]:
    """(set, word hash, features) of each identity term."""
    out = []
    for k, terms in enumerate(IDENTITY_SETS):
        for f in by_document(pa.array(terms), linear.word_prefixes):
            out.append((k, f[0], np.unique(f)))
    return out


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "toxic",
    train: Column | None = None,
    max_rows: int = 10_000,
    penalty: float = 0.5,
    alpha: float = 1.0,
    l1: float = 4.0,
    l2: float = 0.1,
    epochs: int = 8,
    bits: int = 22,
) -> ToxicityModel:
    """Train on at most ``max_rows`` labelled texts; ``penalty`` 0 turns the counterfactual term off.

    Null labels, ids and texts are left out; without a labelled text every score is 0.5.
    """

    def fit(t: pa.Table) -> dict[str, bytes]:
        y = t["label"].to_numpy()
        rng = np.random.default_rng(7)
        m = linear.Ftrl(bits, alpha, 1.0, l1, l2)
        shift = np.uint64(64 - bits)
        terms = identity_features()
        rows = [np.unique(f, return_counts=True) for f in by_document(t["text"], linear.word_prefixes)]
        slot = lambda f: np.unique((f >> shift).astype(np.int64))
        flat = [slot(f) for f, _ in rows]
        named = [[j for j, (_, h, _) in enumerate(terms) if len(f) and f[min(np.searchsorted(f, h), len(f) - 1)] == h] for f, _ in rows]

        def swapped(f: np.ndarray, c: np.ndarray, j: int) -> np.ndarray:
            """The features after every mention of term j has become another term of its set."""
            k, h, own = terms[j]
            times = c[np.searchsorted(f, h)]
            others = [x for i, (q, _, x) in enumerate(terms) if q == k and i != j]
            left = f[c - np.where(np.isin(f, own), times, 0) > 0]
            return np.union1d(left, others[rng.integers(len(others))])

        def dot(at: np.ndarray) -> tuple[float, np.ndarray]:
            w = m.weights(at)
            return float(w.sum()) + m.bias(), w

        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                at = flat[i]
                s, w = dot(at)
                m.step(at, np.ones(len(at)), float(linear.sigmoid(np.array(s))) - float(y[i]), w)
                for j in named[i] if penalty else ():
                    other = slot(swapped(*rows[i], j))
                    union = np.union1d(at, other)
                    x = np.isin(union, at).astype(float) - np.isin(union, other)
                    union, x = union[x != 0], x[x != 0]
                    w = m.weights(union)
                    bias = m.z0, m.n0
                    m.step(union, x, 2 * penalty * float(w @ x), w)
                    m.z0, m.n0 = bias  # the bias is the same on both sides
        keys = np.unique(np.concatenate([f for f, _ in rows])) if rows else np.zeros(0, np.uint64)
        w = m.weights((keys >> shift).astype(np.int64))
        return {"k": keys[w != 0].tobytes(), "w": w[w != 0].tobytes(), "b": np.array([m.bias()]).tobytes()}

    got = {r.name: r.v for r in train_in_one_task(labelled_sample(docs, labels, label, max_rows, F.lit(True) if train is None else train), fit)}
    if not got:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    return ToxicityModel(np.frombuffer(got["k"], np.uint64), np.frombuffer(got["w"]), float(np.frombuffer(got["b"])[0]))

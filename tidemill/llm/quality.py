"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base, linear
from . import text as T


@dataclass(frozen=True)
class QualityModel:
    """Dense weights over ``2**bits`` hashed features and a bias; at most ``8 * 2**bits`` bytes."""

    weights: np.ndarray
    bias: float

    @property
    def bits(self) -> int:
        return int(len(self.weights)).bit_length() - 1

    def scores(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Probability of label 1 for each text: a sparse dot product of its n-gram shares."""
        out = np.zeros(len(texts))
        shift = np.uint64(64 - self.bits)
        for s in T.slices(texts):
            doc, f = linear.word_ngrams(s)
            total = T.sum_per_doc(doc, self.weights[(f >> shift).astype(np.int64)], s.n)
            n = np.maximum(1, np.bincount(doc, minlength=s.n))
            out[s.first : s.first + s.n] = linear.sigmoid(self.bias + SCALE * total / n)
        return out


#: A text's feature values are its n-gram shares times this.
SCALE = 10.0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, train: Column) -> DataFrame:
    """At most ``limit`` rows (key, text, label): those of ``labels`` with the lowest hashes that ``train`` admits.

    The limit is the documented bound of what a classifier is fitted on; both tables are read whole.
    """
    picked = (
        labels.where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id", "label")
        .limit(limit)
    )
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return (
        texts.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
        .select(F.xxhash64("label_id", "text").alias("key"), "text", "label")
        .orderBy("key", "text", "label")
        .limit(limit)
    )


def by_document(texts: pa.Array | pa.ChunkedArray, features) -> list[np.ndarray]:
    """The features of each text as one array."""
    out: list[np.ndarray] = []
    for s in T.slices(texts):
        doc, f = features(s)
        order = np.argsort(doc, kind="stable")
        out += np.split(f[order], np.searchsorted(doc[order], np.arange(1, s.n)))
    return out


def train_in_one_task(sample: DataFrame, fit) -> list:
    """Rows of ``fit(table) -> {name: bytes}``, run in one task over the bounded sample in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches).sort_by([("key", "ascending"), ("label", "ascending")])
        got = fit(t)
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.binary())], ["name", "v"])

    return sample.coalesce(1).mapInArrow(base.frugal(run), "name string, v binary").collect()


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "quality",
    train: Column | None = None,
    max_rows: int = 10_000,
    bits: int = 18,
    alpha: float = 0.5,
    l1: float = 0.0,
    l2: float = 1.0,
    epochs: int = 3,
) -> QualityModel:
    """Train on at most ``max_rows`` labelled texts (null labels, ids and texts are left out).

    Without any labelled text the model scores 0.5 everywhere. Only the text enters a score.
    """

    def fit(t: pa.Table) -> dict[str, bytes]:
        y = t["label"].to_numpy()
        m = linear.Ftrl(bits, alpha, 1.0, l1, l2)
        rows = []
        for f in by_document(t["text"], linear.word_ngrams):
            at, c = np.unique(f >> np.uint64(64 - bits), return_counts=True)
            rows.append((at.astype(np.int64), SCALE * c / max(1, c.sum())))
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                at, x = rows[i]
                w = m.weights(at)
                m.step(at, x, float(linear.sigmoid(w @ x + m.bias())) - float(y[i]), w)
        return {"w": m.weights(np.arange(1 << bits)).tobytes(), "b": np.array([m.bias()]).tobytes()}

    got = {r.name: r.v for r in train_in_one_task(labelled_sample(docs, labels, label, max_rows, F.lit(True) if train is None else train), fit)}
    if not got:
        return QualityModel(np.zeros(1 << bits), 0.0)
    return QualityModel(np.frombuffer(got["w"]), float(np.frombuffer(got["b"])[0]))


def score_documents(docs: DataFrame, model, *, threshold: float) -> DataFrame:
    """(doc_id, score, predicted) of every row; a null or empty text has no features and scores by the bias.

    Repeated rows stay repeated, a null ``doc_id`` stays null, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(base.frugal(run), f"doc_id {kind}, score double, predicted int")


def keep_quality(docs: DataFrame, model: QualityModel, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score reaches the threshold."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts))

    return docs.where(score(F.col("text")) >= threshold)

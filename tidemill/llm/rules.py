"""Quality rules: base counts, and the log-likelihood ratio of hashed n-grams under a trusted target and the raw corpus.

Both multinomials hold all words 1- and 2-grams (see ``linear.word_ngrams``) hashed into ``2**bits``
buckets, over all documents: the raw one over every row, the target over every row that is trusted.
A document's verdict is its summed log ratio divided by its number of n-grams, held against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, linear
from . import text as T

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A label table of up to this many rows is broadcast (16 bytes a row); a larger one is joined by a shuffle.
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class RatioModel:
    """log p(bucket | target) - log p(bucket | raw), at most ``8 * 2**bits`` bytes."""

    ratio: np.ndarray
    threshold: float

    @property
    def shift(self) -> np.uint64:
        return np.uint64(64 - (len(self.ratio).bit_length() - 1))

    def scores(self, s: T.Slice) -> np.ndarray:
        """Length-normalised log ratio of each text; 0 without n-grams."""
        doc, f = linear.word_ngrams(s)
        total = T.sum_per_doc(doc, self.ratio[(f >> self.shift).astype(np.int64)], s.n)
        return total / np.maximum(1, np.bincount(doc, minlength=s.n))


def base_counts(s: T.Slice) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a slice."""
    n = s.n
    w = T.words(s)
    n_words = w.per_doc(n)

    def bytes_per_doc(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[s.end] - c[s.begin]

    chars = bytes_per_doc(~T.SPACE[s.buf] & ((s.buf & 0xC0) != 0x80))

    at, g = T.ngrams(w.doc, w.hash, WINDOW)
    covered = np.zeros(len(w.doc) + 1, np.int64)
    if len(at):
        doc = w.doc[at]
        order = np.lexsort((g, doc))
        same = (g[order][1:] == g[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    repeat = np.bincount(w.doc, weights=np.cumsum(covered[:-1]) > 0, minlength=n).astype(np.int64)

    ln = T.lines(s)
    solid = np.concatenate([[0], np.cumsum(~T.SPACE[s.buf])])
    full = solid[ln.start + ln.size] > solid[ln.start] if len(ln.start) else np.zeros(0, bool)
    doc, h = ln.doc[full], ln.hash[full]
    distinct = np.bincount(T.distinct_per_doc(doc, h)[0], minlength=n)
    dup = np.bincount(doc, minlength=n) - distinct
    return {"n_words": n_words, "word_chars": chars, "n_symbols": bytes_per_doc(_SYMBOL[s.buf]), "n_dup_lines": dup, "n_repeat_words": repeat}


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def fit_ratio(docs: DataFrame, trusted: DataFrame, *, bits: int = 12, threshold: float = -0.15, smoothing: float = 4.0) -> RatioModel:
    """Count both multinomials over all of ``docs``.

    A few thousand buckets with some pseudo-counts each, dealt by the raw corpus, keep words that a small
    target happens to lack near a ratio of 0, so that clean texts outside the target do not suffer.

    ``trusted`` has the ``doc_id`` of the target's rows. Null texts hold no n-grams; null ids are never trusted; several ``trusted`` rows of one id count once.
    Without a trusted text, or without any, all ratios are 0 and every document meets a threshold of at most 0.
    """
    ids = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("trusted_id")).distinct()
    marked = docs.select("doc_id", "text").join(base.bounded_broadcast(ids, BROADCAST_ROWS), F.col("doc_id") == F.col("trusted_id"), "left")
    marked = marked.select("text", F.col("trusted_id").isNotNull().alias("is_target"))
    size, shift = 1 << bits, np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        raw, target = np.zeros(size), np.zeros(size)
        for b in batches:
            good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for s in T.slices(b.column(0)):
                doc, f = linear.word_ngrams(s)
                at = (f >> shift).astype(np.int64)
                raw += np.bincount(at, minlength=size)
                target += np.bincount(at[good[s.first + doc]], minlength=size)
        return {0: raw, 1: target}

    got = base.summed_vectors(marked, count)
    raw, target = got.get(0, np.zeros(size)), got.get(1, np.zeros(size))
    if not target.sum():
        return RatioModel(np.zeros(size), threshold)
    # the target's smoothing mass follows the raw corpus, so an unseen bucket of either has a ratio near 0
    p_raw = (raw + smoothing / size) / (raw.sum() + smoothing)
    prior = smoothing * size
    p_target = (target + prior * p_raw) / (target.sum() + prior)
    return RatioModel(np.log(p_target / p_raw), threshold)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double"


def judge(texts: pa.Array | pa.ChunkedArray, model: RatioModel) -> list[np.ndarray]:
    """The columns of ``COLUMNS`` for each text."""
    got: list[list[np.ndarray]] = [[] for _ in range(8)]
    for s in T.slices(texts):
        c = base_counts(s)
        failed, ratio = base_failed(c["n_words"], c["n_repeat_words"]), model.scores(s)
        for x, y in zip(got, [*c.values(), failed, ~failed & (ratio >= model.threshold), ratio], strict=True):
            x.append(y)
    return [np.concatenate(x) if x else np.zeros(0) for x in got]


def apply_rules(docs: DataFrame, model: RatioModel) -> DataFrame:
    """doc_id, the base counts, both verdicts and the ratio of every row.

    A null or empty text has no words, so the base rules fail it; repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = judge(b.column(1), model)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x.astype(np.int64)) for x in cols[:5]), *(pa.array(x.astype(bool)) for x in cols[5:7]), pa.array(cols[7].astype(float))],
                ["doc_id", *(x.split()[0] for x in COLUMNS.split(", "))],
            )

    return docs.select("doc_id", "text").mapInArrow(base.frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def keep_by_rules(docs: DataFrame, model: RatioModel) -> DataFrame:
    """The rows of ``docs`` (all columns) that the rules keep."""

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        return pa.array(judge(texts, model)[6].astype(bool))

    return docs.where(kept(F.col("text")))

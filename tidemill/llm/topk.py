"""Exact top-k by inner product of integer vectors: exhaustive term-at-a-time accumulation.

Vectors are read as sparse rows: a dimension is a term, a component its weight. Queries and candidates are
gathered into blocks, stored tables of few rows, and every query block meets every candidate block.
A candidate block becomes postings (rows and weights by term). The postings of each term, scaled by the
queries' weights, are accumulated in dense arrays of scores: scattered where a term has few, and all terms
with many at once, as one product of the queries' weights and the postings written out, in floats as long as
these hold every sum exactly. A partition selection keeps the k best of each query, and the tasks' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

#: Bytes of vectors in a block at most (or one vector).
PASS_BYTES = 4 << 20
#: Candidates and queries of a block of dense scores.
ROWS, QUERIES = 8192, 1024
#: Share of the rows from which on a term's postings are written out, and candidates of a query that are sorted with those of all.
DENSE, TIES = 1 / 16, 64
#: Query rows whose best lists a task holds before it passes them on.
HELD = 200_000


def valid(vector: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component x, taken as double, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


class Postings:
    """Rows and weights of each term of a block of sparse integer rows."""

    def __init__(self, offsets: np.ndarray, values: np.ndarray) -> None:
        self.n = len(offsets) - 1
        size = np.diff(offsets)
        row = np.repeat(np.arange(self.n), size)
        term = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], size)
        keep = values != 0
        order = np.argsort(term[keep], kind="stable")
        self.rows, self.weights, terms = row[keep][order], values[keep][order], term[keep][order]
        self.width = int(size.max()) if self.n else 0
        self.cut = np.searchsorted(terms, np.arange(self.width + 1))
        self._dense: dict[type, np.ndarray] = {}
        many = np.diff(self.cut) >= DENSE * self.n
        self.many, self.few = np.flatnonzero(many), np.flatnonzero(~many)
        self.largest = np.zeros(self.width)
        np.maximum.at(self.largest, terms, np.abs(self.weights.astype(float)))

    def term(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = self.cut[t], self.cut[t + 1]
        return self.rows[i:j], self.weights[i:j]

    def written_out(self, terms: np.ndarray, kind: type) -> np.ndarray:
        """The weights of some terms, rows by terms."""
        out = np.zeros((self.n, len(terms)), kind)
        for k, t in enumerate(terms.tolist()):
            rows, w = self.term(t)
            out[rows, k] = w
        return out

    def scores(self, queries: Postings) -> np.ndarray:
        """Inner products, queries by rows, as floats if those are exact; a term that a shorter vector lacks counts as 0."""
        width = min(self.width, queries.width)
        bound = float((self.largest[:width] * queries.largest[:width]).sum())
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        many = self.many[self.many < width]
        if kind not in self._dense:
            self._dense[kind] = self.written_out(self.many, kind)
        out = queries.written_out(many, kind) @ self._dense[kind][:, : len(many)].T
        for t in self.few[self.few < width].tolist():
            rows, w = self.term(t)
            w = w.astype(kind)
            for q, x in zip(*queries.term(t), strict=True):
                out[q, rows] += kind(x) * w
        return out


def _arrays(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy()
    return off - off[0], column.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of the k highest of each query, ties to the smaller id, the query's own rows aside."""
    q, i = [], []
    for n, (row, me) in enumerate(zip(scores, own, strict=True)):
        at = np.flatnonzero(ids != me)
        x = row[at]
        if len(at) > k:
            least = np.partition(x, len(x) - k)[len(x) - k]
            at = at[x >= least]  # all ties with the last place stay until the ids decide
        at = at[np.lexsort((ids[at], -row[at]))[:k]]
        q.append(np.full(len(at), n))
        i.append(at)
    q, i = np.concatenate(q), np.concatenate(i)
    return q, ids[i], scores[q, i]


def best_of_floats(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as :func:`best` for scores in floats, which are changed, without a loop over the queries.

    The k-th highest of the maxima of k or more disjoint sets of candidates is a lower bound of the k-th highest score.
    """
    order = np.argsort(ids, kind="stable")
    lo, hi = (np.searchsorted(ids[order], own, side) for side in ("left", "right"))
    size = hi - lo
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    scores[np.repeat(np.arange(len(own)), size), order[at]] = -np.inf
    sets = max(k, min(128, scores.shape[1] // 32))
    per = scores.shape[1] // sets
    least = np.full(len(own), -np.inf, scores.dtype)
    if per:
        top = scores[:, : sets * per].reshape(len(own), per, sets).max(axis=1)
        least = np.partition(top, sets - k, axis=1)[:, sets - k]
    hits = scores >= np.maximum(least, np.finfo(scores.dtype).min)[:, None]
    tied = np.flatnonzero(hits.sum(axis=1) > max(k, TIES))
    hits[tied] = False
    q, i = np.nonzero(hits)
    order = np.lexsort((ids[i], -scores[q, i], q))
    q, i = q[order], i[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, i = q[first], i[first]
    x = scores[q, i].astype(np.int64)
    if not len(tied):
        return q, ids[i], x
    tq, tv, tx = best(scores[tied], ids, own[tied], k)
    return np.concatenate([q, tied[tq]]), np.concatenate([ids[i], tv]), np.concatenate([x, tx.astype(np.int64)])


_BLOCK = "ids binary, offsets binary, vals binary"


def least_integer(values: np.ndarray) -> np.ndarray:
    """The values in the shortest of three types of integers that holds them."""
    for kind in (np.int16, np.int32):
        if not len(values) or (values.min() >= np.iinfo(kind).min and values.max() <= np.iinfo(kind).max):
            return values.astype(kind)
    return values


def read_values(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.int64}[len(raw) // n if n else 8]).astype(np.int64)


def floored(x: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) as long, as :func:`quantised` has it: what is beyond the longs becomes the last of them."""
    y = np.floor(x * float(scale))
    low, high = y < -(2.0**63), y >= 2.0**63
    out = np.where(low | high, 0.0, y).astype(np.int64)
    out[low], out[high] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return out


def finite_rows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a vector is valid, offsets and components of the valid ones)."""
    off, x = _arrays(column)
    x = x.astype(float)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])[off]
    ok = (bad[1:] == bad[:-1]) & column.is_valid().to_numpy(zero_copy_only=False)
    size = np.diff(off)
    return ok, np.concatenate([[0], np.cumsum(size[ok])]), x if ok.all() else x[np.repeat(ok, size)]


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """(vec_id, v) rows gathered into blocks of at most ``most`` vectors and ``PASS_BYTES`` bytes.

    Vectors of floating numbers are quantised, and those that are not valid left out.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vid = b.column(0).to_numpy()
            if pa.types.is_integer(b.schema.field(1).type.value_type):
                off, val = _arrays(b.column(1))
            else:
                ok, off, x = finite_rows(b.column(1))
                vid, val = vid[ok], floored(x)
            i = 0
            while i < len(vid):
                j = min(i + most, max(i + 1, int(np.searchsorted(off, off[i] + PASS_BYTES // 8, "right")) - 1), len(vid))
                cut = vid[i:j].astype(np.int64), (off[i : j + 1] - off[i]).astype(np.int64), least_integer(val[off[i] : off[j]])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cut], [x.split()[0] for x in _BLOCK.split(", ")])
                i = j

    return rows.mapInArrow(base.frugal(gather), _BLOCK)


def exact_top_k(vectors: DataFrame, *, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose ``vec_id`` is a multiple of ``every``, the k best other rows.

    The score is the inner product of the quantised vectors. Vectors that are null or hold null or
    non-finite components, and null ids, take no part. A row with the query's own id is not its
    candidate; of other repeated ids each row counts; a repeated query id is one query per distinct vector
    and its lists are merged, so a candidate may then stand in its list once for each of them.
    Sums wrap modulo 2**64. No valid query gives no rows.
    """
    spark = vectors.sparkSession
    named = vectors.where(F.col("vec_id").isNotNull())
    queries = named.where(F.col("vec_id") % every == 0).where(valid("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding").alias("v"))
    asked = base.stored(blocks(queries.distinct(), QUERIES))
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    floats = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = named.select(F.col("vec_id").cast("long").alias("vec_id"), floats.alias("v"))
    # blocks are few and large, so they are dealt out evenly
    searched = base.stored(blocks(rows, ROWS)).repartition(base.shuffle_partitions(spark))
    names = [x.split()[0] for x in _BLOCK.split(", ")]
    met = searched.crossJoin(asked.select(*(F.col(c).alias(f"q_{c}") for c in names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last: tuple[bytes, Postings] | None = None

        def merged() -> tuple[np.ndarray, ...]:
            q, v, s = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            return q[place < k], v[place < k], s[place < k]

        for b in batches:
            for r in range(b.num_rows):
                cols = [c[r].as_buffer() for c in b.columns]
                ids, offsets, qid, qoff = (np.frombuffer(cols[i], np.int64) for i in (0, 1, 3, 4))
                if last is None or last[0] != (cols[0].to_pybytes(), cols[2].to_pybytes()):
                    last = (cols[0].to_pybytes(), cols[2].to_pybytes()), Postings(offsets, read_values(cols[2], int(offsets[-1])))
                found = last[1].scores(Postings(qoff, read_values(cols[5], int(qoff[-1]))))
                q, v, s = (best if found.dtype == np.int64 else best_of_floats)(found, ids, qid, k)
                held.append((qid[q], v, s))
                if sum(len(x[0]) for x in held) >= HELD:
                    held = [merged()]
                    if len(held[0][0]) >= HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["query_id", "vec_id", "score"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(base.frugal(run), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

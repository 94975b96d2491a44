"""Exponential recursions y = (1 - a) y + a x that no task needs a whole series for.

The recursion is affine in the state it starts from, so blocks of a series compose. Blocks are cut by
time. One pass reduces each block to a summary of fixed size, the summaries of a series are
folded in order, and a second pass runs each block from its entry state. A row's value hangs on all
rows before it, which window frames cannot express; so the two passes are Arrow-grouped numpy code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Smooth:
    """Smoothing of ``column`` into ``out``; seeded by the first value, or by the mean of the first ``seed`` values."""

    column: str
    out: str
    alpha: float
    seed: int = 1


def span(column: str, out: str, n: int) -> Smooth:
    return Smooth(column, out, 2.0 / (n + 1))


def wilder(column: str, out: str, n: int) -> Smooth:
    """Seeded by the simple mean of the first ``n`` values at the n-th one, null before."""
    return Smooth(column, out, 1.0 / n, n)


#: 2048 hourly bars.
BLOCK_SECONDS = 2048 * 3600

#: Value (nan before the seed), rows since the last observation, observations while seeding, their sum.
State = tuple[float, int, int, float]
START: State = (np.nan, 0, 0, 0.0)


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For maps y -> a[i] y + b[i], the composition of the first up to each, by doubling stretches: no loop over rows."""
    a, b = a.copy(), b.copy()
    step = 1
    while step < len(a):
        b[step:] = a[step:] * b[:-step] + b[step:]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def _maps(s: Smooth, values: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What an observation, ``steps`` rows after the one before, does to the value: y -> a y + b."""
    w = (1 - s.alpha) ** steps
    return w / (w + s.alpha), s.alpha * values / (w + s.alpha)


def run(s: Smooth, x: np.ndarray, state: State) -> tuple[np.ndarray, State]:
    """Values of a block and the state at its end. A missing input repeats the value and weakens it."""
    y, gap, seen, total = state
    at = np.flatnonzero(~np.isnan(x))
    m, n = len(at), len(x)
    if not m:
        return np.full(n, y), (y, gap + n, seen, total)
    values = x[at]
    steps = np.diff(at, prepend=-1 - gap)
    lacking = max(0, s.seed - seen)  # observations until the seed is complete
    ys = np.full(m, np.nan)
    if lacking:
        total += float(values[: lacking - 1].sum())
        if lacking <= m:
            ys[lacking - 1] = y = (total + values[lacking - 1]) / s.seed
    if lacking < m:
        a, b = composed(*_maps(s, values[lacking:], steps[lacking:]))
        ys[lacking:] = a * y + b
    place = np.cumsum(~np.isnan(x)) - 1
    out = np.where(place >= 0, ys[place], state[0])
    return out, (float(ys[-1]), n - 1 - int(at[-1]), min(seen + m, s.seed), total)


def summary(s: Smooth, x: np.ndarray) -> dict:
    """A block's first observations with their places, and the affine maps from each of them to the block's last one."""
    at = np.flatnonzero(~np.isnan(x))
    k = min(len(at), s.seed)
    a, b = [1.0], [0.0]
    if len(at) > 1:
        c, g = _maps(s, x[at[1:]], np.diff(at))
        if len(at) > k:
            whole = composed(c[k - 1 :], g[k - 1 :])
            a, b = [float(whole[0][-1])], [float(whole[1][-1])]
        for i in range(k - 2, -1, -1):
            a, b = [a[0] * c[i], *a], [a[0] * g[i] + b[0], *b]
    return {"n": len(x), "places": at[:k].tolist(), "values": x[at[:k]].tolist(), "a": a[: max(1, k)], "b": b[: max(1, k)], "last": int(at[-1]) if len(at) else -1}


def advance(s: Smooth, state: State, b: dict) -> State:
    """The state after a block of that summary: its first observations one by one, the others by the map."""
    y, gap, seen, total = state
    places, values = b["places"], b["values"]
    if not len(places):
        return y, gap + b["n"], seen, total
    k = min(len(places), max(1, s.seed - seen))
    head = np.full(int(places[k - 1]) + 1, np.nan)
    head[list(places[:k])] = values[:k]
    _, (y, _, seen, total) = run(s, head, state)
    # the map of the k-th observation; while the seed is not complete there are no others
    return b["a"][k - 1] * y + b["b"][k - 1], b["n"] - 1 - b["last"], seen, total


_SUMMARY = "series_id string, block long, spec int, n int, places array<int>, values array<double>, a array<double>, b array<double>, last int"
_ENTRY = "series_id string, block long, spec int, y double, gap int, seen int, total double"


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_pandas().to_numpy(dtype=float, na_value=np.nan)


def smooth(df: DataFrame, specs: list[Smooth], *, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``df`` (series_id, ts, ...) with each spec's column, ordered by ``ts`` inside a block.

    A task holds the rows of ``block_seconds`` of a series; choose it for some thousands of bars.
    """
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    keyed = df.withColumn("__block", ((at - F.pmod(at, F.lit(block_seconds))) / block_seconds).cast("long"))
    inputs = sorted({s.column for s in specs})

    def reduce(t: pa.Table) -> pa.Table:
        t = t.sort_by("ts")
        rows = [{"series_id": t["series_id"][0].as_py(), "block": t["__block"][0].as_py(), "spec": i, **summary(s, _numbers(t[s.column]))} for i, s in enumerate(specs)]
        return pa.Table.from_pylist(rows, schema=_arrow(_SUMMARY))

    def fold(t: pa.Table) -> pa.Table:
        rows = []
        states: dict[int, State] = {}
        for r in t.sort_by("block").to_pylist():
            state = states.get(r["spec"], START)
            rows.append((r["series_id"], r["block"], r["spec"], *state))
            states[r["spec"]] = advance(specs[r["spec"]], state, r)
        return pa.table(list(map(list, zip(*rows, strict=True))), schema=_arrow(_ENTRY))

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("ts").drop_columns(["__block"])
        states = {r["spec"]: (r["y"], r["gap"], r["seen"], r["total"]) for r in right.to_pylist()}
        for i, s in enumerate(specs):
            y, _ = run(s, _numbers(left[s.column]), states.get(i, START))
            left = left.append_column(s.out, pa.array(y, mask=np.isnan(y)))
        return left

    kept = keyed.select(*df.columns, "__block")
    sums = kept.select("series_id", "ts", "__block", *inputs).groupBy("series_id", "__block").applyInArrow(reduce, _SUMMARY)
    entries = sums.groupBy("series_id").applyInArrow(fold, _ENTRY)
    schema = T.StructType([*df.schema.fields, *(T.StructField(s.out, T.DoubleType()) for s in specs)])
    return kept.groupBy("series_id", "__block").cogroup(entries.groupBy("series_id", "block")).applyInArrow(fill, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])

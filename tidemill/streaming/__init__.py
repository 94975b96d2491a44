"""Streaming bars and smoothing on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import recursive


def streaming_bars(ticks: DataFrame, width: str, late: str, *, series: str, ts: str, price: str, order: str) -> DataFrame:
    """OHLC bars of a tick stream; a bar is final once the watermark has passed its end."""
    at = F.struct(ts, order)
    return (
        ticks.withWatermark(ts, late)
        .groupBy(F.col(series).alias("series_id"), F.window(ts, width).alias("w"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"))
        .select("series_id", F.col("w.start").alias("ts"), "open", "high", "low", "close")
    )


def streaming_ema(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Exponential mean of a stream of rows that arrive in order of time in each series; one number of state a series."""
    spec = recursive.span(column, "ema", n)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else float("nan")
        for f in frames:
            f = f.sort_values("ts")
            x = f[column].to_numpy(dtype=float, na_value=float("nan"))
            known = x[x == x]
            # a first value is its own mean; missing ones leave the mean as it is
            out, (last, *_) = recursive.run(spec, known, (y, 0, int(y == y), 0.0))
            place = (x == x).cumsum() - 1
            ema = [out[p] if p >= 0 else y for p in place]
            y = last if len(known) else y
            yield pd.DataFrame({"series_id": key[0], "ts": f["ts"], "ema": [None if e != e else float(e) for e in ema]})
        if y == y:
            state.update((y,))

    return rows.groupBy("series_id").applyInPandasWithState(step, "series_id string, ts timestamp, ema double", "y double", "append", GroupStateTimeout.NoTimeout)

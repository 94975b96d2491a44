"""Spectra of sliding windows: Fourier amplitudes and singular-spectrum trends."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling as roll


def _window(column: str, n: int) -> Column:
    """The last ``n`` values once there are as many."""
    frame = F.collect_list(F.col(column).cast("double")).over(roll.last_rows(n))
    return F.when(F.size(frame) == n, frame)


def fourier(df: DataFrame, column: str = "close", n: int = 32, kept: int = 4) -> DataFrame:
    """``fft_1`` .. : the amplitudes of the first frequencies of the last ``n`` values, from 1 cycle in the window on; null before."""
    held = df.withColumn("__w", _window(column, n))

    def part(k: int, f) -> Column:
        weights = F.array(*(F.lit(f(2 * math.pi * k * j / n)) for j in range(n)))
        return F.aggregate(F.zip_with("__w", weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)

    amplitude = {f"fft_{k}": 2 / n * F.hypot(part(k, math.cos), part(k, math.sin)) for k in range(1, kept + 1)}
    return held.withColumns(amplitude).drop("__w")


def singular_spectrum(df: DataFrame, column: str = "close", n: int = 32, lag: int = 8, kept: int = 2) -> DataFrame:
    """``ssa_trend`` and ``ssa_share``: the last value of the window's reconstruction from its ``kept`` strongest components, and their share of the power.

    The trajectory matrices of a whole batch of windows are decomposed at once.
    """

    @F.pandas_udf("struct<trend:double,share:double>")
    def decompose(windows: pd.Series) -> pd.DataFrame:
        full = windows.notna().to_numpy()
        out = np.full((len(windows), 2), np.nan)
        if full.any():
            x = np.stack(windows[full].to_list()).astype(float)
            paths = np.lib.stride_tricks.sliding_window_view(x, lag, axis=1)
            u, s, v = np.linalg.svd(paths, full_matrices=False)
            # the window's last value stands in the last row and column only
            out[full, 0] = (u[:, -1, :kept] * s[:, :kept] * v[:, :kept, -1]).sum(axis=1)
            power = (s**2).sum(axis=1)
            out[full, 1] = np.where(power > 0, (s[:, :kept] ** 2).sum(axis=1) / np.where(power > 0, power, 1), 1.0)
        return pd.DataFrame(out, columns=["trend", "share"]).astype(object).where(~np.isnan(out), None)

    held = df.withColumn("__s", decompose(_window(column, n)))
    return held.withColumns({"ssa_trend": F.col("__s.trend"), "ssa_share": F.col("__s.share")}).drop("__s")

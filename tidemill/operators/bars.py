"""Bars from ticks, resampling, dense grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the left-closed, left-labelled bucket of a timestamp without zone."""
    at = F.unix_timestamp(ts.cast("timestamp"))
    return F.timestamp_seconds(at - F.pmod(at, F.lit(seconds))).cast("timestamp_ntz")


def ohlc(ticks: DataFrame, seconds: int, *, series: str, ts: str, price: str, order: str) -> DataFrame:
    """First, highest, lowest and last price of each bucket; ``order`` breaks ties of time. Empty buckets have no bar.

    One aggregation with map-side partials; null prices are left out.
    """
    at = F.struct(ts, order)
    return (
        ticks.where(F.col(price).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(series).alias("series_id"), bucket(F.col(ts), seconds).alias("ts"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(price).alias("ticks"))
    )


def resample(bars: DataFrame, seconds: int) -> DataFrame:
    """Coarser bars from bars."""
    return (
        bars.groupBy("series_id", bucket(F.col("ts"), seconds).alias("ts"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"))
        .dropna(subset=list(PRICES))
    )


def resample_mean(df: DataFrame, seconds: int, *columns: str) -> DataFrame:
    return df.groupBy("series_id", bucket(F.col("ts"), seconds).alias("ts")).agg(*(F.avg(c).alias(c) for c in columns))


def dense_grid(df: DataFrame, seconds: int) -> DataFrame:
    """(series_id, ts) from each series' first to its last bucket without gaps."""
    ends = df.groupBy("series_id").agg(bucket(F.min("ts"), seconds).alias("a"), bucket(F.max("ts"), seconds).alias("b"))
    return ends.select("series_id", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {seconds} SECONDS"))).alias("ts"))


def spreads(bars: DataFrame) -> DataFrame:
    """High to low, high to open and open to low."""
    return bars.withColumns({"bh_bl": F.col("high") - F.col("low"), "bh_bo": F.col("high") - F.col("open"), "bo_bl": F.col("open") - F.col("low")})

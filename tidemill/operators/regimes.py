"""Regime classifiers over features, and statistics of regimes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rolling as roll

# Fixed values of the published classifiers.
SCALER_MEAN = (0.4920, 1.0196, 0.0049)
SCALER_SCALE = (0.2780, 0.1823, 2.9037)
CENTROIDS = (
    (0.784, 0.996, 3.494),
    (0.224, 0.937, -1.501),
    (0.757, 0.846, -0.736),
    (0.797, 1.079, -1.564),
    (0.381, 0.872, -5.722),
    (0.160, 1.133, 1.921),
    (0.823, 1.363, 1.323),
    (0.238, 1.230, -3.610),
    (0.277, 0.877, 3.004),
)
CLUSTER_REGIME = (4, 2, 4, 3, 4, 5, 3, 1, 6)
REGIME_NAMES = ("VOLATILE_OVERSOLD", "BEARISH_CONTINUATION", "VOLATILE_OVERBOUGHT", "NEUTRAL", "PULLBACK_IN_UPTREND", "BULLISH_DRIFT")
REGIME_NAMES_V1 = ("HIGH_VOL_BEARISH_FADING", "STRONG_DOWNTREND", "STRONG_UPTREND", "MILD_RANGE", "LOW_VOL_BEARISH_PULLBACK", "LOW_VOL_BULLISH_DRIFT")
REGIME_ACTIONS = ("buy_reversal", "flat", "flat", "flat", "buy_meanrevert", "buy_trend")


# Fixed values of the published rules: the defaults of both functions below.
def rules(*, adx_strong: float = 35, di_strong: float = 15, atr_high: float = 0.65, atr_low: float = 0.35, di_mild: float = 5) -> Column:
    """Regime by trend strength first, then by volatility and direction; unknown features make 4."""
    adx, di, atr = F.col("adx"), F.col("di_spread"), F.col("atr_pct")
    return (
        F.when((adx >= adx_strong) & (di > di_strong), 3)
        .when((adx >= adx_strong) & (di < -di_strong), 2)
        .when((atr >= atr_high) & (di < -di_mild), 1)
        .when((atr <= atr_low) & (di < -di_mild), 5)
        .when((atr <= atr_low) & (di > di_mild), 6)
        .otherwise(4)
    )


def rules_v2(*, low: float = 0.25, high: float = 0.75, volatile: float = 1.2) -> Column:
    """Regime by band position, volatility ratio and alignment of averages; unknown features make 4."""
    bb, ratio, ema = F.col("bb_position"), F.col("atr_ratio"), F.col("ema_alignment")
    return (
        F.when((bb < low) & (ratio > volatile), 1)
        .when((bb < low) & (ema > 0), 5)
        .when((bb < low) & (ema <= 0), 2)
        .when((bb > high) & (ratio > volatile), 3)
        .when((bb > high) & (ema > 0), 6)
        .otherwise(4)
    )


def nearest_centroid() -> Column:
    """Regime of the nearest of nine centroids in standardised space (the first of equals); 4 if a feature is null."""
    x = [F.col(f) for f in ("bb_position", "atr_ratio", "ema_alignment")]
    scale = [s + 1e-10 for s in SCALER_SCALE]
    far = [reduce(lambda a, b: a + b, (F.pow((v - m) / s - (p - m) / s, 2) for v, m, s, p in zip(x, SCALER_MEAN, scale, c, strict=True))) for c in CENTROIDS]
    best = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, (d, r) in enumerate(zip(far, CLUSTER_REGIME, strict=True)))))
    known = reduce(lambda a, b: a & b, (v.isNotNull() for v in x))
    return F.when(known, best["r"]).otherwise(4)


def lookup(regime: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), regime)


def distribution(df: DataFrame) -> DataFrame:
    """Bars and share of each regime among the bars with a band position."""
    counts = df.where("bb_position IS NOT NULL").groupBy("regime").agg(F.count(F.lit(1)).alias("bars"))
    return counts.withColumn("share", F.col("bars") / F.sum("bars").over(Window.partitionBy(F.lit(1))))


def forward_statistics(df: DataFrame, value: str, *, periods: float = 252 * 6) -> DataFrame:
    """Bars, mean, deviation and yearly Sharpe ratio of ``value`` by regime."""
    g = df.where(F.col(value).isNotNull()).groupBy("regime").agg(F.count(value).alias("bars"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return g.withColumn("sharpe", F.col("mean") / (F.col("std") + 1e-10) * F.sqrt(F.lit(periods)))


def transitions(df: DataFrame) -> DataFrame:
    """Row-normalised frequencies of the next bar's regime, to three digits."""
    pairs = df.withColumn("next", roll.lead(F.col("regime"))).where("next IS NOT NULL").groupBy("regime", "next").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("regime", "next", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("regime")), 3).alias("share"))


def runs(df: DataFrame) -> DataFrame:
    """(series_id, regime, run, length) of each stretch of one regime."""
    new = F.coalesce((F.col("regime") != roll.lag(F.col("regime"))).cast("int"), F.lit(1))
    marked = df.withColumn("new", new).withColumn("run", F.sum("new").over(roll.series().rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("series_id", "regime", "run").agg(F.count(F.lit(1)).alias("length"))


def persistence(df: DataFrame) -> DataFrame:
    return runs(df).groupBy("regime").agg(F.avg("length").alias("mean"), F.percentile("length", F.lit(0.5)).alias("median"), F.max("length").alias("longest"), F.stddev_samp("length").alias("std"))


def cumulative_returns(df: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy("series_id", "regime").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cum_return", F.sum(F.coalesce(value, F.lit(0.0))).over(w))


def typology(df: DataFrame) -> DataFrame:
    """Mean features of each regime and the text class they make."""
    means = df.groupBy("regime").agg(*(F.avg(c).alias(c) for c in ("adx", "di_spread", "atr_pct")))
    adx, di, atr = F.col("adx"), F.col("di_spread"), F.col("atr_pct")
    # Fixed values of the published typology: limits and texts.
    text = (
        F.when((adx > 25) & (di > 5), "STRONG UPTREND")
        .when((adx > 25) & (di < -5), "STRONG DOWNTREND")
        .when((adx > 20) & (di > 0), "MILD UPTREND")
        .when((adx > 20) & (di < 0), "MILD DOWNTREND")
        .when(atr > 0.6, "HIGH VOLATILITY RANGE")
        .when(atr < 0.4, "LOW VOLATILITY RANGE")
        .otherwise("MIXED/TRANSITION")
    )
    return means.withColumn("typology", text)

"""Column statistics, scaling, imputation, transforms, correlation, error measures."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import align
from . import rolling as roll

#: Aggregates of all rows are one row, so they are joined by broadcast.


def unpivot(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value) rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """count, mean, std, min, q25, q50, q75 and max of each column."""
    first = unpivot(df, *columns).groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return first.join(quantiles(df, *columns), "column").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def column_stats(df: DataFrame, *columns: str) -> DataFrame:
    """Mean, sample deviation, least and greatest value of each column; one pass."""
    return unpivot(df, *columns).groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def moments(df: DataFrame, *columns: str) -> DataFrame:
    """Population deviation, skewness and excess kurtosis of each column, and the omnibus normality statistic."""
    g = unpivot(df, *columns).groupBy("column").agg(F.count("value").alias("n"), F.stddev_pop("value").alias("std_pop"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"))
    n, b1, b2 = F.col("n").cast("double"), F.col("skew"), F.col("kurt")
    y = b1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    e = -6 / (n + 1)
    x = (b2 - e) / F.sqrt(24 * n * (n - 2) * (n - 3) / (F.pow(n + 1, 2) * (n + 3) * (n + 5)))
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    t = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(t) * F.pow(F.abs(t), 1 / 3)) / F.sqrt(2 / (9 * a))
    # the statistic has two degrees of freedom, for which the tail is an exponential
    return g.withColumn("k2", z1 * z1 + z2 * z2).withColumn("p_value", F.exp(-F.col("k2") / 2))


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1 by rational approximation (relative error below 1.2e-9)."""
    # fixed values of the published approximation
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)

    def poly(x: Column, k: tuple[float, ...]) -> Column:
        return reduce(lambda s, v: s * x + v, k[1:], F.lit(k[0]))

    q = p - 0.5
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    outer = poly(tail, c) / poly(tail, d)
    return F.when(F.abs(q) <= 0.47575, q * poly(q * q, a) / poly(q * q, b)).when(q < 0, outer).otherwise(-outer)


def upper_tail(z: Column) -> Column:
    """The standard normal probability above z (absolute error below 1e-7)."""
    # fixed values of the published approximation
    k = (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    above = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * reduce(lambda s, v: s * t + v, k[1:], F.lit(k[0]))
    return F.when(z >= 0, above).otherwise(1 - above)


def shapiro(df: DataFrame, *columns: str) -> DataFrame:
    """(column, n, w, p_value): Shapiro and Wilk's W with the usual approximations of weights and tail, for 4 values or more.

    Order statistics come from ranks over ranges of the values, so no task holds a column.
    """
    v = unpivot(df, *columns).where("value IS NOT NULL")
    parted = align.in_ranges(v, "column", "value")
    within = F.row_number().over(Window.partitionBy("__p", "column").orderBy("value", "__tie"))
    placed = parted.withColumn("i", within).join(F.broadcast(align.sums_before(parted, F.lit(1), "column")), ["__p", "column"]).withColumn("i", F.col("i") + F.col("__before"))
    totals = parted.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    scores = placed.join(F.broadcast(totals), "column").withColumn("m", normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    sums = scores.groupBy("column").agg(
        F.first("n").alias("n"),
        F.sum(F.pow("m", F.lit(2))).alias("mm"),
        F.sum(F.col("value") * F.col("m")).alias("vm"),
        F.sum(F.pow(F.col("value") - F.col("mean"), 2)).alias("ss"),
        *(F.max(F.when(F.col("i") == F.col("n") - k, F.col(x))).alias(f"{x}{k}") for k in (0, 1) for x in ("m", "value")),
        *(F.max(F.when(F.col("i") == k + 1, F.col("value"))).alias(f"low{k}") for k in (0, 1)),
    )
    n, u = F.col("n").cast("double"), 1 / F.sqrt("n")
    # fixed values of the published weights of the two outer order statistics
    outer = lambda k, c: sum((x * F.pow(u, F.lit(i + 1)) for i, x in enumerate(c)), F.col(f"m{k}") / F.sqrt("mm"))
    a0 = outer(0, (0.221157, -0.147981, -2.071190, 4.434685, -2.706056))
    a1 = outer(1, (0.042981, -0.293762, -1.752461, 5.682633, -3.582633))
    both = F.col("n") > 5
    phi = F.when(both, (F.col("mm") - 2 * F.pow("m0", F.lit(2)) - 2 * F.pow("m1", F.lit(2))) / (1 - 2 * a0 * a0 - 2 * a1 * a1)).otherwise((F.col("mm") - 2 * F.pow("m0", F.lit(2))) / (1 - 2 * a0 * a0))
    ends0, ends1 = F.col("value0") - F.col("low0"), F.col("value1") - F.col("low1")
    inner = F.when(both, F.col("vm") - F.col("m0") * ends0 - F.col("m1") * ends1).otherwise(F.col("vm") - F.col("m0") * ends0) / F.sqrt(phi)
    w = F.least(F.pow(inner + a0 * ends0 + F.when(both, a1 * ends1).otherwise(0.0), 2) / F.col("ss"), F.lit(1.0))
    # fixed values of the published normalising transformations
    ln = F.log("n")
    small = {"y": -F.log(0.459 * n - 2.273 - F.log(1 - w)), "mu": 0.544 - 0.39978 * n + 0.025054 * n * n - 0.0006714 * n * n * n, "sd": F.exp(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * n * n * n)}
    large = {"y": F.log(1 - w), "mu": -1.5861 - 0.31082 * ln - 0.083751 * ln * ln + 0.0038915 * ln * ln * ln, "sd": F.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln * ln)}
    z = F.when(F.col("n") <= 11, (small["y"] - small["mu"]) / small["sd"]).otherwise((large["y"] - large["mu"]) / large["sd"])
    return sums.where("n >= 4 AND ss > 0").select("column", "n", w.alias("w"), upper_tail(z).alias("p_value"))


def quantiles(df: DataFrame, *columns: str, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles ``q25`` .. of each column, interpolated between neighbours; null for a column without values.

    Found by rank: the distinct values are dealt to ranges, and only those at the wanted ranks are looked up, so no
    task holds all values of a column.
    """
    counts = unpivot(df, *columns).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    parted = align.in_ranges(counts, "column", "value")
    upto = F.sum("n").over(Window.partitionBy("__p", "column").orderBy("value"))
    placed = parted.withColumn("upto", upto).join(F.broadcast(align.sums_before(parted, F.col("n"), "column")), ["__p", "column"])
    last = F.col("__before") + F.col("upto")
    total = parted.groupBy("column").agg((F.sum("n") - 1).alias("last_rank"))
    wanted = total.select("column", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(q) * F.col("last_rank")).alias("rank")) for i, q in enumerate(at)))).alias("x")).select("column", "x.*")
    ends = wanted.select("column", "i", "rank", F.explode(F.array(F.floor("rank"), F.ceil("rank"))).alias("whole")).distinct()
    holds = (F.col("whole") >= F.col("first")) & (F.col("whole") < F.col("last"))
    ranges = placed.select(F.col("column").alias("of"), "value", (last - F.col("n")).alias("first"), last.alias("last"))
    found = ranges.join(F.broadcast(ends), (F.col("of") == F.col("column")) & holds).select("column", "i", "rank", "whole", "value")
    share = F.when(F.col("whole") == F.col("rank"), 1.0).otherwise(1 - F.abs(F.col("whole") - F.col("rank")))
    each = found.groupBy("column", "i").agg(F.sum(F.col("value") * share).alias("value"))
    made = each.groupBy("column").agg(*(F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"q{round(q * 100)}") for i, q in enumerate(at)))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return F.broadcast(names).join(made, "column", "left").select("column", *(f"q{round(q * 100)}" for q in at))


def _beside(df: DataFrame, at: dict[str, float], *columns: str) -> DataFrame:
    """``df`` beside one row that has each column's quantiles as ``__<name>_<column>``."""
    q = quantiles(df, *columns, at=tuple(at.values()))
    one = q.agg(*(F.max(F.when(F.col("column") == c, F.col(f"q{round(x * 100)}"))).alias(f"__{k}_{c}") for c in columns for k, x in at.items()))
    return df.join(F.broadcast(one))


def _with(df: DataFrame, *aggs: Column) -> DataFrame:
    return df.join(F.broadcast(df.agg(*aggs)))


def _fitted(df: DataFrame, fit: Column | None, *aggs: Column) -> DataFrame:
    """``df`` beside the one row of aggregates over the rows that ``fit`` admits (all by default)."""
    return df.join(F.broadcast((df if fit is None else df.where(fit)).agg(*aggs)))


def z_score(df: DataFrame, *columns: str, fit: Column | None = None) -> DataFrame:
    """(x - mean) / std, 0 where the deviation is not positive."""
    aggs = [f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))]
    done = _fitted(df, fit, *aggs)
    return done.withColumns({c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(F.lit(0.0)) for c in columns}).select(*df.columns)


def min_max(df: DataFrame, *columns: str, fit: Column | None = None) -> DataFrame:
    """(x - min) / (max - min), 0 for a constant column."""
    aggs = [f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("a", F.min), ("b", F.max))]
    done = _fitted(df, fit, *aggs)

    def scaled(c: str) -> Column:
        return F.when(F.col(f"__b_{c}") > F.col(f"__a_{c}"), (F.col(c) - F.col(f"__a_{c}")) / (F.col(f"__b_{c}") - F.col(f"__a_{c}"))).otherwise(F.when(F.col(c).isNotNull(), 0.0))

    return done.withColumns({c: scaled(c) for c in columns}).select(*df.columns)


def min_max_inverse(scaled: DataFrame, original: DataFrame, *columns: str) -> DataFrame:
    """Back from ``min_max``: x * (max - min) + min."""
    aggs = [f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("a", F.min), ("b", F.max))]
    done = scaled.join(F.broadcast(original.agg(*aggs)))
    return done.withColumns({c: F.col(c) * (F.col(f"__b_{c}") - F.col(f"__a_{c}")) + F.col(f"__a_{c}") for c in columns}).select(*scaled.columns)


def fill_mean(df: DataFrame, *columns: str) -> DataFrame:
    done = _with(df, *(F.avg(c).alias(f"__{c}") for c in columns))
    return done.withColumns({c: F.coalesce(c, F.col(f"__{c}")) for c in columns}).select(*df.columns)


def fill_median(df: DataFrame, *columns: str) -> DataFrame:
    done = _beside(df, {"m": 0.5}, *columns)
    return done.withColumns({c: F.coalesce(c, F.col(f"__m_{c}")) for c in columns}).select(*df.columns)


def fill_both_ways(df: DataFrame, *columns: str) -> DataFrame:
    """The last known value, else the next one."""
    return df.withColumns({c: F.coalesce(roll.fill_forward(F.col(c)), roll.fill_backward(F.col(c))) for c in columns})


def cap_outliers(df: DataFrame, *columns: str, factor: float = 1.5, fill: bool = False) -> DataFrame:
    """Clipped to the quartiles and ``factor`` interquartile ranges beyond; with ``fill`` missing values become the median, which clipping leaves as it is."""
    done = _beside(df, {"l": 0.25, "m": 0.5, "h": 0.75}, *columns)

    def capped(c: str) -> Column:
        reach = factor * (F.col(f"__h_{c}") - F.col(f"__l_{c}"))
        low, high = F.col(f"__l_{c}") - reach, F.col(f"__h_{c}") + reach
        kept = F.when(F.col(c) < low, low).when(F.col(c) > high, high).otherwise(F.col(c))
        return F.coalesce(kept, F.col(f"__m_{c}")) if fill else kept

    return done.withColumns({c: capped(c) for c in columns}).select(*df.columns)


def variability(df: DataFrame, *columns: str) -> DataFrame:
    """Coefficient of variation after mean filling, and High or Low against the columns' median."""
    s = unpivot(fill_mean(df, *columns), *columns).groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    center = F.abs(F.when(F.abs("mean") > 1e-8, F.col("mean")).otherwise(1e-8))
    s = s.withColumn("cv", F.col("std") / center)
    return _with(s, F.percentile("cv", F.lit(0.5)).alias("__m")).select("column", "cv", F.when(F.col("cv") > F.col("__m"), "High").otherwise("Low").alias("variability"))


def log_choice(df: DataFrame, *columns: str) -> DataFrame:
    """Per column: whether the logarithm (after a shift above 0 if needed) has less skewness and kurtosis in sum."""
    v = unpivot(fill_mean(df, *columns), *columns)
    low = v.groupBy("column").agg(F.min("value").alias("low"))
    logged = v.join(F.broadcast(low), "column").withColumn("log", F.log(F.when(F.col("low") <= 0, F.col("value") - F.col("low") + 1).otherwise(F.col("value"))))
    g = logged.groupBy("column").agg(
        F.first("low").alias("low"),
        *(f(x).alias(f"{k}_{x}") for x in ("value", "log") for k, f in (("skew", F.skewness), ("kurt", F.kurtosis))),
    )
    score = lambda x: F.abs(f"skew_{x}") + F.abs(f"kurt_{x}")
    return g.select("column", "low", score("value").alias("plain_score"), score("log").alias("log_score"), F.coalesce(score("log") < score("value"), F.lit(False)).alias("use_log"))


def log_transform(df: DataFrame, *columns: str) -> DataFrame:
    """Each column mean-filled, and logged where ``log_choice`` says so: two aggregations, one projection."""
    choice = log_choice(df, *columns)
    one = choice.agg(*(F.max(F.when(F.col("column") == c, F.struct("use_log", "low"))).alias(f"__{c}") for c in columns))
    filled = fill_mean(df, *columns).join(F.broadcast(one))

    def value(c: str) -> Column:
        low = F.col(f"__{c}.low")
        shifted = F.when(low <= 0, F.col(c) - low + 1).otherwise(F.col(c))
        return F.when(F.col(f"__{c}.use_log"), F.log(shifted)).otherwise(F.col(c))

    return filled.withColumns({c: value(c) for c in columns}).select(*df.columns)


def correlations(df: DataFrame, *columns: str) -> DataFrame:
    """(a, b, corr) for a <= b; one aggregation over pairwise complete rows."""
    pairs = list(combinations_with_replacement(sorted(columns), 2))
    row = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs))).alias("p")).select("p.*")


def average_ranks(df: DataFrame, *columns: str) -> DataFrame:
    """Each column's rank, ties averaged, from counts by distinct value; rows are not gathered by column."""
    out = df
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        parted = align.in_ranges(counts, "__v")
        local = parted.withColumn("__upto", F.sum("__n").over(Window.partitionBy("__p").orderBy("__v")))
        before = align.sums_before(parted, F.col("__n"))
        ranks = local.join(F.broadcast(before), "__p").select("__v", (F.col("__before") + F.col("__upto") - (F.col("__n") - 1) / 2).alias("__rank"))
        out = out.join(ranks, out[c] == ranks["__v"], "left").drop("__v").withColumn(c, F.col("__rank")).drop("__rank")
    return out.select(*df.columns)


def spearman(df: DataFrame, *columns: str) -> DataFrame:
    return correlations(average_ranks(df.dropna(subset=list(columns)).select(*columns), *columns), *columns)


def select_features(df: DataFrame, target: str, *columns: str, least: float) -> DataFrame:
    """(column, corr) of the columns whose correlation with ``target`` reaches ``least`` in size."""
    row = df.agg(*(F.corr(c, target).alias(c) for c in columns))
    return unpivot(row, *columns).where(F.abs("value") >= least).select("column", F.col("value").alias("corr"))


def errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    d = F.col(guess) - F.col(truth)
    return df.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.count(d).alias("n"))


def label_counts(df: DataFrame, *labels: str) -> DataFrame:
    """Positives, rows and ratio of each label."""
    return unpivot(df, *labels).groupBy("column").agg(F.sum("value").alias("positives"), F.count("value").alias("n"), F.avg("value").alias("ratio"))


def drop_sparse(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows of which at least ``share`` of the columns are known."""
    known = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in df.columns))
    return df.where(known >= share * len(df.columns))


def histogram(df: DataFrame, *columns: str, bins: int = 20) -> DataFrame:
    """(column, bin, n): equal bins from the least to the greatest value."""
    v = unpivot(df, *columns).where("value IS NOT NULL")
    ends = v.groupBy("column").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("value") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return v.join(F.broadcast(ends), "column").groupBy("column", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, *columns: str, points: int = 200) -> DataFrame:
    """(column, x, density): a Gaussian kernel density at equally spaced points, with the usual bandwidth std * n ** -0.2.

    The values are binned ten times finer than the points first, so the kernel sums run over a number of bins that does not grow with the rows.
    """
    fine = 10 * points
    v = unpivot(df, *columns).where("value IS NOT NULL")
    ends = v.groupBy("column").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("n"))
    ends = ends.where("b > a").withColumns({"h": F.col("sd") * F.pow("n", F.lit(-0.2)), "width": (F.col("b") - F.col("a")) / fine})
    at = F.least(F.floor((F.col("value") - F.col("a")) / F.col("width")), F.lit(fine - 1))
    bins = v.join(F.broadcast(ends), "column").groupBy("column", at.alias("bin")).agg(F.count(F.lit(1)).alias("m"))
    grid = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (points - 1))
    z = (F.col("x") - F.col("a") - (F.col("bin") + 0.5) * F.col("width")) / F.col("h")
    kernel = F.exp(-z * z / 2) * F.col("m") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return bins.join(F.broadcast(grid), "column").groupBy("column", "x").agg(F.sum(kernel).alias("density"))

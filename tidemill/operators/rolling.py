"""Window expressions over a series (partition ``series_id``, order ``ts``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("ts")


def last_rows(n: int) -> WindowSpec:
    return series().rowsBetween(-(n - 1), 0)


def full(c: Column, n: int, value: Column) -> Column:
    """``value`` once the frame of ``n`` rows has ``n`` non-null observations."""
    return F.when(F.count(c).over(last_rows(n)) == n, value)


def lag(c: Column, n: int = 1) -> Column:
    return F.lag(c, n).over(series())


def lead(c: Column, n: int = 1) -> Column:
    return F.lead(c, n).over(series())


def change(c: Column, n: int = 1) -> Column:
    """c / (c n rows before) - 1."""
    return c / F.nullif(lag(c, n), F.lit(0.0)) - 1


def mean(c: Column, n: int) -> Column:
    return full(c, n, F.avg(c).over(last_rows(n)))


def std(c: Column, n: int) -> Column:
    """Sample standard deviation."""
    return full(c, n, F.stddev_samp(c).over(last_rows(n)))


def minimum(c: Column, n: int) -> Column:
    return full(c, n, F.min(c).over(last_rows(n)))


def maximum(c: Column, n: int) -> Column:
    return full(c, n, F.max(c).over(last_rows(n)))


def percent_rank(c: Column, n: int) -> Column:
    """Rank of the last value among the last ``n``, ties averaged, divided by ``n``."""
    frame = F.collect_list(c).over(last_rows(n))
    less = F.size(F.filter(frame, lambda x: x < c))
    same = F.size(F.filter(frame, lambda x: x == c))
    return F.when(F.size(frame) == n, (less + (same + 1) / 2) / n)


def mean_deviation(c: Column, n: int) -> Column:
    """Mean absolute deviation from the frame's mean."""
    frame = F.collect_list(c).over(last_rows(n))
    center = F.avg(c).over(last_rows(n))
    total = F.aggregate(F.transform(frame, lambda x: F.abs(x - center)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(frame) == n, total / n)


def fill_forward(c: Column) -> Column:
    return F.last(c, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))


def backwards() -> WindowSpec:
    """The series from its end: a frame up to the current row then grows by a row at a time, one that looks ahead would be run anew for each."""
    return Window.partitionBy("series_id").orderBy(F.desc("ts"))


def fill_backward(c: Column) -> Column:
    return F.last(c, ignorenulls=True).over(backwards().rowsBetween(Window.unboundedPreceding, 0))


def position() -> Column:
    """Row number of the bar in its series, from 1."""
    return F.row_number().over(series())


def in_blocks(df: DataFrame, fn: Callable[[DataFrame], DataFrame], *, rows: int, block_seconds: int) -> DataFrame:
    """``fn(df)`` for window expressions that look back at most ``rows`` rows, with each series cut into time blocks.

    A block gets copies of the ``rows`` rows before it, from as many earlier blocks as that takes, so one long
    series is worked on by many tasks. ``fn`` keeps series_id and ts. Only row counts by block are windowed over a whole series.
    """
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    keyed = df.withColumn("__b", ((at - F.pmod(at, F.lit(block_seconds))) / block_seconds).cast("long"))
    counts = keyed.groupBy("series_id", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.collect_list(F.struct("__b", "__n")).over(Window.partitionBy("series_id").orderBy("__b").rowsBetween(-rows, -1))
    start = F.struct(F.lit(rows).cast("long").alias("left"), F.array().cast("array<struct<b:bigint,take:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        take = F.least(acc["left"], x["__n"])
        return F.struct((acc["left"] - take).alias("left"), F.when(take > 0, F.concat(acc["out"], F.array(F.struct(x["__b"].alias("b"), take.alias("take"))))).otherwise(acc["out"]).alias("out"))

    earlier = counts.select("series_id", F.col("__b").alias("__to"), before.alias("__before"))
    needs = earlier.select("series_id", "__to", F.explode(F.aggregate(F.reverse("__before"), start, step, lambda a: a["out"])).alias("x"))
    needs = needs.select("series_id", "__to", F.col("x.b").alias("__b"), F.col("x.take").alias("__take"))
    last = F.row_number().over(Window.partitionBy("series_id", "__to", "__b").orderBy(F.desc("ts")))
    halo = keyed.join(needs, ["series_id", "__b"]).withColumn("__r", last).where(F.col("__r") <= F.col("__take"))
    both = keyed.withColumns({"__to": F.col("__b"), "__own": F.lit(True)}).unionByName(halo.withColumn("__own", F.lit(False)).drop("__take", "__r"))
    cut = both.withColumn("series_id", F.concat_ws("\u0001", "__to", "series_id")).drop("__b", "__to")
    done = fn(cut).where("__own").drop("__own")
    return done.withColumn("series_id", F.expr("substring(series_id, locate('\u0001', series_id) + 1)"))

"""Alignment of series of other frequencies to a bar spine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .bars import bucket


def as_of(spine: DataFrame, right: DataFrame, *columns: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """``spine`` with the last row of ``right`` at or before each time: one union, one sort per key, no range join.

    A null value of the last row stays null (it is not looked through).
    """
    pick = F.struct(*columns)
    a = spine.select(*keys, "ts", F.lit(1).alias("__side"), F.struct(*(c for c in spine.columns if c not in (*keys, "ts"))).alias("__row") if len(spine.columns) > len(keys) + 1 else F.lit(None).cast("struct<x:int>").alias("__row"), F.lit(None).cast(right.select(pick.alias("p")).schema["p"].dataType).alias("__pick"))
    b = right.select(*keys, "ts", F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), pick.alias("__pick"))
    w = Window.partitionBy(*keys).orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    joined = a.unionByName(b).withColumn("__pick", F.last("__pick", ignorenulls=True).over(w)).where("__side = 1")
    rest = [F.col(f"__row.{c}").alias(c) for c in spine.columns if c not in (*keys, "ts")]
    return joined.select(*keys, "ts", *rest, *(F.col(f"__pick.{c}").alias(c) for c in columns))


def resampled_as_of(spine: DataFrame, obs: DataFrame, seconds: int, value: str, *, fill: float = 0.0) -> DataFrame:
    """Value of the grid slot at or before each bar, the grid being forward filled from the observations.

    For bar t that is the last observation at or before min(slot(t), slot(last observation)); bars before
    it get ``fill``. No grid is built.
    """
    end = obs.groupBy("series_id").agg(bucket(F.max("ts"), seconds).alias("__end"))
    slot = bucket(F.col("ts"), seconds)
    keyed = spine.join(end, "series_id", "left").withColumn("__bar", F.col("ts")).withColumn("ts", F.least(slot, "__end"))
    found = as_of(keyed, obs.select("series_id", "ts", value), value)
    return found.select("series_id", F.col("__bar").alias("ts"), *(c for c in spine.columns if c not in ("series_id", "ts")), F.coalesce(value, F.lit(fill)).alias(value))


def shifted_ticks(spine: DataFrame, obs: DataFrame, seconds: int, value: str, n: int) -> DataFrame:
    """tick_1 .. tick_n: the forward-filled grid value i slots before, for bars on the grid inside its shifted range; else null."""
    ends = obs.groupBy("series_id").agg(bucket(F.min("ts"), seconds).alias("__a"), bucket(F.max("ts"), seconds).alias("__b"))
    out = spine.join(ends, "series_id", "left")
    for i in range(1, n + 1):
        back = F.expr(f"INTERVAL {i * seconds} SECONDS")
        on = (F.col("ts") == bucket(F.col("ts"), seconds)) & (F.col("ts") >= F.col("__a") + back) & (F.col("ts") <= F.col("__b") + back)
        keyed = out.withColumn("__bar", F.col("ts")).withColumn("ts", F.col("ts") - back)
        found = as_of(keyed, obs.select("series_id", "ts", F.col(value).alias("__v")), "__v")
        out = found.withColumn("ts", F.col("__bar")).withColumn(f"tick_{i}", F.when(on, F.col("__v"))).drop("__v", "__bar")
    return out.drop("__a", "__b")


def exact(spine: DataFrame, right: DataFrame, *columns: str, fill: float | None = None) -> DataFrame:
    """Left join on (series_id, ts); missing values become ``fill``."""
    joined = spine.join(right.select("series_id", "ts", *columns), ["series_id", "ts"], "left")
    return joined if fill is None else joined.withColumns({c: F.coalesce(c, F.lit(fill)) for c in columns})


def outer(*frames: DataFrame) -> DataFrame:
    """Full outer alignment on (series_id, ts)."""
    return reduce(lambda a, b: a.join(b, ["series_id", "ts"], "full"), frames)


def common_range(*frames: DataFrame) -> DataFrame:
    """One row: latest start and earliest end over all frames."""
    ends = reduce(lambda a, b: a.unionByName(b), (f.agg(F.min("ts").alias("a"), F.max("ts").alias("b")) for f in frames))
    return ends.agg(F.max("a").alias("start_ts"), F.min("b").alias("end_ts"))


def within(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows inside the one-row range (both ends included)."""
    return df.join(F.broadcast(limits), F.col("ts").between(F.col("start_ts"), F.col("end_ts"))).select(*df.columns)


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` dealt to ranges of the order, stored with the range's number as ``__p`` and a last tie-break as ``__tie``.

    It is stored because ranges are cut from a sample each time a plan runs, and two plans that read
    other columns would cut them differently. Rows that are alike in the order are told apart by a hash of
    the whole row and then by where they came from, so one frequent key does not fill a range.
    """
    tied = df.withColumn("__tie", F.struct(F.xxhash64(*df.columns).alias("h"), F.monotonically_increasing_id().alias("i")))
    return stored(tied.repartitionByRange(*order, "__tie").withColumn("__p", F.spark_partition_id()))


def sums_before(df: DataFrame, weight: Column, *keys: str) -> DataFrame:
    """For each range (and key), the sum of ``weight`` over the ranges before it; one row for each range and key."""
    sums = df.groupBy("__p", *keys).agg(F.sum(weight).alias("__s"))
    w = Window.partitionBy(*(keys or (F.lit(1),))).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("__before", F.coalesce(F.sum("__s").over(w), F.lit(0))).drop("__s")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with a gapless ``row_pos`` from 1 in the given order, without gathering the rows in one task.

    Rows are dealt to ranges; each range is numbered by itself, after the counts of those before. Ties
    are numbered in the order of a hash of the row.
    """
    parted = in_ranges(df, *order)
    local = parted.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order, "__tie")))
    before = sums_before(parted, F.lit(1))
    return local.join(F.broadcast(before), "__p").withColumn("row_pos", (F.col("__n") + F.col("__before")).cast("long")).select(*df.columns, "row_pos")


def positional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns side by side by ``row_pos``; the shorter side is padded with nulls."""
    return left.join(right, "row_pos", "full")

"""Forward-looking labels: first touch of take-profit or stop-loss, horizons, slices and splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import indicators
from . import rolling as roll


@dataclass(frozen=True)
class Costs:
    """Spread, slippage and commission in points of ``pip``."""

    spread: float = 30.0
    slippage: float = 10.0
    commission: float = 10.0
    pip: float = 1e-5

    @property
    def points(self) -> float:
        return self.spread + self.slippage + 2 * self.commission / (100000.0 * self.pip)


def friday_close(hour: int = 20) -> Column:
    return (F.weekday("ts") == 4) & (F.hour("ts") >= hour)


def _next(flag: Column, skip: int = 1) -> Column:
    """Position of the next flagged bar at least ``skip`` bars on."""
    return F.min(F.when(flag, F.col("pos"))).over(roll.backwards().rowsBetween(Window.unboundedPreceding, -skip))


def oracle_horizon(bars: DataFrame, *, hour: int = 20, fallback: int = 120) -> DataFrame:
    """``horizon``: bars to the week's close; 0 on it; to the series' end if there is none; ``fallback`` for the last bar."""
    s = bars.withColumn("pos", roll.position())
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    h = F.coalesce(_next(friday_close(hour)) - F.col("pos"), n - F.col("pos"))
    return s.withColumn("horizon", F.when(friday_close(hour), 0).when(h == 0, fallback).otherwise(h).cast("int"))


def direction_horizon(bars: DataFrame, *, hour: int = 20, fallback: int = 120) -> DataFrame:
    """``horizon``: bars to the next week's close, or to the first Monday bar from two bars on; if none, the rest or ``fallback``."""
    s = bars.withColumn("pos", roll.position())
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    first = F.least(_next(friday_close(hour)), _next(F.weekday("ts") == 0, 2))
    return s.withColumn("horizon", F.coalesce(first - F.col("pos"), F.greatest(n - F.col("pos"), F.lit(fallback))).cast("int"))


@dataclass(frozen=True)
class Touch:
    """The first later bar whose ``value`` reaches ``limit`` from below (``above``) or from above; its distance goes to ``out``."""

    out: str
    value: str
    limit: str
    above: bool


def touch_distance(values: np.ndarray, limit: np.ndarray, last: np.ndarray, above: bool) -> np.ndarray:
    """Bars from each bar to the first later one, at most bar ``last``, that reaches its limit; 0 if none does.

    Extremes of stretches of 1, 2, 4, ... bars let every bar step over what cannot reach its limit, so a
    bar takes a number of steps in the logarithm of its horizon. A missing value or limit is never reached.
    """
    n = len(values)
    sign = 1.0 if above else -1.0
    levels = [np.where(np.isnan(values), -np.inf, sign * values)]
    while 2 ** len(levels) <= n:
        step = 2 ** (len(levels) - 1)
        levels.append(np.maximum(levels[-1][:-step], levels[-1][step:]))
    want = np.where(np.isnan(limit), np.inf, sign * limit)
    own = np.arange(n)
    at = own + 1
    for k in range(len(levels) - 1, -1, -1):
        fits = at + 2**k - 1 <= last
        low = np.zeros(n, bool)
        low[fits] = levels[k][at[fits]] < want[fits]
        at = at + np.where(low, 2**k, 0)
    return np.where(at <= last, at - own, 0)


def first_touches(df: DataFrame, touches: list[Touch], *, hour: int) -> DataFrame:
    """``df`` (with pos and horizon) with each touch's distance in bars, null if there is none inside the horizon.

    No horizon goes beyond the next week's close, so a week's bars, with the close before them, form a group:
    the work of one series is spread over its weeks. A series without such a bar is one group.
    """
    closes = F.coalesce(friday_close(hour), F.lit(False)).cast("int")
    upto = F.sum(closes).over(roll.series().rowsBetween(Window.unboundedPreceding, 0))
    # the week's close ends its own week and is looked ahead from in the next
    weeks = F.when(closes == 1, F.array(F.col("__w") - 1, F.col("__w"))).otherwise(F.array("__w"))
    each = df.withColumn("__w", upto).withColumn("__own", F.col("__w")).withColumn("__w", F.explode(weeks))

    def find(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n = t.num_rows
        last = np.minimum(np.arange(n) + t["horizon"].to_numpy(), n - 1)
        # a group's last bar may be a copy that belongs to the week after
        for x in touches:
            value, limit = (t[c].cast(pa.float64()).to_pandas().to_numpy(dtype=float, na_value=np.nan) for c in (x.value, x.limit))
            far = touch_distance(value, limit, last, x.above)
            t = t.append_column(x.out, pa.array(far.astype(np.int32), mask=far == 0))
        return t.filter(pc.equal(t["__w"], t["__own"])).drop_columns(["__w", "__own"])

    schema = T.StructType([*df.schema.fields, *(T.StructField(x.out, T.IntegerType()) for x in touches)])
    return each.groupBy("series_id", "__w").applyInArrow(find, schema)


def _won(target: str, stop: str) -> Column:
    """1 if the target is met before the stop (which counts first inside one bar)."""
    return (F.col(target).isNotNull() & (F.col(stop).isNull() | (F.col(target) < F.col(stop)))).cast("int")


def oracle_labels(bars: DataFrame, *, take: float = 131.325, stop: float = 93.33, costs: Costs | None = None, hour: int = 20, fallback: int = 120) -> DataFrame:
    """Four labels and ``bars_to_friday``; entries must also earn the costs."""
    costs = costs or Costs()
    price, pip = F.col("close"), costs.pip
    far, near, back = (take + costs.points) * pip, take * pip, stop * pip
    s = oracle_horizon(bars, hour=hour, fallback=fallback)
    s = s.withColumns({"far_up": price + far, "far_down": price - far, "near_up": price + near, "near_down": price - near, "back_up": price + back, "back_down": price - back})
    found = [Touch(f"t_{x}_up", "close", f"{x}_up", True) for x in ("far", "near")] + [Touch(f"t_{x}_down", "close", f"{x}_down", False) for x in ("far", "near")]
    s = first_touches(s, [*found, Touch("s_buy", "low", "back_down", False), Touch("s_sell", "high", "back_up", True)], hour=hour)
    return s.select(
        "series_id", "ts", "open", "high", "low", "close",
        _won("t_far_up", "s_buy").alias("buy_entry_label"),
        _won("t_far_down", "s_sell").alias("sell_entry_label"),
        _won("t_near_up", "s_buy").alias("buy_exit_label"),
        _won("t_near_down", "s_sell").alias("sell_exit_label"),
        F.col("horizon").alias("bars_to_friday"),
    )


def direction_labels(bars: DataFrame, *, n: int = 14, take: float = 2.0, stop: float = 1.0, costs: Costs | None = None, hour: int = 20, fallback: int = 120) -> DataFrame:
    """Long and short labels with levels in ATRs; null without a positive ATR and on the last bar."""
    costs = costs or Costs(15.0, 5.0, 7.0)
    price, a, extra = F.col("close"), F.col("atr"), costs.points * costs.pip
    s = direction_horizon(indicators.atr(bars, n), hour=hour, fallback=fallback)
    s = s.withColumns({"up": price + take * a + extra, "down": price - take * a - extra, "stop_low": price - stop * a, "stop_high": price + stop * a, "later": roll.lead(price)})
    s = first_touches(s, [Touch("t_long", "close", "up", True), Touch("t_short", "close", "down", False), Touch("s_long", "low", "stop_low", False), Touch("s_short", "high", "stop_high", True)], hour=hour)
    known = (a > 0) & F.col("later").isNotNull()
    return s.select(
        "series_id", "ts", "open", "high", "low", "close",
        F.when(known, _won("t_long", "s_long")).cast("double").alias("direction_long_label"),
        F.when(known, _won("t_short", "s_short")).cast("double").alias("direction_short_label"),
    )


def bars_to_friday() -> Column:
    """Four-hour bars to the week's close by the calendar alone."""
    d, h = F.weekday("ts"), F.hour("ts")
    rest = F.greatest(F.lit(0), F.floor((20 - h) / 4).cast("int"))
    return F.when(d < 4, (4 - d) * 6 + rest).when(d == 4, rest).otherwise(0).cast("int")


def date_slices(bars: DataFrame, slices: list[tuple[str, str, str]], halo: int, label) -> DataFrame:
    """Rows of each (name, start, end) slice labelled by ``label`` with ``halo`` further bars in view, which are then cut off.

    Each slice is its own series while labels are made, as they depend on where it ends.
    """
    names = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(a).cast("timestamp_ntz").alias("a"), F.lit(b).cast("timestamp_ntz").alias("b")) for n, a, b in slices))
    each = bars.withColumn("__s", F.explode(names)).where(F.col("ts") >= F.col("__s.a"))
    after = F.sum((F.col("ts") > F.col("__s.b")).cast("int")).over(Window.partitionBy("series_id", "__s").orderBy("ts"))
    cut = each.withColumn("__after", after).where(F.col("__after") <= halo).withColumn("series_id", F.concat_ws("\u0001", "series_id", "__s.n"))
    ends = F.create_map(*(x for n, _, b in slices for x in (F.lit(n), F.lit(b).cast("timestamp_ntz"))))
    done = label(cut.drop("__s", "__after"))
    parts = F.split("series_id", "\u0001")
    done = done.withColumns({"slice": parts[1], "series_id": parts[0]})
    return done.where(F.col("ts") <= ends[F.col("slice")])


def chronological_split(df: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """``split`` by position in each series: the first int(n * train) rows, those up to int(n * (train + validation)), the rest."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    pos = roll.position()
    first, second = F.floor(n * train), F.floor(n * (train + validation))
    return df.withColumn("split", F.when(pos <= first, "d1").when(pos <= second, "d2").otherwise("d3"))

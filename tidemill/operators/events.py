"""Event calendars, sliding windows, positions, seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..session import stored
from . import align, stats
from . import rolling as roll

IMPORTANCE = {"Low Volatility Expected": 1, "Moderate Volatility Expected": 2, "High Volatility Expected": 3}


def number(text: Column) -> Column:
    """A calendar figure: thousands separators and a final k go, the value is not scaled; NULL if it is no number."""
    return fn.to_double(F.regexp_replace(F.regexp_replace(F.trim(text), ",", ""), "[kK]$", ""))


def importance(text: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in IMPORTANCE.items() for x in pair))
    return known[F.trim(text)]


def category_codes(df: DataFrame, *columns: str) -> DataFrame:
    """Each text's rank among the distinct ones, from 0; -1 for null. Only distinct values are numbered."""
    for c in columns:
        codes = align.numbered(df.where(F.col(c).isNotNull()).select(c).distinct(), c).select(c, (F.col("row_pos") - 1).cast("int").alias("__code"))
        df = df.join(codes, c, "left").withColumn(c, F.coalesce("__code", F.lit(-1))).drop("__code")
    return df


def surprises(df: DataFrame) -> DataFrame:
    """Distances of actual, forecast and previous values, also weighted by importance."""
    return df.withColumns(
        {
            "forecast_diff": F.col("actual") - F.col("forecast"),
            "previous_diff": F.col("actual") - F.col("previous"),
            "volatility_weighted_diff": (F.col("actual") - F.col("forecast")) * F.col("importance"),
        }
    )


def encode_calendar(raw: DataFrame) -> DataFrame:
    """Typed, complete events with differences, min-max scaled figures and category codes."""
    typed = raw.withColumns({"importance": importance(F.col("volatility")), **{c: number(F.col(c)) for c in ("actual", "forecast", "previous")}})
    full = surprises(typed.dropna(subset=["importance", "actual", "forecast", "previous"]))
    scaled = stats.min_max(full, "actual", "forecast", "previous", "forecast_diff", "volatility_weighted_diff")
    return category_codes(scaled.withColumn("country_name", F.trim("country")), "country", "description")


def one_per_time(df: DataFrame, *, importance: str, country: str, preferred: str, tie: str) -> DataFrame:
    """One event for each (series, time): the most important, then of the preferred country, then the smallest ``tie``."""
    order = [F.desc_nulls_last(importance), F.desc(F.coalesce(F.upper(country) == preferred.upper(), F.lit(False))), F.asc(tie)]
    w = Window.partitionBy("series_id", "ts").orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def calendar_filter(df: DataFrame, countries: list[str], volatilities: list[str]) -> DataFrame:
    return stats.drop_sparse(df).where(F.col("country").isin(countries) & F.col("volatility").isin(volatilities))


def sliding_windows(df: DataFrame, n: int, *columns: str, include_last: bool = False) -> DataFrame:
    """Arrays of ``n`` consecutive rows from each start; the reference form leaves out the last full window."""
    rows = F.collect_list(F.array(*(F.col(c).cast("double") for c in columns))).over(roll.series().rowsBetween(0, n - 1))
    total = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    last = total - n + (1 if include_last else 0)
    return df.withColumns({"window": rows, "__p": roll.position(), "__l": last}).where("__p <= __l").drop("__p", "__l")


def has_event(row: Column) -> Column:
    """Whether any figure of a window row is no filler."""
    return F.exists(row, lambda x: x != -1.0)


#: A window's row: scaled figures, category codes, and whether there was an event.
CALENDAR_ROW = ("forecast", "actual", "volatility", "forecast_diff", "volatility_weighted_diff", "country", "description", "event")


def aligned_calendar(bars: DataFrame, raw: DataFrame, *, preferred: str = "USA", tie: str = "description") -> DataFrame:
    """The bars inside the calendar's time, with the one event of each bar's time, -1 where there is none."""
    coded = stats.min_max(stored(encode_calendar(raw)).withColumn("volatility", F.col("importance").cast("double")), "volatility")
    once = one_per_time(coded.withColumn("series_id", F.lit("calendar")), importance="importance", country="country_name", preferred=preferred, tie=tie)
    limits = coded.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    row = once.select("ts", *(F.col(c).cast("double").alias(c) for c in CALENDAR_ROW if c != "event"), F.lit(1.0).alias("event"))
    inside = align.within(bars, limits)
    joined = inside.join(row, "ts", "left")
    filled = {c: F.coalesce(c, F.lit(0.0 if c == "event" else -1.0)) for c in CALENDAR_ROW}
    return joined.withColumns(filled).select(*bars.columns, *CALENDAR_ROW)


def calendar_windows(bars: DataFrame, raw: DataFrame, *, window: int = 128, divisor: int = 5, preferred: str = "USA", tie: str = "description") -> DataFrame:
    """series_id, ts, ``window`` (the calendar rows of the ``window`` bars before), trend and volatility of each bar that has so many before it."""
    rows = stored(aligned_calendar(bars, raw, preferred=preferred, tie=tie))
    before = F.collect_list(F.array(*(F.col(c) for c in CALENDAR_ROW))).over(roll.series().rowsBetween(-window, -1))
    signals = training_signals(rows.select("series_id", "ts", "close", before.alias("window")), "close", max(2, window // divisor))
    return signals.where(F.size("window") == window).select("series_id", "ts", "window", "trend", "volatility")


def process_calendar(bars: DataFrame, raw: DataFrame, *, window: int = 128, divisor: int = 5, kind: str = "linear", save_to: str | None = None) -> DataFrame:
    """series_id, ts, predicted_trend, predicted_volatility: a calendar's expected effect on the bars.

    Loaded events are encoded, one kept for each time, aligned to the bars, cut into windows, and a regressor fitted on the
    first part of the time predicts trend and volatility for every bar from the ``window``-th on. ``save_to``: a folder for the models.
    """
    from .models import WindowRegressor

    held = stored(calendar_windows(bars, raw, window=window, divisor=divisor))
    model = WindowRegressor(kind=kind)
    fitted = model.fit(held)
    if save_to:
        model.save(fitted, save_to)
    return model.predict(fitted, held).select("series_id", "ts", "predicted_trend", "predicted_volatility")


def previous_ticks(spine: DataFrame, ticks: DataFrame, value: str, n: int) -> DataFrame:
    """The ``n`` last tick values at or before each bar, the oldest first, nulls in front where there are fewer."""
    w = Window.partitionBy("series_id").orderBy("ts", "tick_id").rowsBetween(-(n - 1), 0)
    held = ticks.withColumn("__v", F.collect_list(F.struct(F.col(value).alias("v"))).over(w)).select("series_id", "ts", "tick_id", "__v")
    last = held.groupBy("series_id", "ts").agg(F.max_by("__v", "tick_id").alias("__v"))
    found = align.as_of(spine, last, "__v")
    lacking = F.lit(n) - F.coalesce(F.size("__v"), F.lit(0))
    values = F.transform("__v", lambda x: x["v"])
    return found.withColumn("ticks", F.concat(F.array_repeat(F.lit(None).cast("double"), F.greatest(lacking, F.lit(0))), F.coalesce(values, F.array().cast("array<double>")))).drop("__v")


def training_signals(df: DataFrame, column: str, n: int = 25) -> DataFrame:
    """Rolling mean (trend) and deviation (volatility): warm-up filled backward, outliers capped, the rest filled by the median, scaled to 0..1."""
    s = df.withColumns({"trend": roll.mean(F.col(column), n), "volatility": roll.std(F.col(column), n)})
    s = s.withColumns({c: F.coalesce(c, roll.fill_backward(F.col(c))) for c in ("trend", "volatility")})
    # three passes look at the signals
    return stats.min_max(stats.cap_outliers(stored(s), "trend", "volatility", fill=True), "trend", "volatility")


def positional_encoding(df: DataFrame, position: str, d: int) -> DataFrame:
    """pos_enc_0 .. : sine at even, cosine at odd places of position / 10000 ** (2 (i // 2) / d)."""
    if d % 2:
        raise ValueError("the number of features must be even")
    angle = lambda i: F.col(position) / F.lit(10000.0 ** (2 * (i // 2) / d))
    return df.withColumns({f"pos_enc_{i}": F.cos(angle(i)) if i % 2 else F.sin(angle(i)) for i in range(d)})


def seasonality(df: DataFrame) -> DataFrame:
    return df.withColumns({"day_of_month": F.dayofmonth("ts"), "hour_of_day": F.hour("ts"), "day_of_week": F.weekday("ts")})


def nearest_labels(points: DataFrame, sample: DataFrame, features: tuple[str, ...], label: str, k: int = 5, max_sample: int = 5000) -> DataFrame:
    """Majority label of the ``k`` nearest sampled points (ties: the nearer, then the smaller label).

    ``sample`` is a clustering sample of at most ``max_sample`` rows, so it goes to every task as one array; each
    point keeps its k best without leaving its row. A larger sample is an error when the plan runs.
    """
    row = F.struct(*features, F.col(label).alias("__label"))
    one = sample.limit(max_sample + 1).agg(F.collect_list(row).alias("__s"))
    one = one.withColumn("__s", F.when(F.size("__s") <= max_sample, F.col("__s")).otherwise(F.raise_error(F.lit(f"the sample has more than {max_sample} rows"))))
    far = lambda x: sum(((F.col(f) - x[f]) * (F.col(f) - x[f]) for f in features), F.lit(0.0))
    best = F.slice(F.array_sort(F.transform("__s", lambda x: F.struct(far(x).alias("d"), x["__label"].alias("l")))), 1, k)
    votes = F.transform(F.array_distinct(F.transform("__b", lambda x: x["l"])), lambda v: F.struct((-F.size(F.filter("__b", lambda x: x["l"] == v))).alias("n"), v.alias("l")))
    return points.join(F.broadcast(one)).withColumn("__b", best).withColumn(label, F.array_min(votes)["l"]).drop("__s", "__b")

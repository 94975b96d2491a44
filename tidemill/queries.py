"""Queries over the driver's tables and the SQL that says the same.

Ticks are ``events`` (price ``value``, series ``event_type``); all results are rounded to six digits on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import functions as fn
from .operators import align, bars, events, indicators, labels, regimes, rolling, spectral, stats
from .operators import recursive as rec
from .session import importable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HOUR, DAY = 3600, 86400
PIP = 0.1


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str, seconds: int = HOUR) -> DataFrame:
    return bars.ohlc(table(spark, sf_dir, "events"), seconds, series="event_type", ts="ts", price="value", order="event_id").drop("ticks")


def ticks(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Last event of each second of one type, as a value for every series."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select("ts", "value", "event_id", "user_id")


def bars_sql(width: str = "1 hour", name: str = "bars") -> str:
    return f"""{name} AS (SELECT e.event_type AS series_id, time_bucket(INTERVAL '{width}', e.ts) AS ts, first(e.value ORDER BY e.ts, e.event_id) AS open,
        max(e.value) AS high, min(e.value) AS low, last(e.value ORDER BY e.ts, e.event_id) AS close FROM events e GROUP BY 1, 2)"""


W = "PARTITION BY series_id ORDER BY ts"


def frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def agg_sql(f: str, col: str, n: int) -> str:
    return f"CASE WHEN count({col}) OVER {frame(n)} = {n} THEN {f}({col}) OVER {frame(n)} END"


def rank_sql(col: str, n: int) -> str:
    over = f"list({col}) OVER {frame(n)}"
    return f"CASE WHEN count({col}) OVER {frame(n)} = {n} THEN (len(list_filter({over}, lambda x: x < {col})) + (len(list_filter({over}, lambda x: x = {col})) + 1) / 2) / {n} END"


def smooth_sql(name: str, source: str, col: str, alpha: float, seed: int = 1) -> str:
    first = (
        f"SELECT series_id, i, ts, x AS y FROM {name}_i WHERE i = 1"
        if seed == 1
        else f"SELECT series_id, {seed}::BIGINT AS i, max(ts) AS ts, avg(x) AS y FROM {name}_i WHERE i <= {seed} GROUP BY series_id HAVING count(*) = {seed}"
    )
    return f"""{name}_i AS (SELECT series_id, ts, {col} AS x, row_number() OVER ({W}) AS i FROM {source} WHERE {col} IS NOT NULL),
        {name} AS ({first} UNION ALL SELECT o.series_id, o.i, o.ts, (1 - {alpha!r}) * p.y + {alpha!r} * o.x FROM {name} p JOIN {name}_i o ON o.series_id = p.series_id AND o.i = p.i + 1)"""


def span_sql(name: str, source: str, col: str, n: int) -> str:
    return smooth_sql(name, source, col, 2.0 / (n + 1))


def wilder_sql(name: str, source: str, col: str, n: int) -> str:
    return smooth_sql(name, source, col, 1.0 / n, n)


def join_sql(source: str, *names: str) -> str:
    return source + "".join(f" LEFT JOIN (SELECT series_id, ts, y AS {n} FROM {n}) {n}_j USING (series_id, ts)" for n in names)


def final(source: str, keys: str = "series_id, ts") -> str:
    return f"SELECT {keys}, round(COLUMNS(* EXCLUDE ({keys})), 6) FROM {source}"


TR = f"greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W})))"


# --- bars, projections, filters -------------------------------------------------------------------------------------


@register(f"WITH {bars_sql()} {final('bars')}")
def ohlc_bars_1h(spark, d):
    return rounded(hourly(spark, d))


@register(f"WITH {bars_sql('4 hours')} {final('bars')}")
def ohlc_bars_4h(spark, d):
    return rounded(bars.resample(hourly(spark, d), 4 * HOUR))


@register(f"WITH {bars_sql()}, s AS (SELECT series_id, ts, high - low AS bh_bl, high - open AS bh_bo, open - low AS bo_bl FROM bars) {final('s')}")
def bar_spreads(spark, d):
    return rounded(bars.spreads(hourly(spark, d)).select("series_id", "ts", "bh_bl", "bh_bo", "bo_bl"))


@register("SELECT event_type AS series_id, time_bucket(INTERVAL '1 hour', ts) AS ts, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def hourly_mean(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "series_id")
    return rounded(bars.resample_mean(e, HOUR, "value"))


@register("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10'")
def time_range_filter(spark, d):
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-10"))
    return table(spark, d, "events").where(F.col("ts").between(a, b)).select("event_id", "ts", "value")


@register("SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE event_type IN ('error', 'signup') AND value > 20")
def isin_filter(spark, d):
    return rounded(table(spark, d, "events").where(F.col("event_type").isin("error", "signup") & (F.col("value") > 20)).select("event_id", "event_type", "value"))


@register("SELECT event_id, try_cast(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS none, coalesce(try_cast(event_type AS DOUBLE), 0) AS zero FROM events")
def coerce_numbers(spark, d):
    kind = fn.to_double(F.col("event_type"))
    return table(spark, d, "events").select("event_id", fn.to_double(F.regexp_extract("props", "[0-9]+", 0)).alias("k"), kind.alias("none"), F.coalesce(kind, F.lit(0.0)).alias("zero"))


@register(f"""WITH {bars_sql()}, s AS (SELECT series_id, ts, lag(close, 1) OVER ({W}) AS close_1, close / lag(close, 1) OVER ({W}) - 1 AS ret_1,
    lead(close, 6) OVER ({W}) / close - 1 AS fwd_6, CASE WHEN close > 50 THEN close END AS above_50 FROM bars) {final('s')}""")  # fmt: skip
def returns_lag(spark, d):
    c = F.col("close")
    s = hourly(spark, d).select("series_id", "ts", rolling.lag(c).alias("close_1"), rolling.change(c).alias("ret_1"), (rolling.lead(c, 6) / F.nullif(c, F.lit(0.0)) - 1).alias("fwd_6"), F.when(c > 50, c).alias("above_50"))
    return rounded(s)


_NULLED = "CASE WHEN close > 20 THEN close END"


@register(f"WITH {bars_sql()}, s AS (SELECT series_id, ts, {_NULLED} AS a, high AS b FROM bars) {final('(SELECT * FROM s WHERE a IS NOT NULL)')}")
def drop_missing(spark, d):
    s = hourly(spark, d).select("series_id", "ts", F.when(F.col("close") > 20, F.col("close")).alias("a"), F.col("high").alias("b"))
    return rounded(s.dropna("any"))


@register(f"""WITH {bars_sql()}, s AS (SELECT series_id, ts, {_NULLED} AS a, CASE WHEN high > 60 THEN high END AS b, CASE WHEN low > 30 THEN low END AS c, CASE WHEN open > 40 THEN open END AS e FROM bars)
    {final("(SELECT * FROM s WHERE 2 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (e IS NOT NULL)::INT >= 0.75 * 6)")}""")  # fmt: skip
def drop_sparse(spark, d):
    s = hourly(spark, d)
    cut = lambda c, x, n: F.when(F.col(c) > x, F.col(c)).alias(n)
    return rounded(stats.drop_sparse(s.select("series_id", "ts", cut("close", 20, "a"), cut("high", 60, "b"), cut("low", 30, "c"), cut("open", 40, "e")), 0.75))


# --- windows and indicators -----------------------------------------------------------------------------------------


_MEANS = f"""WITH {bars_sql()}, s AS (SELECT series_id, ts, {agg_sql('avg', 'close', 14)} AS sma_14, {agg_sql('avg', 'close', 60)} AS sma_60,
    {agg_sql('stddev_samp', 'close', 20)} AS std_20 FROM bars) {final('s')}"""  # fmt: skip


def means(df: DataFrame) -> DataFrame:
    c = F.col("close")
    return df.withColumns({"sma_14": rolling.mean(c, 14), "sma_60": rolling.mean(c, 60), "std_20": rolling.std(c, 20)})


@register(_MEANS)
def rolling_mean_std(spark, d):
    return rounded(means(hourly(spark, d)).select("series_id", "ts", "sma_14", "sma_60", "std_20"))


@register(_MEANS)
def rolling_in_blocks(spark, d):
    """The same over time blocks with copied rows, as for one very long series."""
    s = rolling.in_blocks(hourly(spark, d), means, rows=59, block_seconds=40 * HOUR)
    return rounded(s.select("series_id", "ts", "sma_14", "sma_60", "std_20"))


_LOW14, _HIGH14 = agg_sql("min", "low", 14), agg_sql("max", "high", 14)


@register(f"WITH {bars_sql()}, s AS (SELECT series_id, ts, {_LOW14} AS low_14, {_HIGH14} AS high_14 FROM bars) {final('s')}")
def rolling_minmax(spark, d):
    return rounded(hourly(spark, d).select("series_id", "ts", rolling.minimum(F.col("low"), 14).alias("low_14"), rolling.maximum(F.col("high"), 14).alias("high_14")))


@register(f"WITH {bars_sql()}, s AS (SELECT series_id, ts, {rank_sql('close', 120)} AS pct FROM bars) {final('s')}")
def rolling_pct_rank(spark, d):
    return rounded(hourly(spark, d).select("series_id", "ts", rolling.percent_rank(F.col("close"), 120).alias("pct")))


@register(f"WITH RECURSIVE {bars_sql()}, {span_sql('ema_12', 'bars', 'close', 12)}, {span_sql('ema_200', 'bars', 'close', 200)} {final('(SELECT series_id, ts, ema_12, ema_200 FROM ' + join_sql('bars', 'ema_12', 'ema_200') + ')')}")
def ema(spark, d):
    return rounded(rec.smooth(hourly(spark, d), [rec.span("close", "ema_12", 12), rec.span("close", "ema_200", 200)]).select("series_id", "ts", "ema_12", "ema_200"))


@register(f"WITH RECURSIVE {bars_sql()}, t AS (SELECT *, {TR} AS tr FROM bars), {wilder_sql('atr', 't', 'tr', 14)} {final('(SELECT series_id, ts, tr, atr FROM ' + join_sql('t', 'atr') + ')')}")
def wilder_atr(spark, d):
    return rounded(indicators.atr(hourly(spark, d)).select("series_id", "ts", "tr", "atr"))


@register(f"""WITH RECURSIVE {bars_sql()}, {span_sql('f', 'bars', 'close', 12)}, {span_sql('g', 'bars', 'close', 26)},
    m AS (SELECT series_id, ts, f - g AS macd FROM {join_sql('bars', 'f', 'g')}), {span_sql('s', 'm', 'macd', 9)}
    {final('(SELECT series_id, ts, macd, s AS macd_signal, macd - s AS macd_hist FROM ' + join_sql('m', 's') + ')')}""")  # fmt: skip
def macd(spark, d):
    return rounded(indicators.macd(hourly(spark, d)).select("series_id", "ts", "macd", "macd_signal", "macd_hist"))


_DIFF = f"(close - lag(close) OVER ({W}))"
_GAIN = f"CASE WHEN {_DIFF} < 0 THEN 0 ELSE {_DIFF} END AS gain, CASE WHEN -{_DIFF} < 0 THEN 0 ELSE -{_DIFF} END AS loss"


@register(f"""WITH RECURSIVE {bars_sql()}, g AS (SELECT series_id, ts, {_GAIN} FROM bars), {wilder_sql('a', 'g', 'gain', 14)}, {wilder_sql('b', 'g', 'loss', 14)}
    {final('(SELECT series_id, ts, 100 - 100 / (1 + a / (b + 1e-10)) AS rsi FROM ' + join_sql('g', 'a', 'b') + ')')}""")  # fmt: skip
def rsi(spark, d):
    return rounded(indicators.rsi(hourly(spark, d)).select("series_id", "ts", "rsi"))


_UP, _DOWN = f"(high - lag(high) OVER ({W}))", f"(lag(low) OVER ({W}) - low)"
_DM = f"""u AS (SELECT *, CASE WHEN {_UP} < 0 THEN 0 ELSE {_UP} END AS up, CASE WHEN {_DOWN} < 0 THEN 0 ELSE {_DOWN} END AS down, {TR} AS tr FROM bars),
    dm AS (SELECT *, CASE WHEN up > down THEN up ELSE 0 END AS plus_dm, CASE WHEN coalesce(up > down, false) THEN 0 ELSE down END AS minus_dm FROM u)"""


@register(f"""WITH RECURSIVE {bars_sql()}, {_DM}, {wilder_sql('t', 'dm', 'tr', 14)}, {wilder_sql('p', 'dm', 'plus_dm', 14)}, {wilder_sql('m', 'dm', 'minus_dm', 14)},
    di AS (SELECT series_id, ts, 100 * p / nullif(t, 0) AS plus_di, 100 * m / nullif(t, 0) AS minus_di FROM {join_sql('dm', 't', 'p', 'm')}),
    x AS (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-10) AS dx FROM di), {wilder_sql('adx', 'x', 'dx', 14)}
    {final('(SELECT series_id, ts, plus_di, minus_di, adx FROM ' + join_sql('x', 'adx') + ')')}""")  # fmt: skip
def adx(spark, d):
    return rounded(indicators.adx(hourly(spark, d)).select("series_id", "ts", "plus_di", "minus_di", "adx"))


_MID, _SD = agg_sql("avg", "close", 20), agg_sql("stddev_samp", "close", 20)


@register(f"WITH {bars_sql()}, s AS (SELECT series_id, ts, {_MID} AS bb_mid, {_MID} + 2 * {_SD} AS bb_upper, {_MID} - 2 * {_SD} AS bb_lower FROM bars) {final('s')}")
def bbands(spark, d):
    return rounded(indicators.bollinger(hourly(spark, d)).select("series_id", "ts", "bb_mid", "bb_upper", "bb_lower"))


@register(f"""WITH {bars_sql()}, k AS (SELECT series_id, ts, close, {_LOW14} AS lo, {_HIGH14} AS hi FROM bars), r AS (SELECT *, 100 * (close - lo) / (hi - lo + 1e-10) AS raw_k FROM k),
    s AS (SELECT series_id, ts, {agg_sql('avg', 'raw_k', 3)} AS stoch_k FROM r), q AS (SELECT *, {agg_sql('avg', 'stoch_k', 3)} AS stoch_d FROM s) {final('q')}""")  # fmt: skip
def stochastic(spark, d):
    return rounded(indicators.stochastic(hourly(spark, d)).select("series_id", "ts", "stoch_k", "stoch_d"))


@register(f"""WITH {bars_sql()}, t AS (SELECT series_id, ts, (high + low + close) / 3 AS tp FROM bars), w AS (SELECT *, {agg_sql('avg', 'tp', 20)} AS m, list(tp) OVER {frame(20)} AS l FROM t),
    s AS (SELECT series_id, ts, (tp - m) / (0.015 * list_avg(list_transform(l, lambda x: abs(x - m))) + 1e-10) AS cci FROM w) {final('s')}""")  # fmt: skip
def cci(spark, d):
    return rounded(indicators.cci(hourly(spark, d)).select("series_id", "ts", "cci"))


@register(f"""WITH {bars_sql()}, k AS (SELECT series_id, ts, close, {_LOW14} AS lo, {_HIGH14} AS hi FROM bars),
    s AS (SELECT series_id, ts, -100 * (hi - close) / (hi - lo + 1e-10) AS williams_r FROM k) {final('s')}""")  # fmt: skip
def williams_r(spark, d):
    return rounded(indicators.williams_r(hourly(spark, d)).select("series_id", "ts", "williams_r"))


@register(f"WITH {bars_sql()}, s AS (SELECT series_id, ts, close - lag(close, 10) OVER ({W}) AS momentum, 100 * (close / lag(close, 10) OVER ({W}) - 1) AS roc FROM bars) {final('s')}")
def momentum_roc(spark, d):
    return rounded(indicators.momentum(hourly(spark, d)).select("series_id", "ts", "momentum", "roc"))


def features_sql() -> str:
    sp = lambda n, col, k, src: span_sql(n, src, col, k)
    return f"""{bars_sql()}, {_DM}, base AS (SELECT *, {_GAIN} FROM dm),
    {sp('e_tr', 'tr', 14, 'base')}, {sp('e_plus', 'plus_dm', 14, 'base')}, {sp('e_minus', 'minus_dm', 14, 'base')}, {sp('e_gain', 'gain', 14, 'base')}, {sp('e_loss', 'loss', 14, 'base')},
    {sp('ema12', 'close', 12, 'base')}, {sp('ema26', 'close', 26, 'base')}, {sp('ema50', 'close', 50, 'base')}, {sp('ema200', 'close', 200, 'base')},
    f1 AS (SELECT *, 100 * e_plus / nullif(e_tr, 0) AS plus_di, 100 * e_minus / nullif(e_tr, 0) AS minus_di, ema12 - ema26 AS macd
        FROM {join_sql('base', 'e_tr', 'e_plus', 'e_minus', 'e_gain', 'e_loss', 'ema12', 'ema26', 'ema50', 'ema200')}),
    f2 AS (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-10) AS dx FROM f1),
    {sp('adx', 'dx', 14, 'f2')}, {sp('macd_signal', 'macd', 9, 'f2')},
    f3 AS (SELECT *, {agg_sql('avg', 'tr', 14)} AS atr_raw, {agg_sql('avg', 'tr', 60)} AS atr_long, {_MID} AS bb_mid, {_SD} AS sd, {_LOW14} AS lo, {_HIGH14} AS hi, lag(close, 12) OVER ({W}) AS close_12
        FROM {join_sql('f2', 'adx', 'macd_signal')}),
    f4 AS (SELECT *, bb_mid + 2 * sd AS bb_upper, bb_mid - 2 * sd AS bb_lower, ((bb_mid + 2 * sd) - (bb_mid - 2 * sd)) / (bb_mid + 1e-10) AS bb_width FROM f3),
    feat AS (SELECT series_id, ts, open, high, low, close, atr_raw, {rank_sql('atr_raw', 120)} AS atr_pct, atr_raw / (atr_long + 1e-10) AS atr_ratio, plus_di, minus_di, adx, plus_di - minus_di AS di_spread,
        100 - 100 / (1 + e_gain / (e_loss + 1e-10)) AS rsi, bb_mid, bb_upper, bb_lower, {rank_sql('bb_width', 120)} AS bb_width_pct, (close - bb_lower) / (bb_upper - bb_lower + 1e-10) AS bb_position,
        ema50, ema200, (close - ema50) / (atr_raw + 1e-10) AS price_vs_ema50, (ema50 - ema200) / (atr_raw + 1e-10) AS ema_alignment, 100 * (close / close_12 - 1) AS roc_12,
        100 * (close - lo) / (hi - lo + 1e-10) AS stoch_k, (macd - macd_signal) / (atr_raw + 1e-10) AS macd_hist FROM f4)"""


FEATURES = features_sql()


def features(spark: SparkSession, d: str) -> DataFrame:
    return indicators.regime_features(hourly(spark, d))


@register(f"WITH RECURSIVE {FEATURES} {final('feat')}")
def regime_features(spark, d):
    return rounded(features(spark, d))


@register(f"""WITH RECURSIVE {bars_sql()}, t AS (SELECT *, (high + low + close) / 3 AS tp, {TR} AS tr, {_MID} AS m, {_SD} AS sd FROM bars), {span_sql('tp_ema', 't', 'tp', 24)}, {wilder_sql('atr', 't', 'tr', 14)},
    s AS (SELECT series_id, ts, (m + 2 * sd) - (m - 2 * sd) AS bb_width, 131.325 / nullif(atr / 1e-5, 0) AS atr_ratio, (close - (m - 2 * sd)) / nullif((m + 2 * sd) - (m - 2 * sd), 0) AS bb_position,
        {agg_sql('stddev_samp', 'tp', 24)} AS rolling_std_24, tp - tp_ema AS price_minus_ema, sin(2.0 * pi() * hour(ts) / 24) AS hod_sin, cos(2.0 * pi() * hour(ts) / 24) AS hod_cos,
        sin(2.0 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2.0 * pi() * (isodow(ts) - 1) / 7) AS dow_cos FROM {join_sql('t', 'tp_ema', 'atr')}) {final('s')}""")  # fmt: skip
def derived_features(spark, d):
    s = indicators.derived(indicators.bollinger(indicators.atr(hourly(spark, d))))
    return rounded(s.select("series_id", "ts", "bb_width", "atr_ratio", "bb_position", "rolling_std_24", "price_minus_ema", "hod_sin", "hod_cos", "dow_sin", "dow_cos"))


# --- regimes --------------------------------------------------------------------------------------------------------

_V2 = """CASE WHEN bb_position < 0.25 AND atr_ratio > 1.2 THEN 1 WHEN bb_position < 0.25 AND ema_alignment > 0 THEN 5 WHEN bb_position < 0.25 AND ema_alignment <= 0 THEN 2
    WHEN bb_position > 0.75 AND atr_ratio > 1.2 THEN 3 WHEN bb_position > 0.75 AND ema_alignment > 0 THEN 6 ELSE 4 END"""
_FAR = ", ".join(
    "{'d': " + " + ".join(f"pow(({f} - {m}) / {s + 1e-10!r} - ({p} - {m}) / {s + 1e-10!r}, 2)" for f, m, s, p in zip(("bb_position", "atr_ratio", "ema_alignment"), regimes.SCALER_MEAN, regimes.SCALER_SCALE, c, strict=True)) + f", 'i': {i}, 'r': {r}}}"
    for i, (c, r) in enumerate(zip(regimes.CENTROIDS, regimes.CLUSTER_REGIME, strict=True))
)
_V3 = f"CASE WHEN bb_position IS NULL OR atr_ratio IS NULL OR ema_alignment IS NULL THEN 4 ELSE list_min([{_FAR}]).r END"
_V1 = """CASE WHEN adx >= 35 AND di_spread > 15 THEN 3 WHEN adx >= 35 AND di_spread < -15 THEN 2 WHEN atr_pct >= 0.65 AND di_spread < -5 THEN 1
    WHEN atr_pct <= 0.35 AND di_spread < -5 THEN 5 WHEN atr_pct <= 0.35 AND di_spread > 5 THEN 6 ELSE 4 END"""


@register(f"WITH RECURSIVE {FEATURES} SELECT series_id, ts, ({_V1})::INT AS v1, ({_V2})::INT AS v2, ({_V3})::INT AS v3 FROM feat")
def regime_classes(spark, d):
    return features(spark, d).select("series_id", "ts", regimes.rules().alias("v1"), regimes.rules_v2().alias("v2"), regimes.nearest_centroid().cast("int").alias("v3"))


@register(f"WITH RECURSIVE {FEATURES}, st AS (SELECT series_id, ts, {', '.join(c for c in indicators.STUDY_FEATURES if c != 'price_vs_ema200')}, (close - ema200) / (atr_raw + 1e-10) AS price_vs_ema200 FROM feat) SELECT series_id, ts, round(COLUMNS(* EXCLUDE (series_id, ts)), 6) FROM st WHERE {' AND '.join(f'{c} IS NOT NULL' for c in indicators.STUDY_FEATURES)}")
def study_features(spark, d):
    return rounded(indicators.study_features(hourly(spark, d)))


def classified(spark: SparkSession, d: str) -> DataFrame:
    s = features(spark, d)
    return s.withColumns({"regime": regimes.rules_v2(), "fwd": rolling.lead(F.col("close")) / F.nullif("close", F.lit(0.0)) - 1})


CLASSED = f"{FEATURES}, cls AS (SELECT *, ({_V2})::INT AS regime, lead(close) OVER ({W}) / nullif(close, 0) - 1 AS fwd FROM feat)"


@register(f"WITH RECURSIVE {CLASSED} SELECT series_id, ts, regime, [{', '.join(repr(n) for n in regimes.REGIME_NAMES)}][regime] AS name, [{', '.join(repr(n) for n in regimes.REGIME_ACTIONS)}][regime] AS action FROM cls")
def regime_lookup(spark, d):
    r = F.col("regime")
    return classified(spark, d).select("series_id", "ts", "regime", regimes.lookup(r, regimes.REGIME_NAMES).alias("name"), regimes.lookup(r, regimes.REGIME_ACTIONS).alias("action"))


@register(f"WITH RECURSIVE {CLASSED}, g AS (SELECT regime, count(*) AS bars FROM cls WHERE bb_position IS NOT NULL GROUP BY 1) SELECT regime, bars, round(bars / sum(bars) OVER (), 6) AS share FROM g")
def regime_distribution(spark, d):
    return rounded(regimes.distribution(classified(spark, d)))


@register(f"""WITH RECURSIVE {CLASSED}, g AS (SELECT regime, count(fwd) AS bars, avg(fwd) AS mean, stddev_samp(fwd) AS std FROM cls WHERE fwd IS NOT NULL GROUP BY 1)
    SELECT regime, bars, round(mean, 6) AS mean, round(std, 6) AS std, round(mean / (std + 1e-10) * sqrt(1512.0), 6) AS sharpe FROM g""")  # fmt: skip
def regime_stats(spark, d):
    return rounded(regimes.forward_statistics(classified(spark, d), "fwd"))


@register(f"""WITH RECURSIVE {CLASSED}, p AS (SELECT regime, lead(regime) OVER ({W}) AS next FROM cls), g AS (SELECT regime, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY 1, 2)
    SELECT regime, next, round(n / sum(n) OVER (PARTITION BY regime), 3) AS share FROM g""")  # fmt: skip
def transition_matrix(spark, d):
    return regimes.transitions(classified(spark, d))


_RUNS = f"""mark AS (SELECT series_id, ts, regime, coalesce((regime <> lag(regime) OVER ({W}))::INT, 1) AS new FROM cls),
    num AS (SELECT *, sum(new) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM mark), runs AS (SELECT series_id, regime, run, count(*) AS length FROM num GROUP BY ALL)"""


@register(f"WITH RECURSIVE {CLASSED}, {_RUNS} SELECT regime, round(avg(length), 6) AS mean, round(quantile_cont(length, 0.5), 6) AS median, max(length) AS longest, round(stddev_samp(length), 6) AS std FROM runs GROUP BY 1")
def regime_runs(spark, d):
    return rounded(regimes.persistence(classified(spark, d)))


@register(f"WITH RECURSIVE {CLASSED} SELECT series_id, ts, regime, round(sum(coalesce(fwd, 0)) OVER (PARTITION BY series_id, regime ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS cum_return FROM cls")
def cumulative_return(spark, d):
    return rounded(regimes.cumulative_returns(classified(spark, d), "fwd").select("series_id", "ts", "regime", "cum_return"))


@register(f"""WITH RECURSIVE {CLASSED}, g AS (SELECT regime, avg(adx) AS adx, avg(di_spread) AS di_spread, avg(atr_pct) AS atr_pct FROM cls GROUP BY 1)
    SELECT regime, round(adx, 6) AS adx, round(di_spread, 6) AS di_spread, round(atr_pct, 6) AS atr_pct, CASE WHEN adx > 25 AND di_spread > 5 THEN 'STRONG UPTREND' WHEN adx > 25 AND di_spread < -5 THEN 'STRONG DOWNTREND'
    WHEN adx > 20 AND di_spread > 0 THEN 'MILD UPTREND' WHEN adx > 20 AND di_spread < 0 THEN 'MILD DOWNTREND' WHEN atr_pct > 0.6 THEN 'HIGH VOLATILITY RANGE' WHEN atr_pct < 0.4 THEN 'LOW VOLATILITY RANGE'
    ELSE 'MIXED/TRANSITION' END AS typology FROM g""")  # fmt: skip
def regime_typology(spark, d):
    return rounded(regimes.typology(classified(spark, d)))


# --- labels ---------------------------------------------------------------------------------------------------------

_FRI = "(isodow(ts) = 5 AND hour(ts) >= 20)"
_POS = f"pos AS (SELECT *, row_number() OVER ({W}) AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM {{source}})"
_AFTER = f"OVER ({W} ROWS BETWEEN {{k}} FOLLOWING AND UNBOUNDED FOLLOWING)"


def oracle_h_sql(source: str = "bars") -> str:
    nxt = f"min(CASE WHEN {_FRI} THEN pos END) {_AFTER.format(k=1)}"
    return f"{_POS.format(source=source)}, hz AS (SELECT *, (CASE WHEN {_FRI} THEN 0 WHEN coalesce({nxt} - pos, n - pos) = 0 THEN 120 ELSE coalesce({nxt} - pos, n - pos) END)::INT AS horizon FROM pos)"


def direction_h_sql(source: str = "bars") -> str:
    a, b = f"min(CASE WHEN {_FRI} THEN pos END) {_AFTER.format(k=1)}", f"min(CASE WHEN isodow(ts) = 1 THEN pos END) {_AFTER.format(k=2)}"
    return f"{_POS.format(source=source)}, hz AS (SELECT *, coalesce(least({a}, {b}) - pos, greatest(n - pos, 120))::INT AS horizon FROM pos)"


def touch_sql(side: str, target: str, stop: str) -> str:
    hit_t, hit_s = ("f.close >= ", "f.low <= ") if side == "buy" else ("f.close <= ", "f.high >= ")
    at = lambda c: f"(SELECT min(f.pos) FROM hz f WHERE f.series_id = b.series_id AND f.pos > b.pos AND f.pos <= b.pos + b.horizon AND {c})"
    t, s = at(hit_t + target), at(hit_s + stop)
    return f"(coalesce({t}, 1000000000) < coalesce({s}, 999999999))::INT"


@register(f"WITH {bars_sql()}, {oracle_h_sql()} SELECT series_id, ts, horizon FROM hz")
def oracle_horizon(spark, d):
    return labels.oracle_horizon(hourly(spark, d)).select("series_id", "ts", "horizon")


@register(f"WITH {bars_sql()}, {direction_h_sql()} SELECT series_id, ts, horizon FROM hz")
def direction_horizon(spark, d):
    return labels.direction_horizon(hourly(spark, d)).select("series_id", "ts", "horizon")


COSTS = labels.Costs(pip=PIP)
_F, _N, _B = (131.325 + COSTS.points) * PIP, 131.325 * PIP, 93.33 * PIP


@register(f"""WITH {bars_sql()}, {oracle_h_sql()} SELECT series_id, ts, {touch_sql('buy', f'b.close + {_F!r}', f'b.close - {_B!r}')} AS buy_entry_label, {touch_sql('sell', f'b.close - {_F!r}', f'b.close + {_B!r}')} AS sell_entry_label,
    {touch_sql('buy', f'b.close + {_N!r}', f'b.close - {_B!r}')} AS buy_exit_label, {touch_sql('sell', f'b.close - {_N!r}', f'b.close + {_B!r}')} AS sell_exit_label, horizon AS bars_to_friday FROM hz b""")  # fmt: skip
def oracle_labels(spark, d):
    return labels.oracle_labels(hourly(spark, d), costs=COSTS).drop("open", "high", "low", "close")


DCOSTS = labels.Costs(15.0, 5.0, 7.0, PIP)
_E = repr(DCOSTS.points * PIP)


@register(f"""WITH RECURSIVE {bars_sql()}, t AS (SELECT *, {TR} AS tr FROM bars), {wilder_sql('atr', 't', 'tr', 14)}, a AS (SELECT * FROM {join_sql('t', 'atr')}), {direction_h_sql('a')}
    SELECT series_id, ts, CASE WHEN atr > 0 AND pos < n THEN {touch_sql('buy', f'b.close + 2.0 * b.atr + {_E}', 'b.close - 1.0 * b.atr')}::DOUBLE END AS direction_long_label,
    CASE WHEN atr > 0 AND pos < n THEN {touch_sql('sell', f'b.close - 2.0 * b.atr - {_E}', 'b.close + 1.0 * b.atr')}::DOUBLE END AS direction_short_label FROM hz b""")  # fmt: skip
def direction_labels(spark, d):
    return labels.direction_labels(hourly(spark, d), costs=DCOSTS).drop("open", "high", "low", "close")


@register(f"""WITH {bars_sql('4 hours')} SELECT series_id, ts, (CASE WHEN isodow(ts) < 5 THEN (5 - isodow(ts)) * 6 + greatest(0, (20 - hour(ts)) // 4) WHEN isodow(ts) = 5 THEN greatest(0, (20 - hour(ts)) // 4) ELSE 0 END)::INT AS bars_to_friday FROM bars""")
def bars_to_friday(spark, d):
    return bars.resample(hourly(spark, d), 4 * HOUR).select("series_id", "ts", labels.bars_to_friday().alias("bars_to_friday"))


SLICES = [("d1", "2024-01-01 12:00:00", "2024-01-08 00:00:00"), ("d2", "2024-01-08 04:00:00", "2024-01-14 16:00:00")]
_CUT = ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in SLICES)


@register(f"""WITH {bars_sql()}, sl(name, a, b) AS (VALUES {_CUT}), e AS (SELECT bars.*, name, b, sum((ts > b)::INT) OVER (PARTITION BY series_id, name ORDER BY ts) AS after FROM bars JOIN sl ON ts >= a),
    cut AS (SELECT series_id AS sid, name AS slice, b, series_id || '|' || name AS series_id, ts, high, low, close FROM e WHERE after <= 24), {oracle_h_sql('cut')}
    SELECT sid AS series_id, slice, ts, horizon AS bars_to_friday, {touch_sql('buy', f'b.close + {_F!r}', f'b.close - {_B!r}')} AS buy_entry_label FROM hz b WHERE ts <= b.b""")  # fmt: skip
def label_slices(spark, d):
    made = labels.date_slices(hourly(spark, d), SLICES, 24, lambda s: labels.oracle_labels(s, costs=COSTS))
    return made.select("series_id", "slice", "ts", "bars_to_friday", "buy_entry_label")


@register(f"WITH {bars_sql()}, p AS (SELECT series_id, ts, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM bars) SELECT series_id, ts, CASE WHEN i <= floor(n * 0.6) THEN 'd1' WHEN i <= floor(n * 0.8) THEN 'd2' ELSE 'd3' END AS split FROM p")
def chrono_split(spark, d):
    return labels.chronological_split(hourly(spark, d)).select("series_id", "ts", "split")


@register(f"WITH {bars_sql()}, {oracle_h_sql()}, l AS (SELECT {touch_sql('buy', f'b.close + {_F!r}', f'b.close - {_B!r}')} AS x FROM hz b) SELECT 'buy_entry_label' AS \"column\", sum(x)::DOUBLE AS positives, count(x) AS n, round(avg(x), 6) AS ratio FROM l")
def label_counts(spark, d):
    return rounded(stats.label_counts(labels.oracle_labels(hourly(spark, d), costs=COSTS), "buy_entry_label"))


# --- alignment ------------------------------------------------------------------------------------------------------


def observations(spark: SparkSession, d: str) -> DataFrame:
    """All events as observations of their own series, the last one by id at each time."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("series_id"), "ts").agg(F.max_by("value", "event_id").alias("value"))


def all_bars(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).select("series_id", "ts", "close")


_ALL = f"{bars_sql()}, obs AS (SELECT event_type AS series_id, ts, last(value ORDER BY event_id) AS value FROM events GROUP BY 1, 2)"
_SLOTS = "e AS (SELECT series_id, time_bucket(INTERVAL '15 minutes', min(ts)) AS a, time_bucket(INTERVAL '15 minutes', max(ts)) AS b FROM obs GROUP BY 1)"


@register(f"""WITH {_ALL}, e AS (SELECT series_id, time_bucket(INTERVAL '1 day', max(ts)) AS last FROM obs GROUP BY 1),
    k AS (SELECT series_id, ts, close, least(time_bucket(INTERVAL '1 day', ts), last) AS at FROM bars JOIN e USING (series_id))
    SELECT k.series_id, k.ts, round(k.close, 6) AS close, round(coalesce(o.value, 0), 6) AS value FROM k ASOF LEFT JOIN obs o ON k.series_id = o.series_id AND k.at >= o.ts""")  # fmt: skip
def asof_align(spark, d):
    return rounded(align.resampled_as_of(all_bars(spark, d), observations(spark, d), DAY, "value"))


@register(f"WITH {_ALL} SELECT k.series_id, k.ts, round(coalesce(o.value, -1), 6) AS value FROM bars k ASOF LEFT JOIN obs o ON k.series_id = o.series_id AND k.ts >= o.ts")
def asof_plain(spark, d):
    s = align.as_of(all_bars(spark, d), observations(spark, d), "value")
    return rounded(s.select("series_id", "ts", F.coalesce("value", F.lit(-1.0)).alias("value")))


_TICKS = ", ".join(
    f"t{i} AS (SELECT k.series_id, k.ts, CASE WHEN k.at BETWEEN k.a AND k.b THEN round(o.value, 6) END AS tick_{i} FROM (SELECT bars.*, a, b, bars.ts - INTERVAL '{15 * i} minutes' AS at FROM bars JOIN e USING (series_id)) k ASOF LEFT JOIN obs o ON k.series_id = o.series_id AND k.at >= o.ts)"
    for i in range(1, 4)
)


@register(f"WITH {_ALL}, {_SLOTS}, {_TICKS} SELECT series_id, ts, round(close, 6) AS close, tick_1, tick_2, tick_3 FROM bars JOIN t1 USING (series_id, ts) JOIN t2 USING (series_id, ts) JOIN t3 USING (series_id, ts)")
def shifted_ticks(spark, d):
    return rounded(align.shifted_ticks(all_bars(spark, d), observations(spark, d), 900, "value", 3))


@register(f"WITH {bars_sql()}, e AS (SELECT series_id, ts, high FROM bars WHERE high > 100) SELECT b.series_id, b.ts, round(b.close, 6) AS close, round(coalesce(e.high, -1), 6) AS spike FROM bars b LEFT JOIN e USING (series_id, ts)")
def calendar_exact_align(spark, d):
    b = hourly(spark, d)
    return rounded(align.exact(b.select("series_id", "ts", "close"), b.where("high > 100").withColumnRenamed("high", "spike"), "spike", fill=-1.0))


@register(f"WITH {bars_sql()}, a AS (SELECT series_id, ts, high FROM bars WHERE high > 80), c AS (SELECT series_id, ts, low FROM bars WHERE low < 10) SELECT series_id, ts, round(high, 6) AS high, round(low, 6) AS low FROM a FULL JOIN c USING (series_id, ts)")
def outer_align(spark, d):
    b = hourly(spark, d)
    return rounded(align.outer(b.where("high > 80").select("series_id", "ts", "high"), b.where("low < 10").select("series_id", "ts", "low")))


@register("""WITH a AS (SELECT max(s) AS start_ts, min(e) AS end_ts FROM (SELECT event_type, min(ts) AS s, max(ts) AS e FROM events GROUP BY 1)) SELECT event_id, ts FROM events, a WHERE ts BETWEEN start_ts AND end_ts""")
def common_range(spark, d):
    e = table(spark, d, "events")
    kinds = ("click", "signup", "purchase", "error", "view")
    limits = align.common_range(*(e.where(F.col("event_type") == k) for k in kinds))
    return align.within(e, limits).select("event_id", "ts")


@register("""WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS row_pos FROM supplier), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS row_pos FROM customer)
    SELECT row_pos, coalesce(s_suppkey, -1) AS s_suppkey, c_custkey FROM a FULL JOIN b USING (row_pos)""")
def positional_concat(spark, d):
    a = align.numbered(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
    b = align.numbered(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    return align.positional(a, b).select("row_pos", F.coalesce("s_suppkey", F.lit(-1).cast("long")).alias("s_suppkey"), "c_custkey")


@register(f"""WITH {bars_sql()}, e AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1), g AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL '1 hour')) AS ts FROM e)
    SELECT g.series_id, g.ts, round(b.close, 6) AS close FROM g ASOF LEFT JOIN bars b ON g.series_id = b.series_id AND g.ts >= b.ts""")  # fmt: skip
def upsample_ffill(spark, d):
    b = hourly(spark, d)
    return rounded(align.as_of(bars.dense_grid(b, HOUR), b, "close"))


# --- statistics -----------------------------------------------------------------------------------------------------

_COLS = ("open", "high", "low", "close")


def each_sql(expr: str, source: str = "bars", cols: tuple[str, ...] = _COLS) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {expr.format(c=c)} FROM {source}" for c in cols)


@register(f"WITH {bars_sql()} {each_sql('round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max')}")
def column_stats(spark, d):
    return rounded(stats.column_stats(hourly(spark, d), *_COLS))


_SKEW = "(avg(pow({c} - m, 3))) / pow(avg(pow({c} - m, 2)), 1.5)"


@register(f"WITH {bars_sql()} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(stddev_pop({c}), 6) AS std_pop, round({_SKEW.format(c=c)}, 6) AS skew, round(kurtosis_pop({c}), 6) AS kurt FROM bars, (SELECT avg({c}) AS m FROM bars)" for c in _COLS))
def moments(spark, d):
    return rounded(stats.moments(hourly(spark, d), *_COLS).drop("k2", "p_value"))


_K2 = """m AS (SELECT *, skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
        (kurt + 6 / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS x,
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM g),
    t AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS a FROM m),
    z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS r FROM t),
    k AS (SELECT "column", pow(z1, 2) + pow((1 - 2 / (9 * a) - sign(r) * pow(abs(r), 1 / 3.0)) / sqrt(2 / (9 * a)), 2) AS k2 FROM z)"""


@register(f"WITH {bars_sql()}, g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c})::DOUBLE AS n, {_SKEW.format(c=c)} AS skew, kurtosis_pop({c}) AS kurt FROM bars, (SELECT avg({c}) AS m FROM bars)" for c in _COLS) + f'), {_K2} SELECT "column", round(k2, 4) AS k2, round(exp(-k2 / 2), 6) AS p_value FROM k')
def normality_k2(spark, d):
    return stats.moments(hourly(spark, d), *_COLS).select("column", F.round("k2", 4).alias("k2"), F.round("p_value", 6).alias("p_value"))


@register()
def normality_shapiro(spark, d):
    return rounded(stats.shapiro(hourly(spark, d), *_COLS))


@register(f"WITH {bars_sql()} {each_sql('count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max')}")
def describe(spark, d):
    return rounded(stats.describe(hourly(spark, d), *_COLS))


@register(f"""WITH {bars_sql()}, v AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, {c} AS value FROM bars" for c in _COLS)}),
    e AS (SELECT c, min(value) AS a, max(value) AS b, stddev_samp(value) * pow(count(*), -0.2) AS h, count(*) AS n, (max(value) - min(value)) / 500 AS width FROM v GROUP BY 1),
    bins AS (SELECT c, least(floor((value - a) / width), 499) AS bin, count(*) AS m FROM v JOIN e USING (c) GROUP BY 1, 2),
    grid AS (SELECT *, a + (b - a) * i / 49 AS x FROM e, range(50) AS r(i))
    SELECT c AS "column", round(x, 6) AS x, round(sum(exp(-pow((x - a - (bin + 0.5) * width) / h, 2) / 2) * m / (n * h * sqrt(2 * pi()))), 6) AS density FROM bins JOIN grid USING (c) GROUP BY c, x""")
def density(spark, d):
    return rounded(stats.density(hourly(spark, d), *_COLS, points=50))


@register(f"WITH {bars_sql()} {each_sql('round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75')}")
def quantiles(spark, d):
    return rounded(stats.quantiles(hourly(spark, d), *_COLS))


@register(f"WITH {bars_sql()}, s AS (SELECT series_id, ts, (close - avg(close) OVER ()) / stddev_samp(close) OVER () AS close, (high - avg(high) OVER ()) / stddev_samp(high) OVER () AS high FROM bars) {final('s')}")
def zscore(spark, d):
    return rounded(stats.z_score(hourly(spark, d).select("series_id", "ts", "close", "high"), "close", "high"))


@register(f"WITH {bars_sql()}, m AS (SELECT avg(close) AS m, stddev_samp(close) AS s FROM bars WHERE ts < TIMESTAMP '2024-01-15'), s AS (SELECT series_id, ts, (close - m) / s AS close FROM bars, m) {final('s')}")
def zscore_train_fit(spark, d):
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return rounded(stats.z_score(hourly(spark, d).select("series_id", "ts", "close"), "close", fit=F.col("ts") < cut))


@register(f"WITH {bars_sql()}, s AS (SELECT series_id, ts, (close - min(close) OVER ()) / (max(close) OVER () - min(close) OVER ()) AS close FROM bars) {final('s')}")
def minmax(spark, d):
    return rounded(stats.min_max(hourly(spark, d).select("series_id", "ts", "close"), "close"))


@register(f"WITH {bars_sql()} SELECT series_id, ts, round(close, 6) AS close FROM bars")
def minmax_inverse(spark, d):
    b = hourly(spark, d).select("series_id", "ts", "close")
    return rounded(stats.min_max_inverse(stats.min_max(b, "close"), b, "close"))


@register(f"WITH {bars_sql()}, q AS (SELECT quantile_cont(close, 0.25) AS l, quantile_cont(close, 0.75) AS h FROM bars), s AS (SELECT series_id, ts, least(greatest(close, l - 1.5 * (h - l)), h + 1.5 * (h - l)) AS close FROM bars, q) {final('s')}")
def iqr_cap(spark, d):
    return rounded(stats.cap_outliers(hourly(spark, d).select("series_id", "ts", "close"), "close"))


def gappy(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).select("series_id", "ts", F.when(F.col("close") > 20, F.col("close")).alias("a"))


_GAPPY = f"{bars_sql()}, gap AS (SELECT series_id, ts, {_NULLED} AS a FROM bars)"


@register(f"WITH {_GAPPY}, s AS (SELECT series_id, ts, coalesce(a, avg(a) OVER ()) AS a FROM gap) {final('s')}")
def fill_mean(spark, d):
    return rounded(stats.fill_mean(gappy(spark, d), "a"))


@register(f"WITH {_GAPPY}, m AS (SELECT median(a) AS m FROM gap), s AS (SELECT series_id, ts, coalesce(a, m) AS a FROM gap, m) {final('s')}")
def fill_median(spark, d):
    return rounded(stats.fill_median(gappy(spark, d), "a"))


@register(f"""WITH {_GAPPY}, s AS (SELECT series_id, ts, coalesce(last_value(a IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING),
    first_value(a IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS a FROM gap) {final('s')}""")  # fmt: skip
def ffill_bfill(spark, d):
    return rounded(stats.fill_both_ways(gappy(spark, d), "a"))


@register(f"""WITH {_GAPPY}, f AS (SELECT series_id, ts, coalesce(a, avg(a) OVER ()) AS a FROM gap), g AS (SELECT series_id, ts, a, b.close AS close FROM f JOIN bars b USING (series_id, ts)),
    s AS ({each_sql('stddev_samp({c}) / abs(CASE WHEN abs(avg({c})) > 1e-8 THEN avg({c}) ELSE 1e-8 END) AS cv', 'g', ('a', 'close'))})
    SELECT "column", round(cv, 6) AS cv, CASE WHEN cv > (SELECT quantile_cont(cv, 0.5) FROM s) THEN 'High' ELSE 'Low' END AS variability FROM s""")  # fmt: skip
def variability(spark, d):
    g = gappy(spark, d).join(hourly(spark, d).select("series_id", "ts", "close"), ["series_id", "ts"])
    return rounded(stats.variability(g, "a", "close"))


_LOGGED = "WITH {b}, v AS ({u}), lo AS (SELECT \"column\", min(value) AS low FROM v GROUP BY 1), w AS (SELECT \"column\", low, value, ln(CASE WHEN low <= 0 THEN value - low + 1 ELSE value END) AS lg FROM v JOIN lo USING (\"column\")), m AS (SELECT \"column\", avg(value) AS mv, avg(lg) AS ml FROM w GROUP BY 1), g AS (SELECT \"column\", any_value(low) AS low, abs(avg(pow(value - mv, 3)) / pow(avg(pow(value - mv, 2)), 1.5)) + abs(kurtosis_pop(value)) AS plain_score, abs(avg(pow(lg - ml, 3)) / pow(avg(pow(lg - ml, 2)), 1.5)) + abs(kurtosis_pop(lg)) AS log_score FROM w JOIN m USING (\"column\") GROUP BY 1)"


@register(
    _LOGGED.format(b=bars_sql(), u=" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {e} AS value FROM bars" for c, e in (("close", "close"), ("move", "close - open"))))
    + ' SELECT "column", round(low, 6) AS low, round(plain_score, 6) AS plain_score, round(log_score, 6) AS log_score, log_score < plain_score AS use_log FROM g'
)
def log_transform_choice(spark, d):
    b = hourly(spark, d).withColumn("move", F.col("close") - F.col("open"))
    return rounded(stats.log_choice(b, "close", "move"))


@register(f"WITH {bars_sql()} SELECT series_id, ts, round(ln(close), 6) AS close FROM bars")
def log_transform(spark, d):
    return rounded(stats.log_transform(hourly(spark, d).select("series_id", "ts", "close"), "close"))


_PAIRS = [(a, b) for i, a in enumerate(sorted(_COLS)) for b in sorted(_COLS)[i:]]


@register(f"WITH {bars_sql()} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM bars" for a, b in _PAIRS))
def corr_pearson(spark, d):
    return rounded(stats.correlations(hourly(spark, d), *_COLS))


_RANKS = "rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in _COLS) + " FROM bars)"


@register(f"WITH {bars_sql()}, {_RANKS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM rk" for a, b in _PAIRS))
def corr_spearman(spark, d):
    return rounded(stats.spearman(hourly(spark, d), *_COLS))


@register(f"WITH {bars_sql()}, c AS ({each_sql('corr({c}, close) AS corr', cols=('open', 'high', 'low'))}) SELECT \"column\", round(corr, 6) AS corr FROM c WHERE abs(corr) >= 0.5")
def feature_selection(spark, d):
    return rounded(stats.select_features(hourly(spark, d), "close", "open", "high", "low", least=0.5))


@register(f"WITH {bars_sql()}, p AS (SELECT close, lag(close) OVER ({W}) AS guess FROM bars) SELECT round(avg(pow(guess - close, 2)), 6) AS mse, round(avg(abs(guess - close)), 6) AS mae, count(guess - close) AS n FROM p")
def mse_mae(spark, d):
    b = hourly(spark, d)
    return rounded(stats.errors(b.withColumn("guess", rolling.lag(F.col("close"))), "close", "guess"))


@register(f"WITH {bars_sql()}, e AS (SELECT min(close) AS a, max(close) AS b FROM bars) SELECT 'close' AS \"column\", least(floor((close - a) / (b - a) * 20), 19)::INT AS bin, count(*) AS n FROM bars, e GROUP BY 2")
def histogram(spark, d):
    return stats.histogram(hourly(spark, d), "close")


# --- calendars, windows, encodings ------------------------------------------------------------------------------------


def calendar(spark: SparkSession, d: str) -> DataFrame:
    """``error`` and ``signup`` events as calendar entries; the value makes the importance, the user the country."""
    e = table(spark, d, "events").where("event_type IN ('error', 'signup')")
    level = F.when(F.col("value") > 60, "High").when(F.col("value") > 20, "Moderate").otherwise("Low")
    text = F.concat(F.col("value").cast("decimal(10,2)").cast("string"), F.when(F.col("user_id") % 3 == 0, "K").otherwise(""))
    return e.select(
        "event_id", F.lit("c").alias("series_id"), bars.bucket(F.col("ts"), HOUR).alias("ts"), F.concat(level, F.lit(" Volatility Expected ")).alias("volatility"),
        F.when(F.col("user_id") % 4 == 0, "United States").otherwise("Euro Zone").alias("country"), F.col("event_type").alias("description"),
        F.when(F.col("user_id") % 7 != 0, text).alias("actual"), F.concat(F.col("user_id").cast("string"), F.lit(",000")).alias("forecast"), F.col("user_id").cast("string").alias("previous"),
    )


_CAL = """cal AS (SELECT event_id, 'c' AS series_id, time_bucket(INTERVAL '1 hour', ts) AS ts, CASE WHEN value > 60 THEN 3 WHEN value > 20 THEN 2 ELSE 1 END AS importance,
    CASE WHEN user_id % 4 = 0 THEN 'United States' ELSE 'Euro Zone' END AS country, event_type AS description, CASE WHEN user_id % 7 <> 0 THEN round(value, 2) END AS actual, user_id * 1000.0::DOUBLE AS forecast, user_id::DOUBLE AS previous
    FROM events WHERE event_type IN ('error', 'signup'))"""


@register(f"WITH {_CAL}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY importance DESC, (country = 'United States') DESC, event_id) AS k FROM cal) SELECT event_id, ts, importance::INT AS importance, country FROM r WHERE k = 1")
def dedupe_top1(spark, d):
    c = calendar(spark, d).withColumn("importance", events.importance(F.col("volatility")))
    return events.one_per_time(c, importance="importance", country="country", preferred="UNITED STATES", tie="event_id").select("event_id", "ts", "importance", "country")


def _scaled(c: str) -> str:
    return f"round(coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0), 6) AS {c}"


@register(f"""WITH {_CAL}, f AS (SELECT *, actual - forecast AS forecast_diff, actual - previous AS previous_diff, (actual - forecast) * importance AS volatility_weighted_diff FROM cal WHERE actual IS NOT NULL)
    SELECT event_id, importance::INT AS importance, {', '.join(_scaled(c) for c in ('actual', 'forecast', 'previous', 'forecast_diff', 'volatility_weighted_diff'))}, round(previous_diff, 6) AS previous_diff,
    (dense_rank() OVER (ORDER BY country) - 1)::INT AS country, (dense_rank() OVER (ORDER BY description) - 1)::INT AS description FROM f""")  # fmt: skip
def calendar_encode(spark, d):
    s = events.encode_calendar(calendar(spark, d))
    return rounded(s.select("event_id", "importance", "actual", "forecast", "previous", "forecast_diff", "volatility_weighted_diff", "previous_diff", "country", "description"))


@register(f"""WITH {bars_sql()}, w AS (SELECT series_id, ts, list([high, low, close]) OVER ({W} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS w, row_number() OVER ({W}) AS p, count(*) OVER (PARTITION BY series_id) AS n FROM bars)
    SELECT series_id, ts, len(w)::INT AS n_rows, round(list_sum(list_transform(w, lambda r: r[1])), 6) AS high_sum, round(w[8][3], 6) AS last_close FROM w WHERE p <= n - 8""")  # fmt: skip
def sliding_windows(spark, d):
    s = events.sliding_windows(hourly(spark, d), 8, "high", "low", "close")
    total = F.aggregate(F.transform("window", lambda r: r[0]), F.lit(0.0), lambda a, x: a + x)
    return rounded(s.select("series_id", "ts", F.size("window").alias("n_rows"), total.alias("high_sum"), F.col("window")[7][2].alias("last_close")))


@register(f"""WITH {bars_sql()}, r AS (SELECT k.series_id, k.ts, o.value, row_number() OVER (PARTITION BY k.series_id, k.ts ORDER BY o.ts DESC, o.event_id DESC) AS i FROM bars k JOIN events o ON o.event_type = k.series_id AND o.ts <= k.ts),
    g AS (SELECT series_id, ts, max(CASE WHEN i = 1 THEN value END) AS t1, max(CASE WHEN i = 3 THEN value END) AS t3 FROM r WHERE i <= 3 GROUP BY 1, 2)
    SELECT series_id, ts, round(t1, 6) AS newest, round(t3, 6) AS oldest FROM bars LEFT JOIN g USING (series_id, ts)""")  # fmt: skip
def previous_ticks(spark, d):
    t = table(spark, d, "events").select(F.col("event_type").alias("series_id"), "ts", "value", F.col("event_id").alias("tick_id"))
    s = events.previous_ticks(all_bars(spark, d), t, "value", 3)
    return rounded(s.select("series_id", "ts", F.col("ticks")[2].alias("newest"), F.col("ticks")[0].alias("oldest")))


def _capped(c: str) -> str:
    q = lambda p: f"(SELECT quantile_cont({c}, {p}) FROM bf)"
    return f"least(greatest({c}, {q(0.25)} - 1.5 * ({q(0.75)} - {q(0.25)})), {q(0.75)} + 1.5 * ({q(0.75)} - {q(0.25)})) AS {c}"


@register(f"""WITH {bars_sql()}, r AS (SELECT series_id, ts, {agg_sql('avg', 'close', 25)} AS trend, {agg_sql('stddev_samp', 'close', 25)} AS volatility FROM bars),
    bf AS (SELECT series_id, ts, first_value(trend IGNORE NULLS) OVER w AS trend, first_value(volatility IGNORE NULLS) OVER w AS volatility FROM r WINDOW w AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    cp AS (SELECT series_id, ts, {_capped('trend')}, {_capped('volatility')} FROM bf)
    SELECT series_id, ts, {_scaled('trend')}, {_scaled('volatility')} FROM cp""")  # fmt: skip
def training_signals(spark, d):
    return rounded(events.training_signals(hourly(spark, d), "close").select("series_id", "ts", "trend", "volatility"))


def _signal(name: str, source: str, n: int) -> str:
    """Scaled trend and volatility of ``source`` (series_id, ts, close), as CTEs that end in ``name``."""
    cap = lambda c: f"least(greatest({c}, q.{c}_a - 1.5 * (q.{c}_b - q.{c}_a)), q.{c}_b + 1.5 * (q.{c}_b - q.{c}_a)) AS {c}"
    ends = ", ".join(f"quantile_cont({c}, {p}) AS {c}_{k}" for c in ("trend", "volatility") for k, p in (("a", 0.25), ("b", 0.75)))
    return f"""{name}_r AS (SELECT series_id, ts, {agg_sql('avg', 'close', n)} AS trend, {agg_sql('stddev_samp', 'close', n)} AS volatility FROM {source}),
    {name}_f AS (SELECT series_id, ts, first_value(trend IGNORE NULLS) OVER w AS trend, first_value(volatility IGNORE NULLS) OVER w AS volatility FROM {name}_r WINDOW w AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    {name}_q AS (SELECT {ends} FROM {name}_f), {name}_c AS (SELECT series_id, ts, {cap('trend')}, {cap('volatility')} FROM {name}_f, {name}_q q),
    {name} AS (SELECT series_id, ts, {_scaled('trend')}, {_scaled('volatility')} FROM {name}_c)"""


_LOOK = f"({W} ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING)"


@register(f"""WITH {bars_sql()}, {_CAL}, f AS (SELECT *, (actual - forecast) AS forecast_diff FROM cal WHERE actual IS NOT NULL),
    g AS (SELECT *, {_scaled('forecast_diff')}, (actual - min(actual) OVER ()) / (max(actual) OVER () - min(actual) OVER ()) AS scaled_actual, (importance - min(importance) OVER ()) / (max(importance) OVER () - min(importance) OVER ()) AS volatility FROM (SELECT * FROM f)),
    r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY importance DESC, (country = 'United States') DESC, event_id) AS k FROM g),
    inside AS (SELECT b.series_id, b.ts, b.close, coalesce(r.scaled_actual, -1) AS actual, coalesce(r.volatility, -1) AS volatility, (r.ts IS NOT NULL)::INT AS event FROM bars b LEFT JOIN r ON r.ts = b.ts AND r.k = 1 WHERE b.ts BETWEEN (SELECT min(ts) FROM g) AND (SELECT max(ts) FROM g)),
    {_signal('sig', 'inside', 5)}, w AS (SELECT series_id, ts, count(*) OVER {_LOOK} AS n, sum(event) OVER {_LOOK} AS events, sum(actual) OVER {_LOOK} AS actual_sum, sum(volatility) OVER {_LOOK} AS volatility_sum FROM inside)
    SELECT w.series_id, w.ts, events::INT AS events, round(actual_sum, 6) AS actual_sum, round(volatility_sum, 6) AS volatility_sum, trend, volatility FROM w JOIN sig USING (series_id, ts) WHERE n = 25""")  # fmt: skip
def calendar_windows(spark, d):
    s = events.calendar_windows(hourly(spark, d), calendar(spark, d), window=25, divisor=5, preferred="UNITED STATES", tie="event_id")
    total = lambda i: F.aggregate(F.transform("window", lambda r: r[i]), F.lit(0.0), lambda a, x: a + x)
    at = events.CALENDAR_ROW.index
    return rounded(s.select("series_id", "ts", total(at("event")).cast("int").alias("events"), total(at("actual")).alias("actual_sum"), total(at("volatility")).alias("volatility_sum"), "trend", "volatility"))


@register()
def economic_calendar(spark, d):
    return events.process_calendar(hourly(spark, d), calendar(spark, d), window=25, divisor=5)


_WAVE = ", ".join(
    f"CASE WHEN w IS NOT NULL THEN round(2 / 32.0 * sqrt(pow(list_sum(list_transform(list_zip(w, {[math.cos(2 * math.pi * k * j / 32) for j in range(32)]}), lambda p: p[1] * p[2])), 2) + pow(list_sum(list_transform(list_zip(w, {[math.sin(2 * math.pi * k * j / 32) for j in range(32)]}), lambda p: p[1] * p[2])), 2)), 6) END AS fft_{k}"
    for k in (1, 2)
)


@register(f"WITH {bars_sql()}, l AS (SELECT series_id, ts, CASE WHEN count(close) OVER {frame(32)} = 32 THEN list(close) OVER {frame(32)} END AS w FROM bars) SELECT series_id, ts, {_WAVE} FROM l")
def window_spectrum(spark, d):
    return rounded(spectral.fourier(hourly(spark, d).select("series_id", "ts", "close"), "close", 32, 2).drop("close"))


@register()
def singular_spectrum(spark, d):
    return rounded(spectral.singular_spectrum(hourly(spark, d).select("series_id", "ts", "close")).drop("close"))


_ENC = ", ".join(f"round({'cos' if i % 2 else 'sin'}(p / {10000.0 ** (2 * (i // 2) / 4)!r}), 6) AS pos_enc_{i}" for i in range(4))


@register(f"WITH {bars_sql()}, p AS (SELECT series_id, ts, row_number() OVER ({W}) - 1 AS p FROM bars) SELECT series_id, ts, {_ENC} FROM p")
def positional_encoding(spark, d):
    b = hourly(spark, d).select("series_id", "ts").withColumn("p", rolling.position() - 1)
    return rounded(events.positional_encoding(b, "p", 4).drop("p"))


@register(f"WITH {bars_sql()} SELECT series_id, ts, day(ts)::INT AS day_of_month, hour(ts)::INT AS hour_of_day, (isodow(ts) - 1)::INT AS day_of_week FROM bars")
def seasonality(spark, d):
    return events.seasonality(hourly(spark, d).select("series_id", "ts"))


#: Rows of the clustering sample, the lowest by hash.
SAMPLE = 5000


@register(f"""WITH s AS (SELECT s_suppkey, s_acctbal, s_nationkey FROM supplier ORDER BY md5(s_suppkey::VARCHAR) LIMIT {SAMPLE}),
    f AS (SELECT p.s_suppkey AS id, s.s_nationkey % 3 AS label, row_number() OVER (PARTITION BY p.s_suppkey ORDER BY pow(p.s_acctbal - s.s_acctbal, 2), s.s_nationkey % 3) AS k FROM supplier p, s),
    v AS (SELECT id, label, count(*) AS n FROM f WHERE k <= 5 GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM v) SELECT id, label::INT AS label FROM w WHERE r = 1""")
def knn_labels(spark, d):
    s = table(spark, d, "supplier")
    sample = s.orderBy(F.md5(F.col("s_suppkey").cast("string").cast("binary"))).limit(SAMPLE).select("s_acctbal", (F.col("s_nationkey") % 3).alias("label"))
    return events.nearest_labels(s.select(F.col("s_suppkey").alias("id"), "s_acctbal"), sample, ("s_acctbal",), "label", max_sample=SAMPLE).select("id", "label")


@register(f"""WITH RECURSIVE {CLASSED} SELECT regime, count(*) AS bars, round(avg(fwd), 6) AS mean_fwd, round(avg(adx), 6) AS adx FROM cls GROUP BY 1""")
def flagship(spark, d):
    """Ticks to bars, features, regimes, and what followed each regime."""
    return rounded(classified(spark, d).groupBy("regime").agg(F.count(F.lit(1)).alias("bars"), F.avg("fwd").alias("mean_fwd"), F.avg("adx").alias("adx")))


# --- models (no SQL) --------------------------------------------------------------------------------------------------


@register()
def window_regression(spark, d):
    from .operators.models import WindowRegressor

    s = events.training_signals(hourly(spark, d), "close").dropna(subset=["trend", "volatility"])
    w = events.sliding_windows(s, 8, "high", "low", "close")
    r = WindowRegressor()
    return r.predict(r.fit(w), w).select("series_id", "ts", "predicted_trend", "predicted_volatility")


@register()
def pca_clusters(spark, d):
    from .operators import models

    names = ("atr_ratio", "adx", "rsi", "bb_position", "ema_alignment", "stoch_k", "roc_12")
    s = features(spark, d).dropna(subset=list(names))
    projected, _ = models.principal_components(models.standardise(s, *names), 6)
    return models.clusters(projected, 5).select("series_id", "ts", "cluster")

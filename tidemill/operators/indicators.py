"""Technical indicators over bars (series_id, ts, open, high, low, close). Lengths are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from . import recursive as rec
from . import rolling as roll


def c(name: str) -> Column:
    return F.col(name)


def true_range() -> Column:
    """The largest of the bar's range and its reach from the last close; the range alone for the first bar."""
    before = roll.lag(c("close"))
    return F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))


def directional_moves() -> tuple[Column, Column]:
    """(+DM, -DM): only the larger one is kept, on a tie -DM; the first bar has 0 and null."""
    up = fn.clip_low(c("high") - roll.lag(c("high")), 0.0)
    down = fn.clip_low(roll.lag(c("low")) - c("low"), 0.0)
    plus = F.when(up > down, up).otherwise(F.lit(0.0))
    minus = F.when(F.coalesce(up > down, F.lit(False)), F.lit(0.0)).otherwise(down)
    return plus, minus


def gain_loss() -> tuple[Column, Column]:
    d = c("close") - roll.lag(c("close"))
    return fn.clip_low(d, 0.0), fn.clip_low(-d, 0.0)


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's average true range, seeded by the mean of the first ``n``."""
    return rec.smooth(df.withColumn("tr", true_range()), [rec.wilder("tr", "atr", n)])


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    gain, loss = gain_loss()
    s = rec.smooth(df.withColumns({"gain": gain, "loss": loss}), [rec.wilder("gain", "avg_gain", n), rec.wilder("loss", "avg_loss", n)])
    return s.withColumn("rsi", 100 - 100 / (1 + c("avg_gain") / (c("avg_loss") + fn.EPS)))


def ema(df: DataFrame, n: int = 20) -> DataFrame:
    """``ema`` of the close, from its first value on."""
    return rec.smooth(df, [rec.span("close", "ema", n)])


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    s = rec.smooth(df, [rec.span("close", "ema_fast", fast), rec.span("close", "ema_slow", slow)]).withColumn("macd", c("ema_fast") - c("ema_slow"))
    return rec.smooth(s, [rec.span("macd", "macd_signal", signal)]).withColumn("macd_hist", c("macd") - c("macd_signal"))


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    plus, minus = directional_moves()
    s = df.withColumns({"tr": true_range(), "plus_dm": plus, "minus_dm": minus})
    s = rec.smooth(s, [rec.wilder("tr", "s_tr", n), rec.wilder("plus_dm", "s_plus", n), rec.wilder("minus_dm", "s_minus", n)])
    s = s.withColumns({"plus_di": 100 * fn.divide(c("s_plus"), c("s_tr")), "minus_di": 100 * fn.divide(c("s_minus"), c("s_tr"))})
    s = s.withColumn("dx", 100 * F.abs(c("plus_di") - c("minus_di")) / (c("plus_di") + c("minus_di") + fn.EPS))
    return rec.smooth(s, [rec.wilder("dx", "adx", n)])


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    mid, sd = roll.mean(c("close"), n), roll.std(c("close"), n)
    return df.withColumns({"bb_mid": mid, "bb_upper": mid + width * sd, "bb_lower": mid - width * sd})


def stochastic(df: DataFrame, k: int = 14, smooth: int = 3, d: int = 3) -> DataFrame:
    low, high = roll.minimum(c("low"), k), roll.maximum(c("high"), k)
    s = df.withColumn("raw_k", 100 * (c("close") - low) / (high - low + fn.EPS)).withColumn("stoch_k", roll.mean(c("raw_k"), smooth))
    return s.withColumn("stoch_d", roll.mean(c("stoch_k"), d))


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    s = df.withColumn("tp", (c("high") + c("low") + c("close")) / 3)
    return s.withColumn("cci", (c("tp") - roll.mean(c("tp"), n)) / (0.015 * roll.mean_deviation(c("tp"), n) + fn.EPS))


def williams_r(df: DataFrame, n: int = 14) -> DataFrame:
    low, high = roll.minimum(c("low"), n), roll.maximum(c("high"), n)
    return df.withColumn("williams_r", -100 * (high - c("close")) / (high - low + fn.EPS))


def change_by(df: DataFrame, n: int = 10) -> DataFrame:
    return df.withColumn("momentum", c("close") - roll.lag(c("close"), n))


def rate_of_change(df: DataFrame, n: int = 10) -> DataFrame:
    return df.withColumn("roc", 100 * roll.change(c("close"), n))


def momentum(df: DataFrame, n: int = 10) -> DataFrame:
    return rate_of_change(change_by(df, n), n)


REGIME_FEATURES = (
    "atr_raw", "atr_pct", "atr_ratio", "plus_di", "minus_di", "adx", "di_spread", "rsi", "bb_mid", "bb_upper", "bb_lower",
    "bb_width_pct", "bb_position", "ema50", "ema200", "price_vs_ema50", "ema_alignment", "roc_12", "stoch_k", "macd_hist",
)


#: The study's features: what describes the state of the market, with the price against the slow mean.
STUDY_FEATURES = ("adx", "di_spread", "atr_pct", "atr_ratio", "bb_width_pct", "bb_position", "rsi", "roc_12", "price_vs_ema50", "price_vs_ema200", "ema_alignment", "stoch_k", "macd_hist")


def study_features(bars: DataFrame, *, rank: int = 120) -> DataFrame:
    """The study's features of the bars that have them all."""
    s = regime_features(bars, rank=rank).withColumn("price_vs_ema200", (c("close") - c("ema200")) / (c("atr_raw") + fn.EPS))
    return s.select("series_id", "ts", *STUDY_FEATURES).dropna(subset=list(STUDY_FEATURES))


def regime_features(bars: DataFrame, *, rank: int = 120) -> DataFrame:
    """The features that the regime classifiers use: two recursive passes, one set of windows."""
    eps = fn.EPS
    plus, minus = directional_moves()
    gain, loss = gain_loss()
    s = bars.withColumns({"tr": true_range(), "plus_dm": plus, "minus_dm": minus, "gain": gain, "loss": loss})
    s = rec.smooth(
        s,
        [rec.span("tr", "e_tr", 14), rec.span("plus_dm", "e_plus", 14), rec.span("minus_dm", "e_minus", 14), rec.span("gain", "e_gain", 14), rec.span("loss", "e_loss", 14)]
        + [rec.span("close", f"ema{n}", n) for n in (12, 26, 50, 200)],
    )
    s = s.withColumns({"plus_di": 100 * c("e_plus") / F.nullif(c("e_tr"), F.lit(0.0)), "minus_di": 100 * c("e_minus") / F.nullif(c("e_tr"), F.lit(0.0)), "macd": c("ema12") - c("ema26")})
    s = s.withColumn("dx", 100 * F.abs(c("plus_di") - c("minus_di")) / (c("plus_di") + c("minus_di") + eps))
    s = rec.smooth(s, [rec.span("dx", "adx", 14), rec.span("macd", "macd_signal", 9)])
    mid, sd = roll.mean(c("close"), 20), roll.std(c("close"), 20)
    low, high = roll.minimum(c("low"), 14), roll.maximum(c("high"), 14)
    s = s.withColumns({"atr_raw": roll.mean(c("tr"), 14), "atr_long": roll.mean(c("tr"), 60), "bb_mid": mid, "bb_upper": mid + 2 * sd, "bb_lower": mid - 2 * sd})
    s = s.withColumns({"bb_width": (c("bb_upper") - c("bb_lower")) / (c("bb_mid") + eps)})
    s = s.withColumns(
        {
            "atr_pct": roll.percent_rank(c("atr_raw"), rank),
            "atr_ratio": c("atr_raw") / (c("atr_long") + eps),
            "di_spread": c("plus_di") - c("minus_di"),
            "rsi": 100 - 100 / (1 + c("e_gain") / (c("e_loss") + eps)),
            "bb_width_pct": roll.percent_rank(c("bb_width"), rank),
            "bb_position": (c("close") - c("bb_lower")) / (c("bb_upper") - c("bb_lower") + eps),
            "price_vs_ema50": (c("close") - c("ema50")) / (c("atr_raw") + eps),
            "ema_alignment": (c("ema50") - c("ema200")) / (c("atr_raw") + eps),
            "roc_12": 100 * roll.change(c("close"), 12),
            "stoch_k": 100 * (c("close") - low) / (high - low + eps),
            "macd_hist": (c("macd") - c("macd_signal")) / (c("atr_raw") + eps),
        }
    )
    return s.select("series_id", "ts", "open", "high", "low", "close", *REGIME_FEATURES)


def derived(df: DataFrame, *, pip: float = 1e-5, target: float = 131.325) -> DataFrame:
    """Typical-price spread and distance, ATR ratio, band width and position, cyclic time; needs atr, bb_upper and bb_lower."""
    s = df.withColumn("tp", (c("high") + c("low") + c("close")) / 3)
    s = rec.smooth(s, [rec.span("tp", "tp_ema", 24)])
    hs, hc = fn.cyclic(F.hour("ts").cast("double"), 24)
    ds, dc = fn.cyclic(F.weekday("ts").cast("double"), 7)
    return s.withColumns(
        {
            "bb_width": c("bb_upper") - c("bb_lower"),
            "atr_ratio": F.lit(target) / F.nullif(c("atr") / pip, F.lit(0.0)),
            "bb_position": fn.divide(c("close") - c("bb_lower"), c("bb_upper") - c("bb_lower")),
            "rolling_std_24": roll.std(c("tp"), 24),
            "price_minus_ema": c("tp") - c("tp_ema"),
            "hod_sin": hs, "hod_cos": hc, "dow_sin": ds, "dow_cos": dc,
        }
    )

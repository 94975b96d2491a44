"""Stages, their registry, configuration and the feature pipeline. Parameters reach the stages."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields, replace
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import align, bars, events, indicators, labels, regimes, spectral, stats


@dataclass(frozen=True)
class Dataset:
    """Another series that is brought to the bars: which columns, and how.

    ``plain``: the last row at or before each bar, missing values become ``fill``; ``grid``: the last value on a grid of ``seconds``
    (0 before the first); ``ticks``: ``n`` columns of the grid's values, 1 to n slots before; ``exact``: the row of the same time.
    """

    frame: DataFrame
    columns: tuple[str, ...] = ("close",)
    how: str = "plain"
    seconds: int = 86400
    n: int = 3
    fill: float = -1.0
    prefix: str = ""

    def onto(self, spine: DataFrame, name: str) -> DataFrame:
        """series_id, ts and this set's columns, called ``<name>_<column>``, for every bar of the spine."""
        named = {c: f"{self.prefix or name}_{c}" for c in self.columns}
        right = self.frame.select("series_id", "ts", *(F.col(c).cast("double").alias(n) for c, n in named.items()))
        out = spine.select("series_id", "ts")
        if self.how == "plain":
            return align.as_of(out, right, *named.values()).fillna(self.fill, subset=list(named.values()))
        if self.how == "exact":
            return align.exact(out, right, *named.values(), fill=self.fill)
        for c in named.values():
            one = right.select("series_id", "ts", c)
            if self.how == "grid":
                out = align.resampled_as_of(out, one, self.seconds, c, fill=0.0)
            elif self.how == "ticks":
                out = align.shifted_ticks(out, one, self.seconds, c, self.n).withColumnsRenamed({f"tick_{i}": f"{c}_{i}" for i in range(1, self.n + 1)})
            else:
                raise ValueError(f"a data set is brought to the bars as plain, grid, ticks or exact, not as {self.how}")
        return out


def aligned_datasets(df: DataFrame, others: dict[str, Dataset], *, seasons: bool = True) -> dict[str, DataFrame]:
    """Outputs by name, all over the range that bars and data sets have in common: each set brought to the bars, ``hourly`` (bars
    with their spreads), ``seasonality`` and ``merged``."""
    limits = align.common_range(df, *(o.frame for o in others.values()))
    spine = align.within(df, limits)
    outputs = {name: o.onto(spine, name) for name, o in others.items()}
    hourly = bars.spreads(spine).drop("volume")
    merged = hourly
    for o in outputs.values():
        merged = merged.join(o, ["series_id", "ts"], "left")
    if seasons:
        outputs["seasonality"] = events.seasonality(hourly.select("series_id", "ts"))
        merged = events.seasonality(merged)
    return outputs | {"hourly": hourly, "merged": merged}


def write_outputs(outputs: dict[str, DataFrame], folder: str, *, format: str = "parquet") -> dict[str, str]:
    """Each named output to ``<folder>/<name>_aligned``; gives the places."""
    places = {name: f"{folder.rstrip('/')}/{name}_aligned" for name in outputs}
    for name, out in outputs.items():
        sources.write(out, places[name], format=format)
    return places


class Stage:
    """A step from bars to more columns. Subclasses are frozen dataclasses whose fields are the parameters."""

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def with_params(self, **params) -> Stage:
        """A copy with other parameters; an unknown one is an error."""
        unknown = set(params) - {f.name for f in fields(self)}
        if unknown:
            raise TypeError(f"{type(self).__name__} has no parameters {sorted(unknown)}")
        return replace(self, **params)

    def params(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def debug_info(self, out: DataFrame | None = None) -> dict:
        """The parameters, and the columns of a result."""
        return self.params() | ({} if out is None else {"output_columns": out.columns})

    def add_debug_info(self, info: dict, out: DataFrame | None = None) -> None:
        info.update(self.debug_info(out))

    def additional_datasets(self, df: DataFrame, others: dict[str, Dataset]) -> dict[str, DataFrame]:
        """Named outputs of the bars and other data sets; see :func:`aligned_datasets`."""
        return aligned_datasets(df, others)


INDICATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rsi": indicators.rsi, "macd": indicators.macd, "ema": indicators.ema, "stoch": indicators.stochastic, "adx": indicators.adx, "atr": indicators.atr,
    "cci": indicators.cci, "bbands": indicators.bollinger, "williams": indicators.williams_r, "momentum": indicators.change_by, "roc": indicators.rate_of_change,
}
#: Further names that a configuration may use.
ALIASES = {"willr": "williams", "mom": "momentum"}


@dataclass(frozen=True)
class TechnicalIndicators(Stage):
    indicators: tuple[str, ...] = tuple(INDICATORS)

    def transform(self, df: DataFrame) -> DataFrame:
        for name in self.indicators:
            before = set(df.columns)
            made = INDICATORS[ALIASES.get(name, name)](df)
            df = made.drop(*(c for c in ("gain", "loss", "avg_gain", "avg_loss", "tr", "dx", "s_tr", "s_plus", "s_minus", "plus_dm", "minus_dm", "raw_k", "tp", "ema_fast", "ema_slow") if c not in before))
        return df


@dataclass(frozen=True)
class OracleLabels(Stage):
    tp_pips: float = 131.325
    sl_pips: float = 93.33
    spread_pips: float = 30.0
    commission_per_lot: float = 10.0
    slippage_pips: float = 10.0
    pip_cost: float = 1e-5
    friday_close_hour: int = 20
    prediction_horizon: int = 120

    def transform(self, df: DataFrame) -> DataFrame:
        costs = labels.Costs(self.spread_pips, self.slippage_pips, self.commission_per_lot, self.pip_cost)
        return labels.oracle_labels(df, take=self.tp_pips, stop=self.sl_pips, costs=costs, hour=self.friday_close_hour, fallback=self.prediction_horizon)


@dataclass(frozen=True)
class DirectionLabels(Stage):
    atr_period: int = 14
    tp_mult: float = 2.0
    sl_mult: float = 1.0
    spread_pips: float = 15.0
    commission_per_lot: float = 7.0
    slippage_pips: float = 5.0
    pip_cost: float = 1e-5
    friday_close_hour: int = 20
    prediction_horizon: int = 120

    def transform(self, df: DataFrame) -> DataFrame:
        costs = labels.Costs(self.spread_pips, self.slippage_pips, self.commission_per_lot, self.pip_cost)
        return labels.direction_labels(df, n=self.atr_period, take=self.tp_mult, stop=self.sl_mult, costs=costs, hour=self.friday_close_hour, fallback=self.prediction_horizon)


@dataclass(frozen=True)
class Regimes(Stage):
    version: int = 3
    rank: int = 120

    def transform(self, df: DataFrame) -> DataFrame:
        column = {1: regimes.rules, 2: regimes.rules_v2, 3: regimes.nearest_centroid}[self.version]()
        return indicators.regime_features(df, rank=self.rank).withColumn("regime", column)


@dataclass(frozen=True)
class Seasons(Stage):
    def transform(self, df: DataFrame) -> DataFrame:
        return events.seasonality(bars.spreads(df))


@dataclass(frozen=True)
class Fourier(Stage):
    """Amplitudes of the first frequencies of a sliding window; its regressor is ``models.WindowRegressor``."""

    column: str = "close"
    n: int = 32
    kept: int = 4

    def transform(self, df: DataFrame) -> DataFrame:
        return spectral.fourier(df, self.column, self.n, self.kept)


@dataclass(frozen=True)
class SingularSpectrum(Stage):
    """Trend and share of power of the strongest components of a sliding window; its regressor is ``models.WindowRegressor``."""

    column: str = "close"
    n: int = 32
    lag: int = 8
    kept: int = 2

    def transform(self, df: DataFrame) -> DataFrame:
        return spectral.singular_spectrum(df, self.column, self.n, self.lag, self.kept)


STAGES: dict[str, type[Stage]] = {
    "default": TechnicalIndicators, "tech_indicator": TechnicalIndicators, "technical_indicator": TechnicalIndicators,
    "oracle_labels": OracleLabels, "direction_labels": DirectionLabels, "regimes": Regimes, "seasonality": Seasons,
    "fft": Fourier, "ssa": SingularSpectrum,
}
GROUP = "tidemill.stages"


def load_stage(name: str) -> type[Stage]:
    """A stage class by name, from here or from an installed package's entry points; ImportError if there is none."""
    if name in STAGES:
        return STAGES[name]
    for e in entry_points(group=GROUP):
        if e.name == name:
            return e.load()
    raise ImportError(f"Stage {name} not found in group {GROUP}.")


@dataclass(frozen=True)
class Config:
    input_file: str = ""
    output_file: str = ""
    input_kind: str = "hourly"
    plugin: str = "default"
    output_format: str = "parquet"
    fill_price: float | None = None
    distribution: bool = True
    include_bars: bool = True
    params: dict = field(default_factory=dict)


def parse_value(text: str) -> int | float | str:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def merge_config(defaults: Config, stage: dict, file: dict, cli: dict) -> Config:
    """Defaults, then the stage's parameters, the file, the command line; what is no field of Config is a stage parameter."""
    names = {f.name for f in fields(Config)} - {"params"}
    known: dict = {}
    params = dict(stage)
    for layer in (file, cli):
        known |= {k: v for k, v in layer.items() if k in names}
        params |= {k: v for k, v in layer.items() if k not in names and k != "params"} | layer.get("params", {})
    return replace(defaults, **known, params={**defaults.params, **params})


def parse_args(argv: Sequence[str]) -> tuple[dict, str | None]:
    """Given options only, unknown ones typed by their look; and the config's place."""
    p = argparse.ArgumentParser("tidemill")
    p.add_argument("--load_config")
    for f in fields(Config):
        if f.name != "params":
            p.add_argument(f"--{f.name}", default=argparse.SUPPRESS)
    known, rest = p.parse_known_args(list(argv))
    got = {k: parse_value(v) if k == "fill_price" else v == "True" if k in ("distribution", "include_bars") else v for k, v in vars(known).items()}
    where = got.pop("load_config", None)
    for k, v in zip(rest[::2], rest[1::2], strict=False):
        got[k.lstrip("-")] = parse_value(v)
    return got, where


def process(spark: SparkSession, config: Config, *others: DataFrame) -> DataFrame:
    """Read, derive, choose logarithms, align the other frames to the bars and trim to the common range: one lazy plan."""
    df = sources.read_csv(spark, config.input_file, config.input_kind)
    if config.fill_price is not None:
        df = df.fillna(config.fill_price, subset=list(bars.PRICES))
    stage = load_stage(config.plugin)()
    out = stage.with_params(**config.params).transform(df)
    made = [f.name for f in out.schema if f.name not in ("series_id", "ts", *bars.PRICES) and f.dataType.simpleString() == "double"]
    if config.distribution and isinstance(stage, TechnicalIndicators) and made:
        out = stats.log_transform(out, *made)
    if not config.include_bars:
        out = out.drop(*bars.PRICES)
    if others:
        limits = align.common_range(out, *others)
        out = align.within(out, limits)
        for o in others:
            columns = [c for c in o.columns if c not in ("series_id", "ts")]
            out = align.as_of(out, o, *columns).fillna(-1.0, subset=columns)
    return out


def main(argv: Sequence[str]) -> dict:
    """Run the pipeline from the command line; gives back what it logs."""
    began = time.time()
    cli, where = parse_args(argv)
    config = merge_config(Config(), {}, sources.load_config(where) if where else {}, cli)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = process(spark, config)
    sources.write(out, config.output_file, format=config.output_format)
    return {"execution_time": time.time() - began, "columns": out.columns}

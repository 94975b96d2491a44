"""Operators against plain loops and by their invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from tidemill.operators import align, bars, events, indicators, labels, regimes, stats
from tidemill.operators import recursive as rec

HOUR = 3600


def frame(spark, **cols):
    p = pd.DataFrame({"series_id": "a", **cols})
    df = spark.createDataFrame(p)
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in df.dtypes if k == "double"})


def walk(n, seed=0, start="2024-01-01"):
    rng = np.random.default_rng(seed)
    close = 100 + rng.normal(size=n).cumsum()
    open_ = np.r_[close[0], close[:-1]]
    reach = np.abs(rng.normal(size=(2, n)))
    return {"ts": pd.date_range(start, periods=n, freq="h"), "open": open_, "high": np.maximum(open_, close) + reach[0], "low": np.minimum(open_, close) - reach[1], "close": close}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(float("nan")), st.floats(-100, 100)), min_size=1, max_size=60), st.integers(1, 5), st.integers(1, 20))
def test_blocks_of_a_recursion_compose(x, seed, size):
    s = rec.Smooth("x", "y", 0.3, seed)
    x = np.array(x)
    whole, _ = rec.run(s, x, rec.START)
    state, got = rec.START, []
    for i in range(0, len(x), size):
        part = x[i : i + size]
        got.append(rec.run(s, part, state)[0])
        state = rec.advance(s, state, rec.summary(s, part))
    np.testing.assert_allclose(np.concatenate(got), whole, rtol=1e-9, atol=1e-9)


def test_smoothing_equals_pandas_with_gaps(spark):
    w = walk(300)
    w["close"][[0, 1, 50, 51, 200]] = np.nan
    out = rec.smooth(frame(spark, **w), [rec.span("close", "e", 12)], block_seconds=40 * HOUR).toPandas().sort_values("ts")
    np.testing.assert_allclose(out.e, pd.Series(w["close"]).ewm(span=12, adjust=False).mean(), rtol=1e-12)


def test_missing_observation_weakens_by_its_gap():
    y, _ = rec.run(rec.span("x", "y", 3), np.array([1, 2, np.nan, 4.0]), rec.START)
    np.testing.assert_allclose(y, [1, 1.5, 1.5, 3.1666666667])


def test_indicator_invariants(spark):
    p = indicators.regime_features(frame(spark, **walk(400)), rank=50).toPandas().sort_values("ts")
    assert p.rsi.dropna().between(0, 100).all() and p.atr_pct.dropna().between(0, 1).all() and (p.atr_pct.dropna() > 0).all()
    assert p.atr_raw.first_valid_index() is not None and p.atr_raw.isna().sum() == 13


def test_features_do_not_look_ahead(spark):
    w = walk(200)
    later = {k: v.copy() for k, v in w.items() if k != "ts"} | {"ts": w["ts"]}
    for k in ("open", "high", "low", "close"):
        later[k][150:] += 50
    a, b = (indicators.regime_features(frame(spark, **x), rank=30).toPandas().sort_values("ts").head(150) for x in (w, later))
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))


def test_constant_price(spark):
    n = 60
    p = indicators.stochastic(indicators.bollinger(frame(spark, ts=pd.date_range("2024-01-01", periods=n, freq="h"), **{c: [5.0] * n for c in bars.PRICES}))).toPandas()
    assert np.isfinite(p.stoch_k.dropna()).all() and (p.bb_upper.dropna() == 5.0).all()


def test_tie_of_moves_keeps_the_downward_one(spark):
    w = {"ts": pd.date_range("2024-01-01", periods=2, freq="h"), "open": [10.0, 10], "high": [11.0, 12], "low": [9.0, 8], "close": [10.0, 10]}
    plus, minus = indicators.directional_moves()
    r = frame(spark, **w).select("ts", plus.alias("p"), minus.alias("m")).orderBy("ts").collect()
    assert (r[0].p, r[0].m, r[1].p, r[1].m) == (0.0, None, 0.0, 1.0)


def scan(w, i, h, target, stop, side):
    for j in range(i + 1, min(i + 1 + h, len(w["close"]))):
        if side == "buy":
            if w["low"][j] <= stop:
                return 0
            if w["close"][j] >= target:
                return 1
        else:
            if w["high"][j] >= stop:
                return 0
            if w["close"][j] <= target:
                return 1
    return 0


def test_oracle_labels_equal_a_loop(spark):
    w = walk(260, seed=3)
    costs = labels.Costs(3.0, 1.0, 1.0, 0.01)
    p = labels.oracle_labels(frame(spark, **w), take=150, stop=120, costs=costs).toPandas().sort_values("ts").reset_index(drop=True)
    closes = [t.weekday() == 4 and t.hour >= 20 for t in w["ts"]]
    n = len(closes)
    for i in range(n):
        h = 0 if closes[i] else next((j - i for j in range(i + 1, n) if closes[j]), n - 1 - i) or 120
        assert p.bars_to_friday[i] == h
        c = w["close"][i]
        far, near, back = (150 + costs.points) * 0.01, 1.5, 1.2
        want = (scan(w, i, h, c + far, c - back, "buy"), scan(w, i, h, c - far, c + back, "sell"), scan(w, i, h, c + near, c - back, "buy"), scan(w, i, h, c - near, c + back, "sell"))
        assert tuple(p.loc[i, ["buy_entry_label", "sell_entry_label", "buy_exit_label", "sell_exit_label"]]) == want


def test_direction_horizon_takes_the_second_monday_bar(spark):
    w = walk(200, seed=5)
    p = labels.direction_horizon(frame(spark, **w)).toPandas().sort_values("ts").reset_index(drop=True)
    n = len(p)
    for i, t in enumerate(w["ts"]):
        want = next((j - i for j in range(i + 1, n) if (w["ts"][j].weekday() == 4 and w["ts"][j].hour >= 20) or (w["ts"][j].weekday() == 0 and j > i + 1)), max(n - 1 - i, 120))
        assert p.horizon[i] == want, t


def test_resampled_as_of_example(spark):
    t = lambda s: pd.Timestamp(f"2024-01-01 {s}")
    obs = frame(spark, ts=[t(x) for x in ("00:15", "00:45", "01:00", "01:20", "02:50")], v=[1.0, 2, 3, 4, 5])
    spine = frame(spark, ts=[t(x) for x in ("00:30", "01:30", "02:59", "05:00")])
    got = {r.ts.strftime("%H:%M"): r.v for r in align.resampled_as_of(spine, obs, HOUR, "v").collect()}
    assert got == {"00:30": 0, "01:30": 3, "02:59": 4, "05:00": 4}


def test_regime_of_unknown_features_is_neutral(spark):
    df = spark.sql("SELECT double(null) bb_position, 1.0D atr_ratio, 1.0D ema_alignment, double(null) adx, 20.0D di_spread, 0.9D atr_pct")
    r = df.select(regimes.rules().alias("a"), regimes.rules_v2().alias("b"), regimes.nearest_centroid().alias("c")).first()
    assert tuple(r) == (4, 4, 4)


def test_centroids_map_to_their_own_regime(spark):
    df = spark.createDataFrame([(*c, r) for c, r in zip(regimes.CENTROIDS, regimes.CLUSTER_REGIME, strict=True)], "bb_position double, atr_ratio double, ema_alignment double, r int")
    assert all(r.r == r.g for r in df.withColumn("g", regimes.nearest_centroid()).collect())


def test_log_transform_shifts_negative_values(spark):
    df = frame(spark, ts=pd.date_range("2024-01-01", periods=5, freq="h"), x=[-1.0, 0, 1, 10, 1000])
    got = sorted(r.x for r in stats.log_transform(df, "x").collect())
    np.testing.assert_allclose(got, np.log(np.array([-1.0, 0, 1, 10, 1000]) + 2))


def test_normality_statistic_of_normal_data_is_small(spark):
    x = np.random.default_rng(0).normal(size=3000)
    r = stats.moments(frame(spark, ts=pd.date_range("2024-01-01", periods=3000, freq="h"), x=x, y=np.exp(x)), "x", "y").collect()
    k2 = {q["column"]: q.k2 for q in r}
    assert k2["x"] < 15 < 100 < k2["y"]


def test_average_ranks_of_ties(spark):
    df = frame(spark, ts=pd.date_range("2024-01-01", periods=6, freq="h"), x=[3.0, 1, 2, 2, 9, 2])
    assert sorted(r.x for r in stats.average_ranks(df, "x").select("x").collect()) == [1, 3, 3, 3, 5, 6]


@pytest.mark.parametrize(("n", "w", "last", "want"), [(5, 3, True, 3), (5, 3, False, 2), (2, 3, True, 0), (3, 3, True, 1)])
def test_sliding_window_counts(spark, n, w, last, want):
    df = frame(spark, ts=pd.date_range("2024-01-01", periods=n, freq="h"), x=np.arange(n, dtype=float))
    assert events.sliding_windows(df, w, "x", include_last=last).count() == want


def test_positional_encoding_wants_an_even_width(spark):
    with pytest.raises(ValueError, match="even"):
        events.positional_encoding(spark.range(1), "id", 3)


def test_calendar_numbers(spark):
    df = spark.createDataFrame([("1,234k",), (" 5.5 ",), ("-",), (None,)], "t string")
    assert [r[0] for r in df.select(events.number(F.col("t"))).collect()] == [1234.0, 5.5, None, None]


def test_empty_series(spark):
    df = frame(spark, **walk(3)).limit(0)
    assert labels.oracle_labels(df).count() == 0 and indicators.regime_features(df).count() == 0


def test_numbering_is_gapless(spark):
    got = sorted(r.row_pos for r in align.numbered(spark.range(1000).repartition(7), "id").collect())
    assert got == list(range(1, 1001))


def test_perfect_circle_of_hours(spark):
    from tidemill import functions as fn

    s, c = fn.cyclic(F.lit(6.0), 24)
    r = spark.range(1).select(s.alias("s"), c.alias("c")).first()
    assert math.isclose(r.s, 1) and abs(r.c) < 1e-9

"""First touches against a loop, smoothing without loops, spectra, regressors, clusters, calendars, streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill import plans, queries, streaming
from tidemill.operators import events, labels, models, recursive, spectral

SF = "/root/testdata/sf0.001"


def walk(spark, n, freq="h", seed=0, series="a"):
    r = np.random.default_rng(seed)
    close = 100 + np.cumsum(r.normal(size=n))
    p = pd.DataFrame({"series_id": series, "ts": pd.date_range("2024-01-01", periods=n, freq=freq), "open": close, "high": close + r.random(n), "low": close - r.random(n), "close": close})
    return spark.createDataFrame(p).withColumn("ts", F.col("ts").cast("timestamp_ntz")), p


@pytest.mark.parametrize(("freq", "n"), [("h", 900), ("4h", 300), ("D", 60)])
def test_oracle_labels_equal_a_loop(spark, freq, n):
    df, p = walk(spark, n, freq)
    got = labels.oracle_labels(df, take=20.0, stop=15.0, costs=labels.Costs(1.0, 1.0, 0.0, 0.1)).toPandas().sort_values("ts").reset_index(drop=True)
    far, near, back = (20 + 2) * 0.1, 20 * 0.1, 15 * 0.1
    friday = ((p.ts.dt.weekday == 4) & (p.ts.dt.hour >= 20)).to_numpy()
    for i in range(n):
        later = np.flatnonzero(friday[i + 1 :])
        h = 0 if friday[i] else int(later[0]) + 1 if len(later) else n - 1 - i or 120
        assert got.bars_to_friday[i] == h

        def first(ok, i=i, h=h):
            hit = np.flatnonzero(ok[i + 1 : i + 1 + h])
            return hit[0] if len(hit) else np.inf

        c = p.close[i]
        for name, t, s in (
            ("buy_entry_label", p.close >= c + far, p.low <= c - back),
            ("sell_entry_label", p.close <= c - far, p.high >= c + back),
            ("buy_exit_label", p.close >= c + near, p.low <= c - back),
            ("sell_exit_label", p.close <= c - near, p.high >= c + back),
        ):
            assert got[name][i] == int(first(t.to_numpy()) < first(s.to_numpy())), (name, i)


@pytest.mark.parametrize("above", [True, False])
def test_touch_distance_equals_a_loop(above):
    r = np.random.default_rng(5)
    v, limit = r.normal(size=200).cumsum(), r.normal(size=200).cumsum()
    v[[3, 50]], limit[[7, 90]] = np.nan, np.nan
    last = np.minimum(np.arange(200) + r.integers(0, 60, 200), 199)
    want = []
    for i in range(200):
        hit = [j - i for j in range(i + 1, last[i] + 1) if (v[j] >= limit[i] if above else v[j] <= limit[i])]
        want.append(hit[0] if hit else 0)
    assert labels.touch_distance(v, limit, last, above).tolist() == want


@pytest.mark.parametrize("seed", [1, 4])
@pytest.mark.parametrize("cuts", [(), (10, 11, 40), (1, 2, 3, 90)])
def test_smoothing_equals_a_loop(seed, cuts):
    s = recursive.Smooth("x", "y", 0.3, seed)
    r = np.random.default_rng(seed)
    x = np.where(r.random(120) < 0.25, np.nan, r.normal(size=120))
    y, gap, seen, total, want = np.nan, 0, 0, 0.0, []
    for v in x:
        if np.isnan(v):
            gap += 1
        else:
            if seen + 1 < seed:
                total += v
            elif seen < seed:
                y = (total + v) / seed
            else:
                w = 0.7 ** (gap + 1)
                y = (w * y + 0.3 * v) / (w + 0.3)
            seen, gap = min(seen + 1, seed), 0
        want.append(y)
    state, folded, out = recursive.START, recursive.START, []
    for part in np.split(x, cuts):
        got, state = recursive.run(s, part, state)
        folded = recursive.advance(s, folded, recursive.summary(s, part))
        np.testing.assert_allclose(folded, state)
        out.append(got)
    np.testing.assert_allclose(np.concatenate(out), want)


def test_spectra_of_a_wave(spark):
    t = np.arange(200)
    p = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=200, freq="h"), "close": 5 + 3 * np.sin(2 * np.pi * t * 2 / 32)})
    df = spark.createDataFrame(p).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    f = spectral.fourier(df, n=32, kept=3).toPandas().sort_values("ts")
    assert f.fft_2[:31].isna().all()
    np.testing.assert_allclose(f[["fft_1", "fft_2", "fft_3"]].to_numpy(float)[31:], np.tile([0, 3, 0], (169, 1)), atol=1e-9)
    s = spectral.singular_spectrum(df, n=32, lag=8, kept=3).toPandas().sort_values("ts")
    np.testing.assert_allclose(s.ssa_trend.to_numpy(float)[31:], p.close[31:], atol=1e-9)
    assert s.ssa_trend[:31].isna().all() and (s.ssa_share[31:] > 0.999).all()


@pytest.mark.parametrize("kind", ["linear", "trees"])
def test_window_regressor_learns_and_is_saved(spark, tmp_path, kind):
    df, _ = walk(spark, 300)
    s = df.withColumns({"trend": F.col("close") * 2, "volatility": F.col("close") - 1})
    w = events.sliding_windows(s, 4, "close", include_last=True)
    m = models.WindowRegressor(kind=kind)
    fitted = m.fit(w)
    got = m.predict(fitted, w).toPandas()
    assert np.corrcoef(got.predicted_trend, got.trend)[0, 1] > 0.9
    m.save(fitted, str(tmp_path / "m"))
    again = m.predict(m.load(str(tmp_path / "m")), w).toPandas()
    np.testing.assert_allclose(got.sort_values("ts").predicted_volatility, again.sort_values("ts").predicted_volatility)


def test_components_clusters_and_linkage(spark):
    r = np.random.default_rng(6)
    p = pd.DataFrame(np.concatenate([r.normal(size=(60, 3)), r.normal(size=(60, 3)) + 12]), columns=["x", "y", "z"])
    p["truth"] = [0] * 60 + [1] * 60
    scaled = models.standardise(spark.createDataFrame(p), "x", "y", "z")
    projected, share = models.principal_components(scaled, 2)
    assert share[0] > 0.9 and share == sorted(share, reverse=True)
    got = models.clusters(projected, 2).toPandas()
    assert got.groupby("truth").cluster.nunique().tolist() == [1, 1] and got.cluster.nunique() == 2
    joins = models.linkage(projected, 4)
    assert len(joins) == 3 and joins[-1][3] == 120 and [j[2] for j in joins] == sorted(j[2] for j in joins)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_queries_without_sql_run(spark, name):
    out = queries.QUERIES[name](spark, SF)
    rows = out.collect()
    assert rows and len(out.columns) == len(set(out.columns))


def test_shapiro_query_is_in_range(spark):
    for r in queries.QUERIES["normality_shapiro"](spark, SF).collect():
        assert 0 < r.w <= 1 and 0 <= r.p_value <= 1


def test_calendar_predictions_begin_after_the_window(spark):
    df, p = walk(spark, 400)
    level = F.when(F.col("i") % 3 == 0, "High Volatility Expected").otherwise("Low Volatility Expected")
    raw = spark.range(150).select(
        F.col("id").alias("i"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,2 * int(id),0,0)").alias("ts")
    ).select("ts", level.alias("volatility"), F.when(F.col("i") % 2 == 0, "USA").otherwise("Spain").alias("country"), F.lit("Jobs").alias("description"), F.concat((F.col("i") % 7).cast("string"), F.lit("K")).alias("actual"), F.lit("1,000").alias("forecast"), F.lit("3").alias("previous"))
    rows = events.aligned_calendar(df, raw).toPandas().sort_values("ts")
    assert len(rows) == 299 and rows.event.sum() == 150 and (rows.actual[rows.event == 0] == -1).all()
    got = events.process_calendar(df, raw, window=32, divisor=4)
    assert got.columns == ["series_id", "ts", "predicted_trend", "predicted_volatility"]
    assert got.count() == 299 - 32 and got.agg(F.min("ts")).first()[0] == p.ts[32].to_pydatetime()


def test_named_data_sets(spark, tmp_path):
    df, p = walk(spark, 100)
    other, _ = walk(spark, 30, "D", 1)
    fine, _ = walk(spark, 500, "15min", 2)
    sets = {
        "index": plans.Dataset(other, ("close", "high"), "plain"),
        "fear": plans.Dataset(other, ("close",), "grid", 86400),
        "fast": plans.Dataset(fine, ("close",), "ticks", 900, 2),
        "same": plans.Dataset(df, ("low",), "exact"),
    }
    out = plans.OracleLabels().additional_datasets(df, sets)
    assert set(out) == {*sets, "hourly", "seasonality", "merged"}
    merged = out["merged"]
    assert {"index_close", "index_high", "fear_close", "fast_close_1", "fast_close_2", "same_low", "bh_bl", "hour_of_day"} <= set(merged.columns)
    assert merged.count() == out["hourly"].count() == out["index"].count() == 100
    assert merged.where("same_low <> low").count() == 0
    places = plans.write_outputs({"index": out["index"]}, str(tmp_path))
    assert spark.read.parquet(places["index"]).count() == 100
    with pytest.raises(ValueError, match="sideways"):
        plans.Dataset(df, how="sideways").onto(df, "x")


def test_stages_of_all_published_names(spark):
    df, _ = walk(spark, 80)
    out = plans.load_stage("default")().transform(df)
    assert {"rsi", "macd", "ema", "stoch_k", "adx", "atr", "cci", "bb_upper", "williams_r", "momentum", "roc"} <= set(out.columns)
    few = plans.load_stage("tech_indicator")().with_params(indicators=("ema", "roc", "williams", "mom")).transform(df)
    assert {"ema", "roc", "williams_r", "momentum"} <= set(few.columns) and few.count() == 80
    for name in ("ssa", "fft"):
        stage = plans.load_stage(name)()
        info = {}
        stage.add_debug_info(info, stage.transform(df))
        assert info["n"] == 32 and "close" in info["output_columns"]


def test_a_sample_beyond_its_bound_is_an_error(spark):
    s = spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).alias("label"))
    assert events.nearest_labels(s.select("x"), s, ("x",), "label", max_sample=20).count() == 20
    with pytest.raises(Exception, match="more than 19"):
        events.nearest_labels(s.select("x"), s, ("x",), "label", max_sample=19).collect()


def test_streaming_mean(spark, tmp_path):
    src = str(tmp_path / "rows")
    x = [1.0, None, 4.0, 2.0, 8.0]
    for i, v in enumerate(x):
        spark.createDataFrame([("a", f"2024-01-01 00:0{i}:00", v)], "series_id string, t string, x double").select("series_id", F.to_timestamp("t").alias("ts"), "x").coalesce(1).write.mode("append").parquet(src)
    rows = spark.readStream.schema("series_id string, ts timestamp, x double").option("maxFilesPerTrigger", 2).parquet(src)
    q = streaming.streaming_ema(rows, "x", 3).writeStream.format("memory").queryName("means").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [r.ema for r in spark.sql("SELECT ema FROM means ORDER BY ts").collect()]
    y, want = None, []
    for v in x:
        w = 0.5
        if v is not None:
            y = v if y is None else (1 - w) * y + w * v
        want.append(y)
    assert got == pytest.approx(want)

"""Readers, registry, configuration, the pipeline and streaming."""

import json

import pytest

from pyspark.sql import functions as F
from tidemill import plans, sources, streaming


def hourly_csv(path, n=60):
    lines = ["datetime,open,high,low,close,volume,BC-BO"]
    for i in range(n):
        lines.append(f"{1 + i // 24:02d}/01/2024 {i % 24:02d}:00,{10 + i % 7},{12 + i % 7},{9 + i % 7},{11 + i % 5},1,0")
    lines.append("not a date,1,1,1,1,1,1")
    path.write_text("\n".join(lines))


def test_csv_kinds(spark, tmp_path):
    hourly_csv(tmp_path / "h.csv")
    df = sources.read_csv(spark, str(tmp_path / "h.csv"), "hourly")
    assert df.count() == 60 and df.columns == ["series_id", "ts", "open", "high", "low", "close"]
    (tmp_path / "x.csv").write_text("DATE_TIME,OPEN,HIGH,LOW,CLOSE\n2024.01.02 03:15:00,1,2,x,4\n2024.13.02 00:00:00,1,2,3,4\n")
    r = sources.read_csv(spark, str(tmp_path / "x.csv"), "high_frequency").collect()
    assert len(r) == 1 and r[0].low is None and str(r[0].ts) == "2024-01-02 03:15:00"
    (tmp_path / "y.csv").write_text("Gmt time,open,high,low,close\n31.12.2023 20:00:00.000,1,2,3,4\n")
    assert str(sources.read_csv(spark, str(tmp_path / "y.csv"), "raw_ohlc").first().ts) == "2023-12-31 20:00:00"


def test_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("datetime,open\n01/01/2024,1\n")
    with pytest.raises(KeyError, match="high"):
        sources.read_csv(spark, str(tmp_path / "x.csv"), "hourly")


def test_calendar_without_header(spark, tmp_path):
    (tmp_path / "c.csv").write_text("2024/01/02, 08:30:00,US,High Volatility Expected,Jobs,,,1,2,3\nbad,x,,,,,,,,\n")
    r = sources.read_calendar(spark, str(tmp_path / "c.csv")).collect()
    assert len(r) == 1 and str(r[0].ts) == "2024-01-02 08:30:00"


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "orc"])
def test_write_and_read_back(spark, tmp_path, kind):
    where = str(tmp_path / f"out.{kind}")
    sources.write(spark.range(5).withColumn("x", F.col("id") * 2), where, format=kind)
    assert sources.read_any(spark, where).count() == 5


def test_config_layers_and_round_trip(tmp_path):
    c = plans.merge_config(plans.Config(), {"tp_pips": 1}, {"plugin": "oracle_labels", "tp_pips": 2}, {"tp_pips": 3, "output_file": "o"})
    assert (c.plugin, c.output_file, c.params) == ("oracle_labels", "o", {"tp_pips": 3})
    got, where = plans.parse_args(["--plugin", "x", "--tp_pips", "2.5", "--load_config", "c.json"])
    assert got == {"plugin": "x", "tp_pips": 2.5} and where == "c.json"
    path = str(tmp_path / "c.json")
    assert sources.save_config({"a": 1, "b": 2}, {"a": 1}, path) == {"b": 2}
    assert sources.load_config(path) == {"b": 2} == json.loads(open(path).read())


def test_registry():
    assert plans.load_stage("oracle_labels") is plans.OracleLabels
    with pytest.raises(ImportError, match="no_such"):
        plans.load_stage("no_such")
    with pytest.raises(TypeError, match="wrong"):
        plans.OracleLabels().with_params(wrong=1)
    assert plans.OracleLabels().with_params(tp_pips=5.0).params()["tp_pips"] == 5.0


@pytest.mark.parametrize("plugin", ["default", "oracle_labels", "direction_labels", "regimes", "seasonality"])
def test_pipeline(spark, tmp_path, plugin):
    hourly_csv(tmp_path / "h.csv")
    out = plans.process(spark, plans.Config(input_file=str(tmp_path / "h.csv"), plugin=plugin))
    assert out.count() == 60 and "close" in out.columns


def test_streaming_bars(spark, tmp_path):
    src = str(tmp_path / "ticks")
    t = spark.createDataFrame([(i, "a", f"2024-01-01 00:{i:02d}:00", float(i)) for i in range(0, 60, 5)], "id long, s string, t string, price double")
    t.select("id", "s", F.to_timestamp("t").alias("ts"), "price").write.parquet(src)
    ticks = spark.readStream.schema("id long, s string, ts timestamp, price double").parquet(src)
    q = streaming.streaming_bars(ticks, "15 minutes", "0 seconds", series="s", ts="ts", price="price", order="id").writeStream.format("memory").queryName("bars").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT * FROM bars ORDER BY ts").collect()
    assert [(x.open, x.high, x.low, x.close) for x in r] == [(0, 10, 0, 10), (15, 25, 15, 25), (30, 40, 30, 40)]

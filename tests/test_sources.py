"""Every kind of reader, the writers' options, and configuration over HTTP."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tidemill import session, sources
from tidemill.operators import labels, stats


@pytest.mark.parametrize(
    ("kind", "text", "ts", "values"),
    [
        ("generic", "date,open,high,low,close,volume,note\n03/02/2024 05:06,1,2,0.5,1.5,9,x\n", "2024-02-03 05:06:00", {"open": 1, "close": 1.5, "note": "x"}),
        ("generic", "date,open,high,low,close\n3.2.2024,1,2,,1.5\n", "2024-02-03 00:00:00", {"low": None}),
        ("labelled", "DATE_TIME,OPEN,HIGH,LOW,CLOSE,buy_entry_label\n2024-02-03 04:00:00,1,2,0.5,1.5,1\n", "2024-02-03 04:00:00", {"high": 2, "buy_entry_label": "1.0"}),
        ("study", "datetime,open,high,low,close\n03/02/2024 05:00,1,2,0.5,1.5\n", "2024-02-03 05:00:00", {"low": 0.5}),
        ("equity_index", "Date,Open,High,Low,Close,Adj Close,Volume\n2024-02-03,1,2,0.5,1.5,1.4,700\n", "2024-02-03 00:00:00", {"adj_close": 1.4, "volume": 700}),
        ("volatility_index", "date,open,high,low,close\n2024-02-03 00:00,1,2,0.5,bad\n", "2024-02-03 00:00:00", {"open": 1, "close": None}),
        ("hourly", "DateTime,Open,HIGH,low,Close\n3/2/2024 5:06,1,2,0.5,1.5\n", "2024-02-03 05:06:00", {"high": 2}),
    ],
)
def test_kinds(spark, tmp_path, kind, text, ts, values):
    (tmp_path / "x.csv").write_text(text + ",".join(["never"] * text.splitlines()[0].count(",")) + ",1\n")
    rows = sources.read_csv(spark, str(tmp_path / "x.csv"), kind).collect()
    assert len(rows) == 1 and str(rows[0].ts) == ts and rows[0].series_id == "series"
    assert {k: rows[0][k] for k in values} == values


def test_headerless_numbers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("1,2.5,x\n,4,5\n")
    got = sources.read_numbers(spark, str(tmp_path / "n.csv"), 3)
    assert got.columns == ["c0", "c1", "c2"] and sorted(map(tuple, got.collect()), key=str) == [(1.0, 2.5, None), (None, 4.0, 5.0)]


def test_splits_written_by_name_and_normalisation(spark, tmp_path):
    df = spark.createDataFrame([("a", f"2024-01-0{i}", float(i)) for i in range(1, 9)], "series_id string, d string, x double").selectExpr("series_id", "to_timestamp_ntz(d) AS ts", "x")
    sources.write(labels.chronological_split(df), str(tmp_path / "s"), format="csv", by=("split",), with_time=False)
    counts = {s: spark.read.option("header", True).csv(str(tmp_path / "s" / f"split={s}")).count() for s in ("d1", "d2", "d3")}
    assert counts == {"d1": 4, "d2": 2, "d3": 2}
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).columns == ["series_id", "x", "split"]
    got = sources.normalisation_config(stats.column_stats(df, "x"), "mean", "min", "max")
    assert got == {"x": {"mean": 4.5, "min": 1.0, "max": 8.0}}


class Handler(BaseHTTPRequestHandler):
    got: list = []

    def do_GET(self):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(b'{"plugin": "regimes", "rank": 60}')

    def do_POST(self):
        Handler.got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
        self.send_response(201)
        self.end_headers()

    def log_message(self, *_):
        pass


def test_configuration_over_http():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    where = f"http://127.0.0.1:{server.server_port}/c"
    try:
        assert sources.load_config(where) == {"plugin": "regimes", "rank": 60}
        assert sources.post_config({"a": 1}, where, user="u") and Handler.got == [{"user": "u", "config": {"a": 1}}]
    finally:
        server.shutdown()


def test_a_shared_folder_is_asked_for_outside_local_mode():
    class Session:
        class conf:
            @staticmethod
            def get(*_):
                return None

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)

"""Alignment of all events to the bars of all series, against a loop."""

from bisect import bisect_right
from collections import defaultdict

import pytest

from tidemill.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["asof_align", "asof_plain", "shifted_ticks"])
def test_every_series_has_its_bars(spark, name):
    events = spark.read.parquet(f"{SF}/events.parquet")
    bars = {(r.event_type, r.ts.replace(minute=0, second=0, microsecond=0)) for r in events.collect()}
    got = [(r.series_id, r.ts) for r in QUERIES[name](spark, SF).collect()]
    assert len({s for s, _ in bars}) > 1 and len(got) == len(bars) and set(got) == bars


def test_the_last_of_all_events_is_found(spark):
    seen = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        seen[r.event_type].append((r.ts, r.value))
    for r in QUERIES["asof_plain"](spark, SF).collect():
        at = bisect_right([t for t, _ in seen[r.series_id]], r.ts)
        assert r.value == pytest.approx(seen[r.series_id][at - 1][1] if at else -1, abs=1e-6)

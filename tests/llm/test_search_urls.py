"""Top-k search and URL filter against plain loops and SQL."""

import fnmatch
import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import queries, topk, urls

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    rows = lambda p: sorted(map(tuple, p[sorted(p.columns)].astype(object).where(p.notna(), None).values.tolist()), key=str)
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(c.execute(queries.ORACLES[name]).fetchdf())


def test_top_k_ties_gaps_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "PASS_BYTES", 100)
    monkeypatch.setattr(topk, "ROWS", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 256]) for i in range(120)]
    rows += [(200, None), (250, [math.nan, 1.0]), (251, [None, 1.0]), (252, [math.inf]), (300, []), (301, [0.5]), (None, [1.0]), (100, rows[100][1]), (101, rows[101][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = {tuple(r) for r in topk.exact_top_k(df).collect()}
    assert got == want
    assert topk.exact_top_k(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab*?", max_size=90), min_size=1, max_size=6), st.lists(st.text(alphabet="ab", max_size=100), min_size=1, max_size=6))
def test_automaton_equals_globs(globs, texts):
    raw = [t.encode() for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    got = urls.ShiftAnd([g.encode() for g in globs]).match(np.frombuffer(b"".join(raw) + b"-", np.uint8), np.cumsum(size) - size, size)
    assert got.tolist() == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]


def test_url_edges(spark):
    cases = [
        ("http://WWW.Example.ORG/es/x?q#f", "www.example.org", "/es/x", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://notexample.org/en/12", "notexample.org", "/en/12", "org/", "allow"),
        ("https://a.com/de/", "a.com", "/de/", "com/de/", "block"),
        ("https://a.com?/de/", "a.com", "", None, "allow"),
        ("http://cheap-pills.example.com/x", "cheap-pills.example.com", "/x", None, "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("a://b://c.org/", "b:", "//c.org/", None, "allow"),
        ("x://" + "h" * 5000 + ".org/" + "p" * 5000, "h" * 5000 + ".org", "/" + "p" * 5000, "org/", "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)] + [(None, "http://a.org/", "x")], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in urls.filter_urls(df).collect()}
    assert got[None] == ("a.org", "/", "org/", "allow")
    for i, c in enumerate(cases):
        assert got[i] == c[1:], c[0][:40]
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_best_of_a_block_as_floats_equals_the_loop_over_queries():
    rng = np.random.default_rng(8)
    for n, width in ((3, 5), (700, 5), (5000, 900), (5000, 3)):
        ids, own = rng.integers(0, n, n), rng.integers(0, n, 40)
        scores = rng.integers(-width, width, (40, n))
        got, want = (sorted(zip(*(x.tolist() for x in f(s, ids, own, 5)), strict=True)) for f, s in ((topk.best_of_floats, scores.astype(np.float32)), (topk.best, scores)))
        assert got == want


@pytest.mark.parametrize(("low", "high", "kind"), [(-150, 150, np.float32), (-(1 << 20), 1 << 20, np.float64), (-(1 << 62), 1 << 62, np.int64)])
def test_scores_are_exact_and_dense_terms_are_summed_at_once(low, high, kind):
    rng = np.random.default_rng(9)
    rows = rng.integers(low, high, (300, 20))
    rows[:, 15:] *= rng.random((300, 5)) < 0.02
    off = np.arange(301) * 20
    p = topk.Postings(off, rows.ravel())
    got = p.scores(topk.Postings(off[:41], rows[:40].ravel()))
    assert got.dtype == kind and p.few.tolist() == [15, 16, 17, 18, 19]
    assert (got.astype(np.int64) == rows[:40] @ rows.T).all()


def test_vectors_at_the_ends_of_the_longs(spark):
    rows = [(0, [1e300, -1.0]), (1, [-1e300, 0.5]), (2, [3.5e16, 2.0]), (3, [0.001, -0.001]), (4, [-0.001, 0.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {r.vec_id: r.v for r in df.select("vec_id", topk.quantised("embedding").alias("v")).collect()}
    assert [topk.floored(np.array(x)).tolist() for _, x in rows] == [v[i] for i, _ in rows]
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    best = sorted((-wrap(sum(a * b for a, b in zip(v[0], v[i], strict=True))), i) for i in range(1, 5))
    assert [tuple(r) for r in topk.exact_top_k(df).orderBy("rank").collect()] == [(0, k + 1, i, -s) for k, (s, i) in enumerate(best)]

"""Row numbers, ranks and quantiles over ranges of a table, with rows enough for several ranges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import align, stats


@pytest.fixture
def many_ranges(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_of_a_million_rows_with_other_columns(many_ranges):
    n = 1_200_000
    df = many_ranges.range(n).select((F.col("id") * 7919 % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("note"))
    got = align.numbered(df.repartition(9), "k")
    assert got.columns == ["k", "note", "row_pos"]
    r = got.agg(F.countDistinct("row_pos").alias("n"), F.min("row_pos").alias("a"), F.max("row_pos").alias("b"), F.sum((F.col("row_pos") != F.col("k") + 1).cast("int")).alias("off")).first()
    assert (r.n, r.a, r.b, r.off) == (n, 1, n, 0)


def test_numbers_where_most_rows_are_alike(many_ranges):
    df = many_ranges.range(60_000).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("k"))
    r = align.numbered(df, "k")
    assert r.agg(F.countDistinct("row_pos"), F.max("row_pos")).first()[:] == (60_000, 60_000)
    assert align.in_ranges(df, "k").groupBy("__p").count().agg(F.max("count")).first()[0] < 30_000


def test_ranks_of_many_values(many_ranges):
    x = np.random.default_rng(1).integers(0, 40_000, 100_000).astype(float)
    df = many_ranges.createDataFrame(pd.DataFrame({"x": x, "other": [f"row {i}" for i in range(len(x))]}))
    got = stats.average_ranks(df.withColumn("was", F.col("x")), "x").toPandas()
    want = pd.Series(got["was"]).rank()
    np.testing.assert_allclose(got["x"].to_numpy(), want.to_numpy())


def test_quantiles_of_many_values(many_ranges):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"x": rng.normal(size=50_001), "y": rng.integers(0, 9, 50_001).astype(float), "none": np.full(50_001, np.nan)})
    df = many_ranges.createDataFrame(p).withColumn("none", F.lit(None).cast("double"))
    got = {r["column"]: r for r in stats.quantiles(df, "x", "y", "none", at=(0.1, 0.5, 0.75)).collect()}
    for c in ("x", "y"):
        np.testing.assert_allclose([got[c].q10, got[c].q50, got[c].q75], np.quantile(p[c], [0.1, 0.5, 0.75]))
    assert got["none"].q50 is None


def test_description_and_density(spark):
    x = np.random.default_rng(3).gamma(2.0, size=4000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    d, s = stats.describe(df, "x").first(), pd.Series(x).describe()
    np.testing.assert_allclose([d["count"], d["mean"], d["std"], d["min"], d["q25"], d["q50"], d["q75"], d["max"]], s.to_numpy())
    got = stats.density(df, "x", points=60).toPandas().sort_values("x")
    h = x.std(ddof=1) * len(x) ** -0.2
    want = np.exp(-(((got["x"].to_numpy()[:, None] - x) / h) ** 2) / 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got["density"], want, atol=2e-3)


def test_normality_of_published_examples(spark):
    # weights of eleven men, a published example of Shapiro and Wilk's test
    x = [float(v) for v in (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236)]
    r = stats.shapiro(spark.createDataFrame([(v,) for v in x], "x double"), "x").first()
    assert r.n == 11 and r.w == pytest.approx(0.7888147, abs=2e-4) and r.p_value == pytest.approx(0.0067038, abs=2e-4)
    even = spark.range(2000).select(stats.normal_quantile((F.col("id") + 0.5) / 2000).alias("x"))
    r = stats.shapiro(even, "x").first()
    assert r.w > 0.999 and r.p_value > 0.5
    assert stats.shapiro(even.limit(3), "x").count() == 0


def test_omnibus_statistic_against_a_loop(spark):
    x = np.random.default_rng(4).normal(size=500) ** 3
    r = stats.moments(spark.createDataFrame(pd.DataFrame({"x": x})), "x").first()
    n, d = len(x), x - x.mean()
    m2, m3, m4 = (d**2).mean(), (d**3).mean(), (d**4).mean()
    y = m3 / m2**1.5 * np.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + np.sqrt(2 * (beta2 - 1))
    alpha = np.sqrt(2.0 / (w2 - 1))
    z1 = np.log(y / alpha + np.sqrt((y / alpha) ** 2 + 1)) / np.sqrt(0.5 * np.log(w2))
    b2 = m4 / m2**2
    e = 3.0 * (n - 1) / (n + 1)
    v = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5))
    z = (b2 - e) / np.sqrt(v)
    sb = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * np.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb * (2.0 / sb + np.sqrt(1 + 4.0 / sb**2))
    t = (1 - 2.0 / a) / (1 + z * np.sqrt(2 / (a - 4.0)))
    z2 = (1 - 2 / (9.0 * a) - np.sign(t) * np.abs(t) ** (1 / 3)) / np.sqrt(2 / (9.0 * a))
    assert r.k2 == pytest.approx(z1**2 + z2**2, rel=1e-9) and r.p_value == pytest.approx(np.exp(-r.k2 / 2))

"""Regressors over window tensors, clustering and projection, on MLlib."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import labels


@dataclass(frozen=True)
class WindowRegressor:
    """Predicts ``targets`` from the flattened ``window`` array of each row; fitted on the chronologically first part."""

    targets: tuple[str, ...] = ("trend", "volatility")
    kind: str = "linear"
    train: float = 0.8

    def _vectors(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(F.flatten("window")))

    def fit(self, df: DataFrame) -> dict[str, PipelineModel]:
        first = stored(labels.chronological_split(df, self.train, 1 - self.train).where("split = 'd1'").select("window", *self.targets))
        first = self._vectors(first)
        make = {"linear": lambda t: LinearRegression(labelCol=t, predictionCol=f"predicted_{t}", regParam=0.1), "trees": lambda t: GBTRegressor(labelCol=t, predictionCol=f"predicted_{t}", maxIter=20)}[self.kind]
        return {t: Pipeline(stages=[make(t)]).fit(first.dropna(subset=[t])) for t in self.targets}

    def predict(self, models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
        out = self._vectors(df)
        for m in models.values():
            out = m.transform(out)
        return out.drop("features")

    def save(self, models: dict[str, PipelineModel], path: str) -> None:
        """Each target's model to a folder of its own, in the place of what is there."""
        for t, m in models.items():
            m.write().overwrite().save(f"{path.rstrip('/')}/{t}")

    def load(self, path: str) -> dict[str, PipelineModel]:
        return {t: PipelineModel.load(f"{path.rstrip('/')}/{t}") for t in self.targets}


def standardise(df: DataFrame, *columns: str) -> DataFrame:
    """``scaled``: the columns by their mean and population deviation. The rows are stored, as all that follows passes over them often."""
    df = stored(df)
    n = df.count()
    v = VectorAssembler(inputCols=list(columns), outputCol="raw", handleInvalid="skip").transform(df)
    sample = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="by_sample").fit(v).transform(v)
    grow = (n / max(1, n - 1)) ** 0.5  # the library divides by the sample deviation
    return sample.withColumn("scaled", array_to_vector(F.transform(vector_to_array("by_sample"), lambda x: x * grow))).drop("raw", "by_sample")


def principal_components(df: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """``df`` with ``pca`` from ``scaled``, and the share of variance each component explains."""
    m = PCA(k=k, inputCol="scaled", outputCol="pca").fit(df)
    return m.transform(df), list(m.explainedVariance)


def _bisected(df: DataFrame, k: int, seed: int) -> DataFrame:
    """``df`` with ``cluster``. The library splits a cluster by a step in proportion to its center's length, which is nothing for
    standardised data, whose center is the origin; so the points are moved away from it first, which changes no distance."""
    away = df.withColumn("__away", array_to_vector(F.transform(vector_to_array("pca"), lambda x: x + 1.0)))
    return BisectingKMeans(k=k, seed=seed, featuresCol="__away", predictionCol="cluster").fit(away).transform(away).drop("__away")


def linkage(df: DataFrame, k: int, *, seed: int = 42) -> list[tuple[int, int, float, int]]:
    """The rows of a dendrogram over ``k`` (at most some dozens) clusters: the two that join, their distance by Ward, the size of both.

    The leaves are bisecting k-means clusters of all rows, 0 to k - 1; each join makes the next number.
    """
    leaves = _bisected(df, k, seed).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("pca")).alias("center")).collect()
    live = {r.cluster: (r.n, r.center.toArray()) for r in leaves}
    joins = []
    while len(live) > 1:

        def cost(a: int, b: int) -> float:
            (n, x), (m, y) = live[a], live[b]
            return float((2 * n * m / (n + m) * ((x - y) ** 2).sum()) ** 0.5)

        a, b = min(((a, b) for a in live for b in live if a < b), key=lambda p: (cost(*p), p))
        far, (n, x), (m, y) = cost(a, b), live.pop(a), live.pop(b)
        live[k + len(joins)] = n + m, (n * x + m * y) / (n + m)
        joins.append((a, b, far, n + m))
    return joins


def clusters(df: DataFrame, k: int, *, seed: int = 42) -> DataFrame:
    """``cluster`` by hierarchical (bisecting) k-means over all rows, in place of linkage over a sample."""
    return _bisected(df, k, seed)

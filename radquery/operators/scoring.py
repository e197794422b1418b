"""Scorers: features to probabilities of the classes, as arrays in a fixed class order."""

from __future__ import annotations

from typing import Protocol

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARPNESS = 8.0


class Scorer(Protocol):
    def fit(self, train: DataFrame) -> Scorer: ...

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probs``: array<struct<cls, p>> in class order."""


def _means(train: DataFrame, features: str, label: str) -> DataFrame:
    """(label, mean): a vector for each class, added up as vectors, whatever their length. Rows without features don't count."""
    vector = array_to_vector(F.col(features).cast("array<double>"))
    return train.where(F.col(features).isNotNull()).groupBy(label).agg(vector_to_array(Summarizer.mean(vector)).alias("mean"))


def centroids(train: DataFrame, features: str, label: str) -> DataFrame:
    """(label, dim, mean): as many rows as classes times dimensions."""
    return _means(train, features, label).select(label, F.posexplode("mean").alias("dim", "mean"))


class CentroidScorer:
    """Softmax over negative squared distances from the classes' means, over the first ``dims`` dimensions."""

    def __init__(self, features: str = "embedding", label: str = "label", dims: int = 64):
        self.features, self.label, self.dims = features, label, dims

    def fit(self, train: DataFrame) -> CentroidScorer:
        each = _means(train, self.features, self.label).select(self.label, F.slice("mean", 1, self.dims).alias("center"))
        self.model = each.agg(F.array_sort(F.collect_list(F.struct(F.col(self.label).alias("cls"), "center"))).alias("_model"))  # one row
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        part = F.slice(self.features, 1, self.dims)

        def logit(m):
            square = F.zip_with(part, m["center"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
            return F.aggregate(square, F.lit(0.0), lambda s, x: s + x) * -SHARPNESS

        scored = df.join(F.broadcast(self.model)).withColumn("_logits", F.transform("_model", logit))
        scored = scored.withColumn("_most", F.array_max("_logits"))
        scored = scored.withColumn("_exp", F.transform("_logits", lambda x: F.exp(x - F.col("_most"))))
        total = F.aggregate("_exp", F.lit(0.0), lambda s, x: s + x)
        scored = scored.withColumn("_sum", total)
        probs = F.zip_with("_model", "_exp", lambda m, x: F.struct(m["cls"].alias("cls"), (x / F.col("_sum")).alias("p")))
        return scored.withColumn("probs", probs).drop("_model", "_logits", "_most", "_exp", "_sum")


class LogisticScorer:
    """Multinomial logistic regression on the features; labels are 0, 1, ..."""

    def __init__(self, features: str = "embedding", label: str = "label", iterations: int = 20):
        self.features, self.label, self.iterations = features, label, iterations

    def fit(self, train: DataFrame) -> LogisticScorer:
        rows = train.select(array_to_vector(F.col(self.features).cast("array<double>")).alias("features"), F.col(self.label).cast("double").alias("label"))
        self.model = LogisticRegression(family="multinomial", maxIter=self.iterations, regParam=0.01).fit(rows)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        vectors = df.withColumn("features", array_to_vector(F.col(self.features).cast("array<double>")))
        scored = self.model.transform(vectors).withColumn("_p", vector_to_array("probability"))
        probs = F.transform("_p", lambda p, i: F.struct(i.cast("int").alias("cls"), p.alias("p")))
        return scored.withColumn("probs", probs).drop("features", "rawPrediction", "probability", "prediction", "_p")

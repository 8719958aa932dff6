"""Classifiers that are not linear: random Fourier features of the Gaussian kernel before a linear one, and votes of exact neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators import vectors

#: Rows whose features a task holds at once.
PART = 1024


def fourier(vec: Column, length: int, gamma: float, width: int = 512, seed: int = 7) -> Column:
    """`width` features of vectors of `length` numbers whose products approach exp(-gamma * squared distance); null for vectors that are null, of other lengths or not finite.

    The drawn matrix has length x width numbers and goes with the function (Rahimi and Recht, 2007).
    """
    rng = np.random.default_rng(seed)
    drawn, phase = rng.normal(0, math.sqrt(2 * gamma), (length, width)), rng.uniform(0, 2 * math.pi, width)

    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in (batch.iloc[begin : begin + PART] for batch in batches for begin in range(0, len(batch), PART)):
            out = np.full(len(some), None, dtype=object)
            fit = [i for i, v in enumerate(some) if v is not None and len(v) == length and np.isfinite(np.asarray(v, dtype=float)).all()]
            if fit:
                rows = np.stack([np.asarray(some.iloc[i], dtype=float) for i in fit])
                for i, row in zip(fit, math.sqrt(2 / width) * np.cos(rows @ drawn + phase)):
                    out[i] = row
            yield pd.Series(out)

    made.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(made, "array<double>")(vec)


class KernelClassifier:
    """Logistic regression on Fourier features, in place of a support vector machine with a Gaussian kernel; penalty 1 / (cost * rows)."""

    def __init__(self, length: int, gamma: float, cost: float = 1600.0, width: int = 512, seed: int = 7):
        self.length, self.gamma, self.cost, self.width, self.seed, self.model = length, gamma, cost, width, seed, None

    def _with(self, rows: DataFrame, vec: str) -> DataFrame:
        # Exploded as one row, so that the condition doesn't work the features out again.
        features = fourier(F.col(vec), self.length, self.gamma, self.width, self.seed)
        made = rows.select("*", F.explode(F.array(features)).alias("_f"))
        return made.where("_f is not null").withColumn("_f", array_to_vector("_f"))

    def fit(self, rows: DataFrame, vec: str, label: str) -> KernelClassifier:
        made = self._with(rows.select(F.col(vec), F.col(label).cast("double").alias("_y")).where("_y is not null"), vec)
        n = max(rows.count(), 1)
        self.model = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=1 / (self.cost * n), maxIter=50).fit(made)
        return self

    def scored(self, rows: DataFrame, vec: str) -> DataFrame:
        """Every column of rows that have features, `prediction` and `probability`, that of the class predicted."""
        kept = rows.columns
        out = self.model.transform(self._with(rows, vec), {self.model.predictionCol: "_p", self.model.probabilityCol: "_q", self.model.rawPredictionCol: "_r"})
        return out.select(*[F.col(f"`{c}`") for c in kept], F.col("_p").cast("int").alias("prediction"), F.array_max(vector_to_array("_q")).alias("probability"))


def neighbour_votes(rows: DataFrame, key: str, vec: str, label: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query, prediction, votes): the commonest label of the k rows nearest to each query by Euclidean distance.

    `queries` (query, q) is a stated set that meets the rows in blocks; each task keeps k rows of
    a query. Equal distances go to the least key, equal votes to the least label. Rows without
    vector or label, and vectors of another length, don't vote. Keys and labels are whole numbers.
    """

    def rough(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Squared distances in units of the largest squared norm, so that one slack serves all."""
        sizes = (q * q).sum(axis=1), (v * v).sum(axis=1)
        return (sizes[0][:, None] + sizes[1][None, :] - 2 * (q @ v.T)) / max(sizes[0].max(initial=0.0), sizes[1].max(initial=0.0), 1e-300)

    def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return vectors.in_order((v - q) * (v - q))

    near = vectors.nearest(rows.where(F.col(label).isNotNull()), key, vec, queries, k, rough, exact, 1e-9, label)
    near = near.select(F.col("query").cast(queries.schema["query"].dataType).alias("query"), key, F.col("other").cast(rows.schema[label].dataType).alias(label), F.col("cost").alias("d"))
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d", key))).where(F.col("rank") <= k)
    votes = best.groupBy("query", F.col(label).alias("prediction")).agg(F.count("*").alias("votes"))
    top = F.max_by(F.struct("prediction", "votes"), F.struct("votes", -F.col("prediction")))
    return votes.groupBy("query").agg(top.alias("top")).select("query", "top.prediction", "top.votes")

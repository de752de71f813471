"""Small learned heads: by the stated optimizer, and with pyspark.ml as metric-level equivalents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_class_weights(rows: DataFrame, label: str, inverse_sqrt: bool = True, out: str = "weight") -> DataFrame:
    """Weights by inverse (square root of) class frequency; classes are few, so their counts are broadcast."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    w = F.lit(1.0) / (F.sqrt("__n") if inverse_sqrt else F.col("__n"))
    return rows.join(F.broadcast(counts), label).withColumn(out, w).drop("__n")


def fit_head(rows: DataFrame, features: str, label: str, l2: float = 1e-2, weight: str | None = "weight", standardize: bool = True) -> LogisticRegressionModel:
    """Multinomial logistic regression. The penalty here is l2 * |w|^2 / 2, so twice a penalty written without the half."""
    data = rows.withColumn("__x", array_to_vector(F.col(features).cast("array<double>")))
    model = LogisticRegression(featuresCol="__x", labelCol=label, regParam=2 * l2, elasticNetParam=0.0, standardization=standardize, maxIter=200)
    return (model.setWeightCol(weight) if weight else model).fit(data)


def with_positive_weight(rows: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight of a positive row (label 1): negatives by positives, at least 1 positive; other rows weigh 1."""
    counts = rows.agg(F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) != 1).alias("__q"))
    w = F.when(F.col(label) == 1, F.col("__q") / F.greatest(F.col("__p"), F.lit(1))).otherwise(1.0)
    return rows.join(F.broadcast(counts), how="cross").withColumn(out, w).drop("__p", "__q")


def fit_ranker(candidates: DataFrame, features: str, relevant: str, l2: float = 1e-2) -> LogisticRegressionModel:
    """A logistic ranker of candidates (one row each), where the rare right candidates weigh as much as all others."""
    return fit_head(with_positive_weight(candidates, relevant), features, relevant, l2)


def best_candidates(model: LogisticRegressionModel, candidates: DataFrame, query: str, label: str, features: str) -> DataFrame:
    """Per query the candidate of the greatest probability, ties to the smaller label."""
    p = head_probabilities(model, candidates, features).withColumn("p", F.element_at("probabilities", 2))
    best = F.min_by(F.struct(label, "p"), F.struct((-F.col("p")).alias("m"), F.col(label)))
    return p.groupBy(query).agg(best.alias("b")).select(query, "b.*")


def head_probabilities(model: LogisticRegressionModel, rows: DataFrame, features: str, out: str = "probabilities") -> DataFrame:
    data = rows.withColumn("__x", array_to_vector(F.col(features).cast("array<double>")))
    drop = ["__x", model.getRawPredictionCol(), model.getProbabilityCol(), model.getPredictionCol()]
    return model.transform(data).withColumn(out, vector_to_array(F.col(model.getProbabilityCol()))).drop(*drop)


@dataclass(frozen=True)
class LinearHead:
    """A linear head over standardized features, as ``retrieval.head_scores`` takes it, and the loss that it was kept for."""

    weight: list[list[float]]
    bias: list[float]
    mean: list[float]
    std: list[float]
    loss: float
    epoch: int


def mild_class_weights(counts: list[int]) -> np.ndarray:
    """Inverse square roots of class counts (1 at least), scaled to mean 1."""
    w = 1 / np.sqrt(np.maximum(np.asarray(counts, dtype=np.float64), 1.0))
    return w / w.mean()


def gradient_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, bias: np.ndarray, class_weights: np.ndarray) -> np.ndarray:
    """Sums over rows: gradient by weight and bias of the weighted cross-entropy, the loss itself, and the rows' weights, in one vector."""
    logits = x @ weight.T + bias
    logits -= logits.max(axis=1, keepdims=True)
    e = np.exp(logits)
    total = e.sum(axis=1, keepdims=True)
    w = class_weights[y]
    error = e / total
    error[np.arange(len(y)), y] -= 1
    error *= w[:, None]
    loss = w * (np.log(total[:, 0]) - logits[np.arange(len(y)), y])
    return np.concatenate([(error.T @ x).ravel(), error.sum(axis=0), [loss.sum(), w.sum()]])


class AdamW:
    """Adaptive moments with decoupled weight decay, which all parameters have."""

    def __init__(self, size: int, lr: float, decay: float, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8):
        self.lr, self.decay, self.betas, self.eps = lr, decay, betas, eps
        self.first, self.second, self.steps = np.zeros(size), np.zeros(size), 0

    def step(self, parameters: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        a, b = self.betas
        self.first = a * self.first + (1 - a) * gradient
        self.second = b * self.second + (1 - b) * gradient * gradient
        size = np.sqrt(self.second) / np.sqrt(1 - b**self.steps) + self.eps
        return parameters * (1 - self.lr * self.decay) - self.lr / (1 - a**self.steps) * self.first / size


def fit_adamw(rows: DataFrame, features: str, label: str, classes: int = 3, epochs: int = 600, lr: float = 0.03, decay: float = 2e-3) -> LinearHead:
    """A softmax head fitted from zero by full-batch AdamW, with mild class weights; the state after the step of the least loss is kept.

    ``features`` is an array of one length, ``label`` a whole number below ``classes``; rows that lack one are left out.
    An epoch is one job over the rows, which are kept in memory or on the executors' disks meanwhile and computed
    again where an executor is lost: tasks sum gradients batch by batch, and the driver gets one vector of
    ``classes`` times features. So 600 epochs are 600 scans, and pay off for tables that one machine could not
    hold; ``fit_head`` needs far fewer. No rows raise an error.
    """
    data = rows.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
    spark = rows.sparkSession
    parts = data.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).orderBy("i").collect()
    if not parts:
        raise ValueError("there are no rows to fit a head to")
    mean = np.array([p["mean"] for p in parts])
    std = np.array([1.0 if p["std"] < 1e-6 else p["std"] for p in parts])
    counted = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.count("*").alias("n")).collect()}
    class_weights = mild_class_weights([counted.get(c, 0) for c in range(classes)])
    dims, size = len(mean), classes * len(mean) + classes

    def sums_at(parameters: np.ndarray):
        sent = spark.sparkContext.broadcast(parameters)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + 2)
            weight, bias = sent.value[: classes * dims].reshape(classes, dims), sent.value[classes * dims :]
            for batch in batches:
                if batch.num_rows:
                    x = (batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - mean) / std
                    total += gradient_sums(x, batch.column(1).to_numpy(), weight, bias, class_weights)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        found = held.mapInArrow(sums, "sums array<double>").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size + 2)]).first()
        sent.unpersist()
        return np.array(list(found))

    held = data.persist()
    try:
        parameters, optimizer, best = np.zeros(size), AdamW(size, lr, decay), None
        for epoch in range(epochs):
            s = sums_at(parameters)
            loss = s[-2] / s[-1]
            parameters = optimizer.step(parameters, s[:-2] / s[-1])
            if best is None or loss < best[0]:
                best = (float(loss), epoch, parameters)
    finally:
        held.unpersist()
    weight, bias = best[2][: classes * dims].reshape(classes, dims), best[2][classes * dims :]
    return LinearHead(weight.tolist(), bias.tolist(), mean.tolist(), std.tolist(), best[0], best[1])

"""Classifiers and regressors on ``pyspark.ml``, with the penalty scales of the usual solvers.

A *spec* holds the settings; ``fit`` takes rows ``(sample_id, features VECTOR, label)`` and
returns a fitted model whose ``transform`` adds ``p1``, ``decision`` and ``prediction``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.rowindex import with_row_index
from riskloom.functions.scalar import dot, logistic
from riskloom.runtime import cut

LANDMARK_BYTES = 64 << 20  # landmarks that one pass brings to the tasks
VALUE_BYTES = 64 << 20  # samples or kernel values that a task multiplies at once


class Spec:
    """Settings that a search can replace by name."""

    def with_params(self, **params):
        return replace(self, **params)


@dataclass(frozen=True)
class FittedClassifier:
    """A ``pyspark.ml`` model seen as class-1 probability, decision value and class."""

    model: object
    weights: np.ndarray
    intercept: float = 0.0
    constant_feature: bool = False

    def transform(self, rows: DataFrame) -> DataFrame:
        source = with_constant(rows) if self.constant_feature else rows
        out = self.model.transform(source)
        raw = vector_to_array("rawPrediction")
        return out.select(
            *rows.columns,
            vector_to_array("probability")[1].alias("p1"),
            (raw[1] if self.model.numClasses == 2 else F.array_max(raw)).alias("decision"),
            F.col("prediction").cast("int").alias("prediction"),
        )


@dataclass(frozen=True)
class LinearClassifier:
    """Weights and intercept as a classifier, for instance one of many that were fitted at once."""

    weights: np.ndarray
    intercept: float = 0.0

    def transform(self, rows: DataFrame) -> DataFrame:
        decision = dot(vector_to_array("features"), F.lit(self.weights.tolist())) + float(self.intercept)
        scored = rows.withColumn("decision", decision).withColumn("p1", logistic(F.col("decision")))
        return scored.select(*rows.columns, "p1", "decision", (F.col("decision") > 0).cast("int").alias("prediction"))


def with_constant(rows: DataFrame) -> DataFrame:
    """Append a feature that is always 1."""
    longer = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    return rows.withColumn("features", array_to_vector(longer))


def mirrored(rows: DataFrame) -> DataFrame:
    """Rows with the constant feature, every second one (by hash) turned around.

    Turning ``(x, 1, y)`` into ``(-x, -1, 1-y)`` leaves a row's log loss as it is.  It is
    needed because ``pyspark.ml`` gives a feature that never varies the weight 0.
    """
    turned = F.pmod(F.xxhash64("sample_id"), F.lit(2)) == 1
    longer = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    return rows.select(
        "sample_id",
        array_to_vector(F.when(turned, F.transform(longer, lambda v: -v)).otherwise(longer)).alias("features"),
        F.when(turned, 1.0 - F.col("label")).otherwise(F.col("label")).alias("label"),
    )


# -- M1..M3 -----------------------------------------------------------------------------


@dataclass(frozen=True)
class LogisticSpec(Spec):
    """Logistic regression of strength C: ``regParam = 1 / (C * n)`` gives the same optimum.

    ``penalise_intercept`` treats the intercept as the weight of a constant feature.
    """

    C: float = 1.0
    penalty: str = "l2"
    penalise_intercept: bool = False
    fit_intercept: bool = True
    max_iter: int = 100
    tol: float = 1e-6

    def checked(self) -> LogisticSpec:
        if self.C <= 0:
            raise ValueError("C must be positive")
        for name in ("max_iter", "tol"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.penalty not in ("l1", "l2"):
            raise ValueError("penalty is 'l1' or 'l2'")
        return self

    def fit(self, rows: DataFrame, n: int | None = None) -> FittedClassifier:
        self.checked()
        n = rows.count() if n is None else n
        own_constant = self.fit_intercept and self.penalise_intercept
        solver = LogisticRegression(
            regParam=1.0 / (self.C * n),
            elasticNetParam=1.0 if self.penalty == "l1" else 0.0,
            standardization=False,
            fitIntercept=self.fit_intercept and not self.penalise_intercept,
            maxIter=self.max_iter,
            tol=self.tol,
            family="binomial",
        )
        model = solver.fit(mirrored(rows) if own_constant else rows)
        weights, intercept = model.coefficients.toArray(), model.intercept
        if own_constant:
            weights, intercept = weights[:-1], float(weights[-1])
        return FittedClassifier(model, weights, intercept, own_constant)


# -- M4..M7 -----------------------------------------------------------------------------


def _kernel_matrix(kind, x: np.ndarray, y: np.ndarray, gamma, degree, coef0) -> np.ndarray:
    if callable(kind):
        return np.asarray(kind(x, y), dtype=float)
    g = 1.0 / x.shape[1] if gamma is None else gamma
    xy = x @ y.T
    if kind == "linear":
        return xy
    if kind == "poly":
        return (g * xy + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(g * xy + coef0)
    if kind == "rbf":
        far = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * xy
        return np.exp(-g * np.maximum(far, 0))
    raise ValueError(f"unknown kernel {kind!r}")


@dataclass(frozen=True)
class Kernel:
    """linear, poly, rbf, sigmoid, or a function of two matrices (rows as samples) that returns
    the matrix of values.  Unused settings are ignored."""

    kind: object = "rbf"
    gamma: float | None = None
    degree: float = 3
    coef0: float = 1.0

    def _passes(self, rows: DataFrame, landmarks: DataFrame) -> list[DataFrame]:
        landmarks = cut(landmarks.select("landmark_ix", "features"), "landmarks")
        n, width = landmarks.agg(F.count("*"), F.max(F.size("features"))).first()
        at_once = max(1, LANDMARK_BYTES // (8 * max(width or 1, 1)))
        id_type = rows.schema["sample_id"].dataType.simpleString()
        parts = []
        for block, first in enumerate(range(0, n, at_once)):
            here = F.col("landmark_ix").between(first, first + at_once - 1)
            marks = np.stack(landmarks.where(here).orderBy("landmark_ix").toPandas()["features"]).astype(float)
            part = rows.select("sample_id", "features").mapInPandas(
                self._multiply(marks, block), f"sample_id {id_type}, block int, values array<double>"
            )
            parts.append(part if n <= at_once else cut(part, "kernel"))
        return parts

    def _multiply(self, marks: np.ndarray, block: int):
        kind, gamma, degree, coef0 = self.kind, self.gamma, self.degree, self.coef0
        samples = max(1, VALUE_BYTES // (8 * max(marks.shape)))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), samples):
                    part = frame.iloc[at : at + samples]
                    values = _kernel_matrix(kind, np.stack(part["features"]).astype(float), marks, gamma, degree, coef0)
                    yield pd.DataFrame({"sample_id": part["sample_id"], "block": block, "values": list(values)})

        return run

    def blocks(self, rows: DataFrame, landmarks: DataFrame) -> DataFrame:
        """``(sample_id, block, values)``: kernel of every sample with each block of landmarks.

        ``landmarks`` holds ``(landmark_ix, features ARRAY)``, numbered from 0 without gaps.  A block is as
        many landmarks as ``LANDMARK_BYTES`` hold; it goes through the driver to the tasks, and a pass over
        the samples, where they are, multiplies them with it.  Samples are never shuffled or copied, and
        the driver holds one block at a time: with several, the values of each are written before the next.
        Without landmarks there are no rows.
        """
        id_type = rows.schema["sample_id"].dataType.simpleString()
        empty = rows.sparkSession.createDataFrame([], f"sample_id {id_type}, block int, values array<double>")
        return reduce(DataFrame.unionByName, self._passes(rows, landmarks) or [empty])

    def features(self, rows: DataFrame, landmarks: DataFrame) -> DataFrame:
        """One array per sample: its kernel with every landmark, in landmark order; empty without landmarks."""
        passes = self._passes(rows, landmarks)
        if not passes:
            return rows.select("sample_id", F.array().cast("array<double>").alias("features"))
        if len(passes) == 1:
            return passes[0].select("sample_id", F.col("values").alias("features"))
        parts = reduce(DataFrame.unionByName, passes).groupBy("sample_id").agg(
            F.array_sort(F.collect_list(F.struct("block", "values"))).alias("_b")
        )
        return parts.select("sample_id", F.flatten(F.transform("_b", lambda b: b["values"])).alias("features"))


def landmark_table(rows: DataFrame, order: str = "sample_id") -> DataFrame:
    """Number the landmark rows ``(sample_id, features ARRAY)``."""
    return with_row_index(rows, [order], name="landmark_ix").select("landmark_ix", "features")


@dataclass(frozen=True)
class FittedKernelClassifier:
    kernel: Kernel
    landmarks: DataFrame
    inner: FittedClassifier

    @property
    def weights(self) -> np.ndarray:
        return self.inner.weights

    def transform(self, rows: DataFrame) -> DataFrame:
        plain = rows.withColumn("features", vector_to_array("features"))
        mapped = self.kernel.features(plain, self.landmarks).withColumn("features", array_to_vector("features"))
        scored = self.inner.transform(mapped).drop("features")
        return rows.join(scored, "sample_id")


@dataclass(frozen=True)
class KernelLogisticSpec(Spec):
    """Logistic regression on the kernel with the named landmarks, a table as in :meth:`Kernel.blocks`.

    The model has one weight per landmark, which ``pyspark.ml`` keeps as one dense vector.
    """

    landmarks: DataFrame
    C: float = 1.0
    kind: object = "rbf"
    gamma: float | None = None
    degree: float = 3
    coef0: float = 1.0
    penalty: str = "l2"
    max_iter: int = 100
    tol: float = 1e-6

    def fit(self, rows: DataFrame, n: int | None = None) -> FittedKernelClassifier:
        n = rows.count() if n is None else n
        plain = rows.withColumn("features", vector_to_array("features"))
        kernel = Kernel(self.kind, self.gamma, self.degree, self.coef0)
        mapped = kernel.features(plain, self.landmarks).withColumn("features", array_to_vector("features"))
        train = cut(plain.select("sample_id", "label").join(mapped, "sample_id"), "gram")
        inner = LogisticSpec(self.C, self.penalty, max_iter=self.max_iter, tol=self.tol).fit(train, n)
        return FittedKernelClassifier(kernel, self.landmarks, inner)


def kernel_probability(mapped: DataFrame, weights: list[float], intercept: float) -> DataFrame:
    """Decision value, class-1 probability and class from given kernel weights."""
    decision = dot(F.col("features"), F.array(*[F.lit(float(w)) for w in weights])) + intercept
    return (
        mapped.withColumn("decision", decision)
        .withColumn("p1", logistic(F.col("decision")))
        .withColumn("prediction", (F.col("decision") > 0).cast("int"))
    )


# -- M10 --------------------------------------------------------------------------------


@dataclass(frozen=True)
class FittedRegressor:
    model: object
    weights: np.ndarray
    intercept: float

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).select(*rows.columns, "prediction")


@dataclass(frozen=True)
class RegressionSpec(Spec):
    """Plain, ridge or lasso regression with the penalty ``alpha`` of the usual solvers."""

    kind: str = "ridge"
    alpha: float = 1.0
    max_iter: int = 1000
    tol: float = 1e-12

    def fit(self, rows: DataFrame, n: int | None = None) -> FittedRegressor:
        if self.kind not in ("plain", "ridge", "lasso"):
            raise ValueError("kind is 'plain', 'ridge' or 'lasso'")
        strength = 0.0
        if self.kind == "lasso":
            strength = self.alpha
        elif self.kind == "ridge":  # Spark scales the label by its deviation first
            n, spread = rows.agg(F.count("*"), F.stddev_samp("label")).first()
            strength = self.alpha * spread / n
        model = LinearRegression(
            regParam=strength,
            elasticNetParam=1.0 if self.kind == "lasso" else 0.0,
            standardization=False,
            solver="l-bfgs",  # the others stop at 4,096 variables
            maxIter=self.max_iter,
            tol=self.tol,
        ).fit(rows)
        return FittedRegressor(model, model.coefficients.toArray(), model.intercept)


# -- principal components (F10) and the mesh over them (M12) ----------------------------


@dataclass(frozen=True)
class Components:
    """Centre, loadings and the two fitted stages."""

    centre: object
    pca: object

    @property
    def mean(self) -> np.ndarray:
        return self.centre.mean.toArray()

    @property
    def loadings(self) -> np.ndarray:
        return self.pca.pc.toArray()

    def transform(self, rows: DataFrame) -> DataFrame:
        out = self.pca.transform(self.centre.transform(rows))
        return out.drop("features", "_centred").withColumnRenamed("_pc", "features")


def fit_components(train: DataFrame, k: int) -> Components:
    """Principal components of the training rows.

    ``pyspark.ml`` gathers a genes-by-genes matrix on the driver, so this is for selected
    genes, a few thousand at most; with more use ``riskloom.operators.components``.
    """
    centre = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_centred").fit(train)
    pca = PCA(k=k, inputCol="_centred", outputCol="_pc").fit(centre.transform(train))
    return Components(centre, pca)


def component_mesh(
    rows: DataFrame, i: int, j: int, n_components: int, step: float, fixed: float = 0.0, margin: float = 0.5
) -> DataFrame:
    """Points over components i and j from min-0.5 to max+0.5; the others stay at ``fixed``.

    ``rows`` holds component scores as ``features``.  Point numbers are split by arithmetic,
    so the mesh is one range and no product of two tables.
    """
    scores = vector_to_array("features")
    spark = rows.sparkSession
    low_i, high_i, low_j, high_j = rows.agg(
        F.min(scores[i]), F.max(scores[i]), F.min(scores[j]), F.max(scores[j])
    ).first()
    n_i = ceil((high_i - low_i + 2 * margin) / step)
    n_j = ceil((high_j - low_j + 2 * margin) / step)
    points = spark.range(n_i * n_j)
    at_i = F.lit(low_i - margin) + F.floor(F.col("id") / n_j) * step
    at_j = F.lit(low_j - margin) + (F.col("id") % n_j) * step
    place = [at_i if c == i else at_j if c == j else F.lit(float(fixed)) for c in range(n_components)]
    return points.select(F.col("id").alias("point"), F.array(*place).alias("scores"))


def back_to_genes(points: DataFrame, loadings: np.ndarray, mean: np.ndarray) -> DataFrame:
    """Inverse of the component transform: adds ``features`` in gene order."""

    def value(weights: np.ndarray, centre: float) -> Column:
        return dot(F.col("scores"), F.array(*[F.lit(float(w)) for w in weights])) + float(centre)

    genes = F.array(*[value(loadings[g], mean[g]) for g in range(loadings.shape[0])])
    return points.withColumn("features", array_to_vector(genes))

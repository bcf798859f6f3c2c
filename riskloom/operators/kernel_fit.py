"""Kernel logistic regression on all training samples, for two or more classes.

A fit on the kernel with every training sample has as many weights as samples.  Here the samples that
span the kernel are found by pivoted incomplete Cholesky: with the chosen ones S, ``K`` is close to
``K[:, S] K[S, S]^-1 K[S, :]``, and the ridge penalty on one weight per sample becomes one on as many
weights as there are chosen samples.  Rows are never shuffled, copied or paired.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.operators.models import Kernel, Spec, _kernel_matrix
from riskloom.runtime import cut

#: Candidates that a pass over the rows brings to the driver, and samples multiplied at once in a task.
CANDIDATES, ROWS_AT_ONCE = 64, 1024


def _values(kernel: Kernel, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _kernel_matrix(kernel.kind, x, y, kernel.gamma, kernel.degree, kernel.coef0)


def _of_itself(kernel: Kernel, x: np.ndarray) -> np.ndarray:
    return np.array([_values(kernel, r[None, :], r[None, :])[0, 0] for r in x])


def _parts(frames):
    """Samples of a task in bounded pieces: (ids, matrix)."""
    for frame in frames:
        for at in range(0, len(frame), ROWS_AT_ONCE):
            part = frame.iloc[at : at + ROWS_AT_ONCE]
            yield part, np.stack(part["features"]).astype(float)


def spanning_samples(rows: DataFrame, kernel: Kernel, error: float = 1e-8) -> np.ndarray:
    """The features of the samples that span the kernel of ``(sample_id, features ARRAY)``.

    No sample's kernel with itself is missed by more than ``error`` times the largest such value.  A pass
    measures what the chosen samples leave of every sample; each task names its ``CANDIDATES`` worst, of
    which the driver takes the worst of all, one after another.  Passes end by themselves: each takes at
    least one sample while any is above the bound.  The driver and every task hold the chosen samples and
    their triangle, so memory follows the rank of the kernel at this error, not the rows.  The kernel has
    to be positive semidefinite (linear, rbf, poly with coef0 >= 0); an indefinite one raises an error.
    An empty table gives no samples.
    """
    chosen, inverse, largest = None, None, None
    while True:

        def worst(frames, chosen=chosen, inverse=inverse):
            found = []
            for part, x in _parts(frames):
                own = _of_itself(kernel, x)
                left = own if chosen is None else own - ((_values(kernel, x, chosen) @ inverse.T) ** 2).sum(1)
                found.append(pd.DataFrame({"sample_id": part["sample_id"], "features": list(x), "own": own, "rest": left}))
                found = [pd.concat(found).nlargest(CANDIDATES, "rest")]
            yield from found

        kind = rows.schema["sample_id"].dataType.simpleString()
        named = rows.select("sample_id", "features").mapInPandas(worst, f"sample_id {kind}, features array<double>, own double, rest double")
        top = named.orderBy(F.desc("rest"), "sample_id").limit(CANDIDATES).toPandas()
        if top.empty:
            return np.empty((0, 0))
        if largest is None:  # the kernel of the worst of all samples, nothing chosen yet
            largest = top["own"].max()
        if top["rest"].min() < -1e-6 * largest:
            raise ValueError("the kernel is not positive semidefinite; name its landmarks instead")
        if not top["rest"].max() > error * largest:
            return np.empty((0, 0)) if chosen is None else chosen
        x = np.stack(top["features"])
        rest = _values(kernel, x, x)
        if chosen is not None:
            part = _values(kernel, x, chosen) @ inverse.T
            rest = rest - part @ part.T
        taken = []
        while True:  # pivoted Cholesky among the candidates
            at = int(np.argmax(np.diag(rest)))
            if not rest[at, at] > error * largest or len(taken) == len(x):
                break
            taken.append(at)
            rest = rest - np.outer(rest[:, at], rest[at]) / rest[at, at]
        chosen = x[taken] if chosen is None else np.concatenate([chosen, x[taken]])
        inverse = _whitener(_values(kernel, chosen, chosen))


def _whitener(gram: np.ndarray) -> np.ndarray:
    """W with W gram W^T = 1."""
    return np.linalg.inv(np.linalg.cholesky(gram + 1e-14 * np.trace(gram) / len(gram) * np.eye(len(gram))))


@dataclass(frozen=True)
class FittedKernelModel:
    """One score per class (one in all for two classes) from the kernel with the chosen samples."""

    kernel: Kernel
    chosen: np.ndarray
    weights: np.ndarray  # chosen samples by scores
    intercepts: np.ndarray

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds ``probabilities`` (array by class), ``decision`` and ``prediction``; with two classes also ``p1``."""
        kernel, chosen, weights, intercepts = self.kernel, self.chosen, self.weights, self.intercepts

        @F.pandas_udf("array<double>")
        def scores(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            out = [_values(kernel, np.stack(features.iloc[a : a + ROWS_AT_ONCE]), chosen) @ weights + intercepts for a in range(0, len(features), ROWS_AT_ONCE)]
            return pd.Series(list(np.concatenate(out)))

        scored = rows.withColumn("_scores", scores(vector_to_array("features")))
        if len(intercepts) == 1:
            return with_classes(scored.withColumn("_scores", F.array(F.lit(0.0), F.col("_scores")[0])), "_scores", rows.columns)
        return with_classes(scored, "_scores", rows.columns)


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores, safe for large ones."""
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda a, v: a + v))


def with_classes(rows: DataFrame, scores: str, keep: list[str]) -> DataFrame:
    """Probabilities, decision value and class from an array of one score per class.

    Of two classes the decision is the second score less the first and class 1 needs it above 0; of
    several it is the largest score, and the first class that has it is taken.
    """
    s = F.col(scores)
    several = F.size(s) > 2
    return rows.select(
        *keep,
        softmax(s).alias("probabilities"),
        F.when(several, F.array_max(s)).otherwise(s[1] - s[0]).alias("decision"),
        F.when(several, F.array_position(s, F.array_max(s)) - 1).otherwise((s[1] > s[0]).cast("long")).cast("int").alias("prediction"),
    ).withColumn("p1", F.when(F.size("probabilities") == 2, F.col("probabilities")[1]))


@dataclass(frozen=True)
class FittedSoftmax:
    """Weights (classes by features) and intercepts on the features themselves."""

    weights: np.ndarray
    intercepts: np.ndarray

    def transform(self, rows: DataFrame) -> DataFrame:
        weights, intercepts = self.weights, self.intercepts

        @F.pandas_udf("array<double>")
        def scores(features: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(features) @ weights.T + intercepts) if len(features) else [], dtype=object)

        return with_classes(rows.withColumn("_scores", scores(vector_to_array("features"))), "_scores", rows.columns)


@dataclass(frozen=True)
class SoftmaxSpec(Spec):
    """Multinomial logistic regression: labels 0, 1, 2 ..., ridge penalty of strength 1/C on all weights but the intercepts."""

    C: float = 1.0
    max_iter: int = 200
    tol: float = 1e-9

    def fit(self, rows: DataFrame, n: int | None = None) -> FittedSoftmax:
        if self.C <= 0 or self.max_iter < 0 or self.tol < 0:
            raise ValueError("C must be positive, max_iter and tol not negative")
        n = rows.count() if n is None else n
        solver = LogisticRegression(regParam=1.0 / (self.C * n), standardization=False, family="multinomial", maxIter=self.max_iter, tol=self.tol)
        model = solver.fit(rows)
        return FittedSoftmax(model.coefficientMatrix.toArray(), model.interceptVector.toArray())


def softmax_weights(train: DataFrame, width: int, classes: int, strength: float, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by scores) and intercepts for ``(label, features ARRAY)``, ridge on the weights as they are.

    ``pyspark.ml`` scales features to one deviation first, which makes the tiny last directions of a kernel
    dominate.  Here limited-memory steps ask for the loss and its gradient, one pass over the rows each; the
    driver holds some twenty vectors of weights.  Two classes have one score.  An error if not converged.
    """
    free = 1 if classes <= 2 else classes
    size = (width + 1) * free

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        table = w.reshape(width + 1, free)

        def part(frames):
            total, slope = 0.0, np.zeros((width + 1, free))
            for p, x in _parts(frames):
                s = x @ table[:-1] + table[-1]
                s = np.hstack([np.zeros((len(s), 1)), s]) if free == 1 else s
                s = s - s.max(1, keepdims=True)
                e = np.exp(s)
                of, y = e.sum(1), p["label"].to_numpy().astype(int)
                total += float((np.log(of) - s[np.arange(len(s)), y]).sum())
                r = e / of[:, None]
                r[np.arange(len(s)), y] -= 1
                r = r[:, -free:]
                slope[:-1] += x.T @ r
                slope[-1] += r.sum(0)
            yield pd.DataFrame({"sums": [np.append(slope.ravel(), total)]})

        sums = train.mapInPandas(part, "sums array<double>").select(F.posexplode("sums").alias("place", "v"))
        found = sums.groupBy("place").agg(F.sum("v").alias("v")).toPandas().sort_values("place")["v"].to_numpy()
        ridge = np.concatenate([table[:-1].ravel() * strength, np.zeros(free)])
        return found[-1] + 0.5 * float(ridge @ w), found[:-1] + ridge

    w = np.zeros(size)
    value, slope = loss(w)
    bound, past = tol * max(1.0, np.abs(slope).max()), []
    for _ in range(max_iter):
        if np.abs(slope).max() <= bound:
            table = w.reshape(width + 1, free)
            return table[:-1], table[-1]
        q, used = slope.copy(), []
        for ds, dg in reversed(past):
            used.append((ds @ q) / (ds @ dg))
            q -= used[-1] * dg
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(1.0, np.abs(slope).sum())
        for (ds, dg), u in zip(past, reversed(used)):
            q += ds * (u - (dg @ q) / (ds @ dg))
        step = 1.0
        while True:
            new, new_slope = loss(w - step * q)
            if new <= value - 1e-4 * step * float(q @ slope) + 1e-13 * abs(value) or step < 1e-10:
                break
            step /= 2
        ds, dg = -step * q, new_slope - slope
        if ds @ dg > 0:
            past = [*past, (ds, dg)][-10:]
        w, value, slope = w + ds, new, new_slope
    raise RuntimeError(f"not converged after {max_iter} steps: slope {np.abs(slope).max():.3g} above {bound:.3g}")


@dataclass(frozen=True)
class KernelOfAllSpec(Spec):
    """Kernel logistic regression against all training samples, two classes or more.

    ``error`` is that of :func:`spanning_samples`.  The optimum is that of one ridge weight per training
    sample under the approximated kernel, which equals the exact one within the error.
    """

    C: float = 1.0
    kind: object = "rbf"
    gamma: float | None = None
    degree: float = 3
    coef0: float = 1.0
    error: float = 1e-8
    max_iter: int = 200
    tol: float = 1e-7

    def fit(self, rows: DataFrame, n: int | None = None) -> FittedKernelModel:
        if self.C <= 0 or self.error <= 0:
            raise ValueError("C and error must be positive")
        kernel = Kernel(self.kind, self.gamma, self.degree, self.coef0)
        plain = cut(rows.select("sample_id", "label", vector_to_array("features").alias("features")), "samples")
        chosen = spanning_samples(plain, kernel, self.error)
        if not len(chosen):
            raise ValueError("no samples, or a kernel that is 0 everywhere")
        white = _whitener(_values(kernel, chosen, chosen))

        def whitened(part: pd.DataFrame, x: np.ndarray) -> np.ndarray:
            return _values(kernel, x, chosen) @ white.T

        def squares(frames):
            total = sum(((z.T @ z) for z in (whitened(p, x) for p, x in _parts(frames))), np.zeros((len(chosen),) * 2))
            yield pd.DataFrame({"place": np.arange(len(chosen)), "line": list(total)})

        # sums per task are added place by place, so the driver gets one matrix of the rank
        lines = plain.mapInPandas(squares, "place int, line array<double>").select("place", F.posexplode("line").alias("col", "v"))
        cells = lines.groupBy("place", "col").agg(F.sum("v").alias("v")).toPandas()
        gram = np.zeros((len(chosen),) * 2)
        gram[cells["place"], cells["col"]] = cells["v"]
        # K = Z Z^T for whitened rows Z; a weight per sample a gives scores Z (Z^T a), least |a| for given Z^T a
        # has |a|^2 = u^T (Z^T Z)^-1 u, so u = R g with R R^T = Z^T Z turns the penalty into |g|^2
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        root = vectors * np.sqrt(np.maximum(values, 0))

        def mapped(frames):
            for p, x in _parts(frames):
                yield pd.DataFrame({"label": p["label"], "features": list(whitened(p, x) @ root)})

        train = cut(plain.mapInPandas(mapped, "label double, features array<double>"), "whitened")
        least, largest = train.agg(F.min("label"), F.max("label")).first()
        if least < 0:
            raise ValueError("labels are 0, 1, 2 ...")
        weights, intercepts = softmax_weights(train, len(chosen), int(largest) + 1, 1.0 / self.C, self.max_iter, self.tol)
        return FittedKernelModel(kernel, chosen, white.T @ root @ weights, intercepts)

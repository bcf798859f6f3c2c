"""Kernel fits on all training samples against the full kernel in numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import kernel_fit as KF
from riskloom.operators.models import Kernel, _kernel_matrix


def rows_of(spark, x, y):
    data = [(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "sample_id long, x array<double>, label double").select("sample_id", array_to_vector("x").alias("features"), "label")


def softmax_fit(k, y, classes, strength, steps=60):
    """Newton on all weights of one column per sample; one score per class, intercepts free."""
    n = len(k)
    z = np.hstack([k, np.ones((n, 1))])
    d = z.shape[1]
    w, target = np.zeros((classes, d)), np.eye(classes)[y]
    ridge = np.r_[np.full(n, strength), 0.0]
    for _ in range(steps):
        s = z @ w.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - target).T @ z + ridge * w).ravel()
        h = np.zeros((classes * d,) * 2)
        for a in range(classes):
            for b in range(classes):
                v = p[:, a] * ((a == b) - p[:, b])
                h[a * d : (a + 1) * d, b * d : (b + 1) * d] = z.T @ (v[:, None] * z)
            h[a * d : (a + 1) * d, a * d : (a + 1) * d] += np.diag(ridge)
        w -= (np.linalg.pinv(h, rcond=1e-13) @ g).reshape(w.shape)
    return p


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    y = (np.abs(x[:, 0]) + 0.3 * rng.normal(size=60) > 0.8).astype(int)
    x[50:] = x[0]  # repeated samples add nothing to the kernel's rank
    return x, y, np.where(x[:, 1] > 0.5, 2, y)


def test_all_samples_three_classes(spark, samples):
    x, _, y = samples
    model = KF.KernelOfAllSpec(C=0.5, kind="rbf", gamma=0.3, error=1e-10).fit(rows_of(spark, x, y))
    assert len(model.chosen) <= 51
    got = model.transform(rows_of(spark, x, y)).orderBy("sample_id").toPandas()
    want = softmax_fit(_kernel_matrix("rbf", x, x, 0.3, 3, 1.0), y, 3, 2.0)
    assert np.abs(np.stack(got.probabilities) - want).max() < 1e-4
    assert (got.prediction == want.argmax(1)).all() and got.p1.isna().all()


def test_all_samples_two_classes(spark, samples):
    x, y, _ = samples
    model = KF.KernelOfAllSpec(C=0.5, kind="poly", gamma=0.5, degree=2, coef0=1.0, error=1e-10).fit(rows_of(spark, x, y))
    assert len(model.chosen) == 10  # all products of up to two of three values
    got = model.transform(rows_of(spark, x, y)).orderBy("sample_id").toPandas()
    k = _kernel_matrix("poly", x, x, 0.5, 2, 1.0)
    z, w = np.hstack([k, np.ones((60, 1))]), np.zeros(61)
    ridge = np.r_[np.full(60, 2.0), 0.0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ ((p * (1 - p))[:, None] * z) + np.diag(ridge), z.T @ (p - y) + ridge * w)
    assert np.abs(got.p1 - p).max() < 1e-4
    assert (got.prediction == (got.decision > 0)).all()


def test_more_samples_than_one_pass_names(spark, monkeypatch):
    monkeypatch.setattr(KF, "CANDIDATES", 4)
    x = np.random.default_rng(6).normal(size=(40, 12))
    rows = rows_of(spark, x, np.zeros(40)).select("sample_id", vector_to_array("features").alias("features"))
    chosen = KF.spanning_samples(rows, Kernel("linear"))
    k, cross, core = x @ x.T, x @ chosen.T, chosen @ chosen.T
    assert len(chosen) == 12 and np.allclose(cross @ np.linalg.solve(core, cross.T), k)
    assert len(KF.spanning_samples(rows.where("false"), Kernel("linear"))) == 0
    with pytest.raises(ValueError):
        KF.spanning_samples(rows, Kernel(lambda a, b: -(a @ b.T)))


def test_classes_of_scores(spark):
    rows = spark.createDataFrame([(1, [0.0, 800.0]), (2, [3.0, 3.0]), (3, [1.0, 2.0, 2.0]), (4, [-900.0, -901.0, -902.0])], "sample_id long, s array<double>")
    got = {r.sample_id: r for r in KF.with_classes(rows, "s", ["sample_id"]).collect()}
    assert [got[i].prediction for i in (1, 2, 3, 4)] == [1, 0, 1, 0]
    assert got[1].p1 == 1.0 and got[2].p1 == 0.5 and got[3].p1 is None and abs(sum(got[4].probabilities) - 1) < 1e-12

"""Many logistic fits at once against one fit at a time."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.operators import batch, folds as E, metrics as H, search as G
from riskloom.operators.models import LogisticSpec
from riskloom.operators.selection import select_by_peeling, threshold_curve


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(90, 6)) * [1, 2, 1, 0.5, 1, 1]
    y = (x @ [1, -0.5, 0, 2, 0, 0] + draw.normal(size=90) > 0.2).astype(float)
    rows = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(90)], "sample_id int, features array<double>, label double")
    rows = rows.withColumn("features", array_to_vector("features")).repartition(5)
    labels = rows.select("sample_id", F.col("label").cast("int").alias("y"))
    return x, y, E.attach_splits(rows, E.k_fold(rows.select("sample_id"), 3)).cache(), labels


SPECS = [
    LogisticSpec(C=0.5), LogisticSpec(C=0.05, penalty="l1"), LogisticSpec(C=2.0, fit_intercept=False),
    LogisticSpec(C=0.3, penalise_intercept=True), LogisticSpec(C=1.0, penalty="l1", penalise_intercept=True),
]


@pytest.mark.parametrize("width", [128, 1])
def test_equal_to_single_fits(data, monkeypatch, width):
    """With curvature and without; a group of few fits; weights and scores."""
    monkeypatch.setattr(batch, "FULL_WIDTH", width)
    monkeypatch.setattr(batch, "GROUP_BYTES", 3000)
    monkeypatch.setattr(batch, "BLOCK_BYTES", 500)
    _, _, rows, _ = data
    design = batch.pack(rows, range(3))
    fits = [batch.Fit(s, split) for s in SPECS for split in range(3)]
    weights = batch.solve(design, fits)
    metrics = {"loss": H.log_loss, "auc": H.auc, "accuracy": H.accuracy}
    found = batch.scores(design, fits, weights, metrics, train=True)
    for f, w, s in list(zip(fits, weights, found))[::4]:
        train, test = E.sides(rows, f.split)
        alone = f.spec.with_params(tol=1e-13, max_iter=500).fit(train)
        assert np.allclose(w[:-1], alone.weights, atol=2e-5) and abs(w[-1] - alone.intercept) < 2e-5
        for side, part in ((False, test), (True, train)):
            want = G.scores_of(alone, part, metrics)[None]
            assert all(abs(s[side][m] - want[m]) < 1e-4 for m in metrics)


def test_masks_sizes_and_labels(data, spark):
    x, y, rows, _ = data
    mask = np.array([True, False, True, True, False, False])
    other = 1 - y
    turned = rows.withColumn("_labels", F.array("label", 1 - F.col("label"))).withColumn("_places", F.create_map(F.lit(0), F.col("sample_id").cast("long")))
    design = batch.pack(turned, [0], labels="_labels", places="_places")
    spec = LogisticSpec(C=0.7)
    got = batch.solve(design, [batch.Fit(spec, 0, genes=mask), batch.Fit(spec, 0, labels=1), batch.Fit(spec, 0, size=70)])
    train = np.array([r["sample_id"] for r in E.sides(rows, 0)[0].select("sample_id").collect()])

    def newton(x, y):
        x, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
        pen = np.append(np.full(len(w) - 1, 1 / 0.7), 0)
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (p - y) + pen * w)
        return w

    masked = newton(x[train][:, mask], y[train])
    assert np.allclose(got[0][:-1][mask], masked[:-1]) and not got[0][:-1][~mask].any()
    assert np.allclose(got[1], newton(x[train], other[train]))
    first = train[train < 70]
    assert np.allclose(got[2], newton(x[first], y[first]))


def test_passes_follow_steps_not_fits(data, monkeypatch):
    _, _, rows, labels = data
    passes = []
    evaluate = batch._evaluate
    monkeypatch.setattr(batch, "_evaluate", lambda *a: passes.append(len(a[1])) or evaluate(*a))
    G.fit_and_score(LogisticSpec(), [{"C": c} for c in np.logspace(-3, 1, 12)], rows, range(3))
    assert len(passes) < 15 and passes[0] == 36
    passes.clear()
    G.permutation_test(LogisticSpec(), rows, range(3), labels, H.accuracy, 9)
    assert len(passes) < 15 and passes[0] == 30
    passes.clear()
    G.learning_curve(LogisticSpec(), rows, range(3), [0.3, 0.6, 1.0], H.log_loss)
    assert len(passes) < 15 and passes[0] == 9


class OneByOne(LogisticSpec):
    """Not known to the batch, so that the plain paths run."""


def test_at_once_and_one_by_one(spark, data, monkeypatch):
    _, _, rows, labels = data
    index = spark.createDataFrame([(f"g{i}", i) for i in range(6)], "gene_id string, gene_ix long")
    frequency = spark.createDataFrame([(f"g{i}", i / 6) for i in range(6)], "gene_id string, frequency double")
    spec = LogisticSpec(C=0.5, tol=1e-12, max_iter=500)

    def results():
        curve = G.learning_curve(spec, rows, range(3), [0.5, 1.0], H.log_loss).collect()
        by_gene = threshold_curve(spec, rows, range(3), frequency, index, [0.0, 0.4, 0.9]).collect()
        peeled = select_by_peeling(LogisticSpec(C=0.2, penalty="l1", tol=1e-12, max_iter=500), rows.select("sample_id", "features", "label"), index, 5).collect()
        test = G.permutation_test(spec, rows, range(3), labels, H.log_loss, 2, seed=5)
        key = lambda r: tuple(r[:2])
        numbers = [v for r in sorted(map(tuple, curve), key=key) for v in r] + [v for r in sorted((r["place"], r["mean"], r["variance"]) for r in by_gene) for v in r]
        return np.array([*numbers, test[0], *test[1]]), sorted(r[0] for r in peeled)

    at_once, genes = results()
    import riskloom.operators.search as search_module
    import riskloom.operators.selection as selection_module

    for module in (search_module, selection_module):
        monkeypatch.setattr(module, "LogisticSpec", OneByOne)
    one_by_one, same_genes = results()
    assert np.allclose(at_once, one_by_one, atol=1e-4) and genes == same_genes and genes

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.functions.vectors import assemble, gene_index
from riskloom.operators import metrics as H
from riskloom.operators import models as M
from riskloom.operators import selection as S
from riskloom.operators.search import scores_of


def model_rows(spark, x, y):
    return spark.createDataFrame(
        [(i, Vectors.dense(r), float(v)) for i, (r, v) in enumerate(zip(x, y))], ["sample_id", "features", "label"]
    ).cache()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4))
    y = (x @ np.array([1.5, -1.0, 0.4, 0.0]) + rng.normal(size=120) > 0).astype(float)
    return x, y, model_rows(spark, x, y)


def gradient(x, y, w):
    return x.T @ (1 / (1 + np.exp(-x @ w)) - y)


def test_l2_optimality(data):
    x, y, rows = data
    fitted = M.LogisticSpec(C=0.7, fit_intercept=False, tol=1e-12).fit(rows)
    assert np.abs(gradient(x, y, fitted.weights) + fitted.weights / 0.7).max() < 1e-4


def test_l1_optimality(data):
    x, y, rows = data
    w = M.LogisticSpec(C=0.08, penalty="l1", fit_intercept=False, tol=1e-12).fit(rows).weights
    g = gradient(x, y, w)
    assert (w == 0).any() and (w != 0).any()
    assert np.abs(g[w != 0] + np.sign(w[w != 0]) / 0.08).max() < 1e-3
    assert np.abs(g[w == 0]).max() <= 1 / 0.08 + 1e-6


def test_penalised_intercept(data):
    x, y, rows = data
    fitted = M.LogisticSpec(C=0.05, penalise_intercept=True, tol=1e-12).fit(rows)
    wide = np.c_[x, np.ones(len(x))]
    w = np.append(fitted.weights, fitted.intercept)
    assert np.abs(gradient(wide, y, w) + w / 0.05).max() < 1e-4
    p = {r["sample_id"]: r["p1"] for r in fitted.transform(rows).collect()}
    assert np.allclose([p[i] for i in range(len(x))], 1 / (1 + np.exp(-wide @ w)), atol=1e-9)


def test_negative_settings_are_refused(data):
    for bad in ({"C": -1.0}, {"C": 0.0}, {"max_iter": -1}, {"tol": -1.0}, {"penalty": "l3"}):
        with pytest.raises(ValueError):
            M.LogisticSpec(**bad).fit(data[2])


@pytest.mark.parametrize("kind", ["linear", "poly", "rbf", "sigmoid"])
def test_kernel_over_several_blocks(spark, data, kind, monkeypatch):
    x, _, rows = data
    monkeypatch.setattr(M, "LANDMARK_BYTES", 50 * 8 * x.shape[1])
    monkeypatch.setattr(M, "VALUE_BYTES", 7 * 8 * 50)
    plain = rows.select("sample_id", vector_to_array("features").alias("features"))
    blocks = M.Kernel(kind).blocks(plain, M.landmark_table(plain))
    assert blocks.count() == len(x) * -(-len(x) // 50)
    got = M.Kernel(kind, coef0=0.5).features(plain, M.landmark_table(plain)).orderBy("sample_id").toPandas()
    assert np.allclose(np.stack(got["features"]), M._kernel_matrix(kind, x, x, None, 3, 0.5))


def test_kernel_moves_no_samples(data):
    """Samples are multiplied where they are; without landmarks they have no values."""
    rows = data[2].select("sample_id", vector_to_array("features").alias("features"))
    marks = M.landmark_table(rows)
    plan = M.Kernel("rbf").features(rows, marks)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Exchange" not in plan
    none = marks.where("landmark_ix < 0")
    assert M.Kernel("rbf").blocks(rows, none).count() == 0
    assert {len(r["features"]) for r in M.Kernel("rbf").features(rows, none).collect()} == {0}


def test_kernel_logistic_on_all_training_rows(data):
    x, y, rows = data
    marks = M.landmark_table(rows.select("sample_id", vector_to_array("features").alias("features")))
    fitted = M.KernelLogisticSpec(marks, C=1.0, kind="rbf", gamma=0.5, tol=1e-9).fit(rows)
    out = fitted.transform(rows).toPandas()
    assert len(fitted.weights) == 120
    assert (out.prediction == (out.decision > 0)).all()
    assert (out.prediction == out.label).mean() > 0.8


def test_regressions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3)) * [1, 3, 0.5]
    y = x @ [2.0, -1.0, 0.0] + rng.normal(size=80) + 4
    rows = model_rows(spark, x, y)
    xc, yc = x - x.mean(0), y - y.mean()
    ridge = M.RegressionSpec("ridge", alpha=5.0).fit(rows)
    assert np.allclose(ridge.weights, np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ yc), atol=1e-8)
    plain = M.RegressionSpec("plain").fit(rows)
    assert np.allclose(plain.weights, np.linalg.lstsq(xc, yc, rcond=None)[0], atol=1e-8)
    lasso = M.RegressionSpec("lasso", alpha=0.3).fit(rows)
    g = xc.T @ (xc @ lasso.weights - yc) / 80
    on = lasso.weights != 0
    assert np.abs(g[on] + 0.3 * np.sign(lasso.weights[on])).max() < 1e-4 and np.abs(g[~on]).max(initial=0) <= 0.3 + 1e-6


def test_ridge_of_more_variables_than_a_normal_matrix_holds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 4_200))
    y = rng.normal(size=30)
    ridge = M.RegressionSpec("ridge", alpha=5.0).fit(model_rows(spark, x, y))
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(ridge.weights, xc.T @ np.linalg.solve(xc @ xc.T + 5 * np.eye(30), yc), atol=1e-5)


def test_components(spark, data):
    x, _, rows = data
    parts = M.fit_components(rows, 2)
    scores = parts.transform(rows).orderBy("sample_id").toPandas()
    assert np.allclose(np.stack(scores.features.map(lambda v: v.toArray())), (x - x.mean(0)) @ parts.loadings)


def test_mesh(spark, data):
    x, _, rows = data
    parts = M.fit_components(rows, 3)
    mesh = M.component_mesh(parts.transform(rows), 0, 2, 3, 0.5, fixed=0.25).toPandas()
    grid = np.stack(mesh.scores)
    t = (x - x.mean(0)) @ parts.loadings
    assert set(grid[:, 1]) == {0.25}
    assert len(set(grid[:, 0])) == len(np.arange(t[:, 0].min() - 0.5, t[:, 0].max() + 0.5, 0.5))
    assert len(grid) == len(set(map(tuple, grid)))


def test_assemble(spark):
    expr = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "sample_id int, gene_id string, value double")
    index = gene_index(expr)
    filled = {r["sample_id"]: r["features"] for r in assemble(expr, index, fill_missing=True).collect()}
    assert filled == {1: [1.0, 2.0], 2: [3.0, 0.0]}
    with pytest.raises(Exception, match="lacks some"):
        assemble(expr, index).collect()


def frequency(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "gene_id int, frequency double")


def test_participation_choice(spark):
    f = frequency(spark, [0.0, 0.2, 0.6, 1.0])
    curve = spark.createDataFrame([(0, 0.1, 0.4), (1, 0.5, 0.3), (2, 0.9, 0.3)], "place int, threshold double, loss double")
    best = S.chosen_threshold(curve).first()[0]
    assert best == 0.5
    assert sorted(r["gene_id"] for r in f.where(F.col("frequency") > best).collect()) == [2, 3]
    assert S.usable_thresholds(f, [0.1, 0.5, 1.0, 0.2]) == [0.1, 0.5]


def test_keep_above_kth(spark):
    f = frequency(spark, [0.9, 0.7, 0.7, 0.5, 0.1])
    assert [r["gene_id"] for r in S.above_kth(f, 2).collect()] == [0]
    assert [r["gene_id"] for r in S.top_by_participation(f, 2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        S.above_kth(f, 5)


def test_malus(spark):
    f = frequency(spark, [0.45, 0.451, 0.9])
    curve = spark.createDataFrame([(k / 10, abs(k - 5) / 10.0) for k in range(11)], "threshold double, loss double")
    assert sorted(r["gene_id"] for r in S.select_by_smoothed_curve(f, curve, window=3).collect()) == [1, 2]


def test_peeling_stops(spark, data):
    x, y, rows = data
    index = spark.createDataFrame([(f"g{i}", i) for i in range(4)], "gene_id string, gene_ix long")
    spec = M.LogisticSpec(C=1.0, penalty="l1")
    whole = sorted(r[0] for r in S.select_by_peeling(spec, rows, index, 100).collect())
    assert "g0" in whole and "g1" not in whole  # a gene with a negative weight is never taken
    assert S.select_by_peeling(spec, rows, index, 1).count() == 0  # the first batch would pass the limit
    assert S.select_by_peeling(spec, rows, index, 1, passthrough=True).count() == 4


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (0, 0.9, 1), (0, 0.1, 0), (1, 0.0, 0)], "y int, p double, c int")
    got = H.score(df, {"a": H.accuracy, "p": H.precision, "r": H.recall}, "y", "c").first()
    assert tuple(got) == (0.5, 0.5, 0.5)
    want = -np.mean(np.log([0.9, 0.1, 0.9, 1e-15]))
    assert H.score(df, {"l": H.log_loss}, "y", "p").first()[0] == pytest.approx(want)
    assert H.roc_auc(df, "y", "p").first()[0] == pytest.approx(0.375)
    assert H.roc_auc(df.where("y = 1"), "y", "p").first()[0] is None


def test_metrics_say_what_they_read(spark, data):
    rows = data[2]
    fitted = M.LogisticSpec().fit(rows)
    metrics = {
        "accuracy": H.accuracy, "wrapped": H.Metric("class", lambda y, p: H.accuracy(y, p)), "auc": H.auc, "log_loss": H.log_loss,
    }
    side = F.col("sample_id") % 3 == 0
    whole, sides = scores_of(fitted, rows, metrics)[None], scores_of(fitted, rows, metrics, side)
    scored = fitted.transform(rows).toPandas()
    for got, part in ((whole, scored), (sides[True], scored[scored.sample_id % 3 == 0]), (sides[False], scored[scored.sample_id % 3 != 0])):
        hits, misses = part.p1[part.label == 1].to_numpy(), part.p1[part.label == 0].to_numpy()
        won = (hits[:, None] > misses).mean() + (hits[:, None] == misses).mean() / 2
        assert got["accuracy"] == got["wrapped"] == pytest.approx((part.prediction == part.label).mean())
        assert got["auc"] == pytest.approx(won)
    with pytest.raises(TypeError):
        scores_of(fitted, rows, {"plain": lambda y, p: H.accuracy(y, p)})
    with pytest.raises(ValueError):
        H.Metric("score", H.accuracy.column)

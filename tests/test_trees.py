"""Forests and boosted trees against plain recursion."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from riskloom.operators import trees as T


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(9)
    x = np.round(draw.normal(size=(80, 5)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3) ^ (draw.random(80) < 0.1)).astype(float)
    rows = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(80)], "sample_id int, features array<double>, label double")
    return x, y, rows.withColumn("features", array_to_vector("features")).repartition(3)


def plain_tree(x, g, h, depth, rules, scale):
    """Value of every row, by recursion over all thresholds."""
    out = np.full(len(g), scale * rules.weight(g.sum(), h.sum()))
    best = (1e-12, None)
    if depth != 0:
        for gene in range(x.shape[1]):
            for t in np.unique(x[:, gene]):
                left = x[:, gene] <= t
                gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
                if hl <= 0 or hr <= 1e-9 or min(hl, hr) < rules.least_curvature:
                    continue
                gain = (rules.score(gl, hl) + rules.score(gr, hr) - rules.score(g.sum(), h.sum())) / 2 - rules.gamma
                if gain > best[0] + 1e-12:
                    best = (gain, left)
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = plain_tree(x[side], g[side], h[side], depth - 1, rules, scale)
    return out


def values(out, column="p1"):
    return np.array([r[column] for r in out.orderBy("sample_id").collect()])


def test_one_tree(data):
    x, y, rows = data
    for depth in (0, 1, 3):
        got = values(T.ForestSpec(depth, 1, "all", bootstrap=False, max_bins=500).fit(rows).transform(rows))
        assert np.allclose(got, plain_tree(x, -y, np.ones(80), depth, T._Rules(), 1.0))


def test_full_grown_tree_is_pure(data, monkeypatch):
    x, y, rows = data
    monkeypatch.setattr(T, "HISTOGRAM_BYTES", 16 * 5 * 60 * 3)  # three nodes a pass
    monkeypatch.setattr(T, "GENES_PER_SUM", 2)
    fitted = T.ForestSpec(None, 1, "all", bootstrap=False, max_bins=500).fit(rows)
    groups = {}
    for row, label in zip(map(tuple, x), y):
        groups.setdefault(row, []).append(label)
    assert np.allclose(values(fitted.transform(rows)), [np.mean(groups[tuple(r)]) for r in x])
    assert abs(fitted.weights.sum() - 1) < 1e-12


def test_forest(data):
    x, y, rows = data
    spec = T.ForestSpec(None, 12, "sqrt", seed=3)
    fitted = spec.fit(rows)
    out = fitted.transform(rows)
    p1 = values(out)
    assert ((p1 >= 0) & (p1 <= 1)).all() and ((p1 > 0.5) == y).mean() > 0.9
    assert np.allclose(p1, values(spec.fit(rows.repartition(7)).transform(rows)))  # the same wherever rows lie
    assert any(len(t.gene) > 2 * 2**4 for t in fitted.trees)


def test_bootstrap_counts():
    draws = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 40_000)
    one, two = T.bootstrap_counts(draws, 1, 0), T.bootstrap_counts(draws, 1, 1)
    assert abs(one.mean() - 1) < 0.03 and abs(one.var() - 1) < 0.05 and abs(np.corrcoef(one, two)[0, 1]) < 0.03
    assert (T.bootstrap_counts(draws, 1, 0) == one).all()


def test_boosting_with_penalties(data):
    x, y, rows = data
    rules = T._Rules(0.2, 1.5, 0.01, 0.5)
    spec = T.BoostedSpec(2, 0.4, 4, alpha=0.2, reg_lambda=1.5, gamma=0.01, min_child_weight=0.5, max_bins=500)
    margin = np.zeros(80)
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + plain_tree(x, p - y, p * (1 - p), 2, rules, 0.4)
    assert np.allclose(values(spec.fit(rows).transform(rows), "decision"), margin, atol=1e-9)


def test_bins(data, spark):
    _, _, rows = data
    edges = T.bin_edges(rows, 4)
    assert len(edges) == 5 and all(len(e) == 4 for e in edges)
    with pytest.raises(ValueError):
        T.ForestSpec(max_bins=1).fit(rows)
    with pytest.raises(ValueError):
        T.ForestSpec().fit(rows.where("false"))

"""Queries over all genes that have no SQL, against numpy."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_DIR
from tests.oracle import compare, duck

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def samples():
    ids, x, label = zip(*duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF_DIR}/embeddings.parquet' ORDER BY vec_id").fetchall())
    return np.array(ids), 10 * np.array(x, dtype=float), (np.array(label) >= 5).astype(float)


@pytest.fixture(scope="module")
def components(samples):
    ids, x, _ = samples
    train = x[ids % 4 != 0]
    mean = train.mean(axis=0)
    loadings = np.linalg.svd(train - mean, full_matrices=False)[2][:5].T
    return mean, loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), range(5)])


@pytest.mark.parametrize("name", ["m01_logistic_l2_no_intercept", "m02_logistic_l1_all_genes"])
def test_weights_of_all_genes(spark, name):
    assert {r["gene_id"] for r in QUERIES[name](spark, SF_DIR).collect()} == set(range(64))
    assert compare(QUERIES[name](spark, SF_DIR), duck(SF_DIR), entry.oracle_sql()[name]) is None


def test_scores_of_all_genes(spark, samples, components):
    ids, x, _ = samples
    got = {r["sample_id"]: r["scores"] for r in QUERIES["f10_components_of_all_genes"](spark, SF_DIR).collect()}
    mean, loadings = components
    assert np.abs(np.abs([got[i] for i in ids]) - np.abs((x - mean) @ loadings)).max() < 1e-6


def test_mesh_of_all_genes(spark, samples, components):
    _, x, y = samples
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps, ridge penalty 1
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + w)
    mean, loadings = components[0], components[1][:, :2]
    scores = (x - mean) @ loadings
    low, high = scores.min(axis=0) - 0.5, scores.max(axis=0) + 0.5
    n = np.ceil((high - low) / 0.25).astype(int)
    rows = sorted(QUERIES["m12_component_mesh_all_genes"](spark, SF_DIR).collect())
    assert [r["point"] for r in rows] == list(range(n[0] * n[1]))
    at = low + 0.25 * np.stack(np.divmod(np.arange(n[0] * n[1]), n[1]), axis=1)
    assert np.abs(np.array([(r["at_1"], r["at_2"]) for r in rows]) - at).max() < 1e-3
    want = 1 / (1 + np.exp(-(mean + at @ loadings.T) @ w))
    assert np.abs(np.array([r["p1"] for r in rows]) - want).max() < 2e-3

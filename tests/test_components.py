"""Components of many genes against numpy."""

import numpy as np
import pytest

from riskloom.operators import components as C
from tests.conftest import SF_DIR


def long_table(spark, x, parts=3):
    cells = [(i, f"g{g:04d}", float(x[i, g])) for i in range(x.shape[0]) for g in range(x.shape[1])]
    return spark.createDataFrame(cells, "sample_id int, gene_id string, value double").repartition(parts)


def loadings(found):
    return found.loadings.toPandas().pivot(index="gene_id", columns="component", values="loading").to_numpy()


def vectors(x, k):
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return v[:k].T, s[:k] ** 2


def off_by(got, want):
    return np.abs(np.abs(got) - np.abs(want)).max()


@pytest.mark.parametrize("folder", [SF_DIR, "/root/testdata/sf0.01"])
def test_given_measurements(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    x = np.array([r[0] for r in table.orderBy("vec_id").select("embedding").collect()], dtype=float)
    expr = table.selectExpr("vec_id AS sample_id", "posexplode(embedding) AS (gene_id, value)").selectExpr("sample_id", "gene_id", "CAST(value AS DOUBLE) AS value")
    found = C.fit_gene_components(expr, 2)
    want, values = vectors(x, 2)
    assert off_by(loadings(found), want) < 1e-6 and np.allclose(found.eigenvalues, values)


def test_many_tiles_restarts_and_transform(spark, monkeypatch):
    """More genes than samples, several tiles each way, a small search space, and rows the fit has not seen."""
    monkeypatch.setattr(C, "GENES_PER_TILE", 32)
    monkeypatch.setattr(C, "SAMPLES_PER_TILE", 16)
    monkeypatch.setattr(C, "MOST_COLUMNS", 20)
    draw = np.random.default_rng(6)
    x = draw.normal(size=(50, 90)) + 100 + sum(c * np.outer(draw.normal(size=50), draw.normal(size=90)) for c in (3, 2))
    found = C.fit_gene_components(long_table(spark, x[:40]), 2, extra=3)
    want, _ = vectors(x[:40], 2)
    got = loadings(found)
    assert off_by(got, want) < 1e-7
    scores = found.transform(long_table(spark, x[40:])).orderBy("sample_id").toPandas()
    assert np.allclose(np.stack(scores.features), (x[40:] - x[:40].mean(0)) @ got)


def test_missing_values_count_as_the_mean(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(30, 5)) * [5, 3, 2, 1, 1]
    holes = draw.random(x.shape) < 0.1
    cells = [(i, f"g{g:04d}", None if holes[i, g] else float(x[i, g])) for i in range(30) for g in range(5)]
    found = C.fit_gene_components(spark.createDataFrame(cells, "sample_id int, gene_id string, value double"), 1)
    filled = np.where(holes, np.nan, x)
    filled = np.where(holes, np.nanmean(filled, axis=0), filled)
    assert off_by(loadings(found), vectors(filled, 1)[0]) < 1e-7


def test_what_has_no_direction_is_an_error(spark):
    same = long_table(spark, np.vstack([np.eye(4), -np.eye(4)]))
    with pytest.raises(RuntimeError, match="not determined"):
        C.fit_gene_components(same, 2, max_rounds=5)
    draw = np.random.default_rng(2)
    slow = long_table(spark, draw.normal(size=(60, 40)))
    with pytest.raises(RuntimeError, match="not determined"):
        C.fit_gene_components(slow, 1, extra=0, max_rounds=3)
    with pytest.raises(ValueError, match="only 4 genes"):
        C.fit_gene_components(same, 5)


def test_only_factors_are_exchanged(spark):
    tiles = C._Tiles(long_table(spark, np.random.default_rng(0).normal(size=(20, 6))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        factor = spark.createDataFrame([(0, np.ones(6).tobytes())], "block long, v binary")
        plan = tiles._product(factor, 1, True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        tiles.drop()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "Bucketed: true" in scan and plan.count("Exchange hashpartitioning(_tile") == 1 and "hashpartitioning(tile" not in plan

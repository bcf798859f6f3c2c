import numpy as np
import pytest

from riskloom.operators import describe as D


def series(spark, values):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double")


def reference_smooth(x, w, shape):
    kernel = {"flat": np.ones, "hanning": np.hanning, "hamming": np.hamming, "bartlett": np.bartlett, "blackman": np.blackman}[shape](w)
    half = w // 2
    padded = np.pad(x, half, mode="reflect")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


@pytest.mark.parametrize("shape", D.WINDOW_SHAPES)
@pytest.mark.parametrize("block", [8, 65_536])
def test_smooth(spark, shape, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", block)
    x = np.random.default_rng(1).random(90)
    got = D.smooth(series(spark, x), ["k"], "v", 7, shape).orderBy("i").toPandas().smoothed
    assert np.allclose(got, reference_smooth(x, 7, shape))


def test_smooth_edges(spark):
    four, three = (
        [r["smoothed"] for r in D.smooth(series(spark, [3, 1, 2, 7, 5]), ["k"], "v", w, "flat").orderBy("i").collect()] for w in (4, 3)
    )
    assert four == three
    assert [r["smoothed"] for r in D.smooth(series(spark, [3, 1]), ["k"], "v", 2).orderBy("i").collect()] == [3, 1]
    with pytest.raises(ValueError):
        D.smooth(series(spark, [1, 2, 3]), ["k"], "v", 5)
    with pytest.raises(ValueError):
        D.smooth(series(spark, [1, 2, 3]), ["k"], "v", 3, "round")
    same_length = D.smooth(series(spark, [1, 2, 3]), ["k"], "v", 3, "flat").orderBy("i").collect()
    assert np.allclose([r["smoothed"] for r in same_length], [5 / 3, 2, 7 / 3])


@pytest.mark.parametrize("block", [4, 65_536])
def test_moving_average(spark, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", block)
    got = D.moving_average(series(spark, [1, 2, 3, 4]), ["k"], "v", 1).orderBy("i").collect()
    assert [r["average"] for r in got] == [1, 1.5, 2.5, 3.5]
    x = np.arange(50.0) ** 2
    got = D.moving_average(series(spark, x), ["k"], "v", 4).orderBy("i").collect()
    assert np.allclose([r["average"] for r in got], [x[max(0, i - 4) : i + 4].mean() for i in range(50)])


def test_histogram(spark):
    bars = D.histogram(series(spark, [0, 1, 2, 13]), "v").orderBy("bin").collect()
    assert [r["n"] for r in bars] == [1, 1, 1] + [0] * 9 + [1]
    assert sum(r["n"] for r in D.histogram(series(spark, [4, 4]), "v").collect()) == 2


def test_genes_above_lists_empty_thresholds(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 0.8)], "gene_id string, importance double")
    got = {r["threshold"]: r["n_genes"] for r in D.genes_above(df, [0.0, 0.2, 0.9]).collect()}
    assert got == {0.0: 2, 0.2: 1, 0.9: 0}

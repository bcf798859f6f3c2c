"""Choosing genes by model weights, by their share of fits, and by loss curves.

Model rows are ``(sample_id, features, label)`` with features in the order of a gene index
``(gene_id, gene_ix)``; the index is what turns vector places back into genes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.operators import batch
from riskloom.operators import metrics as M
from riskloom.operators.describe import participation, smooth
from riskloom.operators.folds import sides
from riskloom.operators.models import LogisticSpec
from riskloom.operators.search import fit_and_score
from riskloom.runtime import cut


def weight_table(fitted, index: DataFrame) -> DataFrame:
    """Weights of a fitted model by gene: ``(gene_id, value)``."""
    one = index.sparkSession.createDataFrame([(fitted.weights.tolist(),)], "w array<double>")
    weights = one.select(F.posexplode("w").alias("gene_ix", "value"))
    return index.join(weights, "gene_ix").select("gene_id", "value")


def slice_genes(rows: DataFrame, places: Sequence[int]) -> DataFrame:
    """Rows whose vectors keep only the named places; the long table is not read again."""
    slicer = VectorSlicer(inputCol="features", outputCol="_kept", indices=list(places))
    return slicer.transform(rows).drop("features").withColumnRenamed("_kept", "features")


# -- F1, F2, F8 -------------------------------------------------------------------------


def chosen_by_sign(weights: DataFrame, sign: str = "positive", passthrough: bool = False) -> DataFrame:
    """Genes with a weight above 0 (``positive``) or other than 0 (``nonzero``), or all genes."""
    if passthrough:
        return weights.select("gene_id")
    if sign not in ("positive", "nonzero"):
        raise ValueError("sign is 'positive' or 'nonzero'")
    return weights.where(F.col("value") > 0 if sign == "positive" else F.col("value") != 0).select("gene_id")


def select_by_model(spec, rows: DataFrame, index: DataFrame, sign: str = "positive", passthrough: bool = False) -> DataFrame:
    """Fit an L1 model, or a ``TunedSpec`` of one, and keep genes by the sign of their weight."""
    if passthrough:
        return index.select("gene_id")
    return chosen_by_sign(weight_table(spec.fit(rows), index), sign)


def select_by_peeling(spec, rows: DataFrame, index: DataFrame, n_limit: int, passthrough: bool = False) -> DataFrame:
    """Fit on the genes not yet kept, keep the positive ones, repeat up to ``n_limit`` genes.

    The batch that would pass the limit is not added.  A round without a positive gene
    ends the loop, since every later round would be the same fit.
    """
    if passthrough:
        return index.select("gene_id")
    everywhere = rows.select("features", "label", F.lit(None).cast("array<int>").alias("test_in"), F.lit(None).cast("array<int>").alias("train_in"))
    design = batch.pack(everywhere, [0]) if isinstance(spec, LogisticSpec) else None
    n = rows.count() if design is None else 0
    left = np.ones(index.count() if design is None else design.genes, dtype=bool)
    while left.any():
        if design is None:
            weights = np.zeros(len(left))
            weights[left] = spec.fit(slice_genes(rows, np.flatnonzero(left).tolist()), n).weights
        else:  # genes are masked in one packed design
            weights = batch.solve(design, [batch.Fit(spec, 0, genes=left)])[0][:-1]
        positive = weights > 0
        if not positive.any() or int((~left).sum() + positive.sum()) > n_limit:
            break
        left &= ~positive
    if design is not None:
        design.drop()
    kept = index.sparkSession.createDataFrame([((~left).tolist(),)], "kept array<boolean>")
    chosen = kept.select(F.posexplode("kept").alias("gene_ix", "_kept")).where("_kept")
    return index.join(chosen, "gene_ix", "left_semi").select("gene_id")


# -- F3..F5, F11 ------------------------------------------------------------------------


def repeated_fits(
    spec, rows: DataFrame, split_ids: Sequence[int], index: DataFrame, metrics=None, parallelism: int = 8
) -> DataFrame:
    """Weights and test metrics of one fit per split: ``(fit_id, kind, name, value)``."""
    models: dict = {}
    log = fit_and_score(spec, [{}], rows, split_ids, metrics, parallelism=parallelism, keep_models=models)
    found = log.select(F.col("split_id").alias("fit_id"), F.lit("metrics").alias("kind"), F.col("metric").alias("name"), F.col("test_score").alias("value"))
    fits = index.sparkSession.createDataFrame([(split, m.weights.tolist()) for (_, split), m in models.items()], "fit_id int, w array<double>")
    weights = fits.select("fit_id", F.posexplode("w").alias("gene_ix", "value"))  # genes unfold on the executors
    by_gene = weights.join(index, "gene_ix").select(
        "fit_id", F.lit("weight").alias("kind"), F.col("gene_id").cast("string").alias("name"), "value"
    )
    return found.unionByName(by_gene)


def frequency_of(fit_stats: DataFrame) -> DataFrame:
    """Share of fits in which a gene's weight is not 0: ``(gene_id, frequency)``."""
    return participation(fit_stats.where("kind = 'weight'").withColumnRenamed("name", "gene_id"))


def chosen_threshold(losses: DataFrame) -> DataFrame:
    """The threshold of the lowest mean loss among ``(place, threshold, loss)``, first on ties."""
    return losses.agg(F.min_by("threshold", F.struct("loss", "place")).alias("threshold"))


def usable_thresholds(frequency: DataFrame, grid: Sequence[float]) -> list[float]:
    """The grid up to the first threshold that no gene passes."""
    top = frequency.agg(F.max("frequency")).first()[0]
    out = []
    for g in grid:
        if top is None or not top > g:
            break
        out.append(g)
    return out


def threshold_curve(
    spec, rows: DataFrame, split_ids: Sequence[int], frequency: DataFrame, index: DataFrame,
    grid: Sequence[float], metrics=None,
) -> DataFrame:
    """Mean and population variance of every metric per threshold: ``(place, threshold, metric, mean, variance)``."""
    metrics = metrics or {"loss": M.log_loss}
    placed = index.join(frequency, index["gene_id"].cast("string") == frequency["gene_id"].cast("string")).select(
        "gene_ix", "frequency"
    )
    usable = usable_thresholds(frequency, grid)
    if not usable:
        raise ValueError("no gene passes the first threshold")
    if isinstance(spec, LogisticSpec):
        logs = [_curve_at_once(spec.checked(), rows, [int(s) for s in split_ids], placed, usable, metrics)]
        usable = []
    else:
        by_place, logs = placed.collect(), []
    for k, g in enumerate(usable):
        places = sorted(r["gene_ix"] for r in by_place if r["frequency"] > g)
        log = fit_and_score(spec, [{}], slice_genes(rows, places), split_ids, metrics)
        logs.append(log.select(F.lit(k).alias("place"), F.lit(float(g)).alias("threshold"), "metric", "test_score"))
    return (
        reduce(DataFrame.unionByName, logs)
        .groupBy("place", "threshold", "metric")
        .agg(F.avg("test_score").alias("mean"), F.var_pop("test_score").alias("variance"))
    )


def _curve_at_once(spec, rows: DataFrame, split_ids: Sequence[int], placed: DataFrame, grid: Sequence[float], metrics) -> DataFrame:
    """Scores of every threshold and split; a threshold is a mask of genes, and all fits share the passes.

    The masks are worked out in Spark, as a bitmap per threshold: one bit per weight that the fits hold anyway.
    """
    design = batch.pack(rows, split_ids)
    bits = [F.sum(F.when(F.col("frequency") > float(g), F.expr("shiftleft(1L, CAST(gene_ix % 62 AS INT))")).otherwise(0)).alias(f"m{k}") for k, g in enumerate(grid)]
    words = placed.groupBy(F.floor(F.col("gene_ix") / 62).cast("int").alias("word")).agg(*bits).collect()
    fits = []
    for k in range(len(grid)):
        mask = np.zeros((max(r["word"] for r in words) + 1) * 62, dtype=bool)
        for r in words:
            mask[62 * r["word"] : 62 * r["word"] + 62] = (int(r[f"m{k}"]) >> np.arange(62)) & 1
        mask = np.append(mask, np.zeros(max(0, design.genes - len(mask)), dtype=bool))[: design.genes]
        fits += [batch.Fit(spec, split, genes=mask) for split in split_ids]
    found = batch.scores(design, fits, batch.solve(design, fits), metrics)
    design.drop()
    lines = []
    for i, s in enumerate(found):
        lines += [(i // len(split_ids), float(grid[i // len(split_ids)]), name, value) for name, value in s[False].items()]
    return rows.sparkSession.createDataFrame(lines, "place int, threshold double, metric string, test_score double")


def select_by_participation(
    spec_frequency, spec_score, rows: DataFrame, frequency_splits: Sequence[int], score_splits: Sequence[int],
    index: DataFrame, grid: Sequence[float], score_rows: DataFrame | None = None, metric: M.Metric = M.log_loss,
) -> DataFrame:
    """Genes whose share of fits passes the threshold that a second model likes best."""
    frequency = cut(frequency_of(repeated_fits(spec_frequency, rows, frequency_splits, index)), "frequency")
    curve = threshold_curve(
        spec_score, rows if score_rows is None else score_rows, score_splits, frequency, index, grid, {"loss": metric}
    )
    best = chosen_threshold(curve.withColumnRenamed("mean", "loss")).first()[0]
    return frequency.where(F.col("frequency") > best).select("gene_id")


def top_by_participation(frequency: DataFrame, n_keep: int) -> DataFrame:
    """The ``n_keep`` most frequent genes, first id on ties."""
    return frequency.orderBy(F.desc("frequency"), "gene_id").limit(n_keep).select("gene_id", "frequency")


# -- F6, F7 -----------------------------------------------------------------------------


def select_by_smoothed_curve(
    frequency: DataFrame, curve: DataFrame, malus: float = 0.05, window: int = 5, shape: str = "hanning"
) -> DataFrame:
    """Genes above the lowest point of the smoothed loss curve ``(threshold, loss)`` less ``malus``."""
    smoothed = smooth(curve, ["threshold"], "loss", window, shape)
    best = smoothed.agg(F.min_by("threshold", F.struct("smoothed", "i"))).first()[0]
    return frequency.where(F.col("frequency") > best - malus)


def above_kth(frequency: DataFrame, keep: int) -> DataFrame:
    """Genes strictly above the ``keep``-th largest frequency, counted from 0."""
    top = frequency.orderBy(F.desc("frequency"), "gene_id").limit(keep + 1)
    n, edge = top.agg(F.count("*"), F.min("frequency")).first()
    if n <= keep:
        raise ValueError(f"there are only {n} genes")
    return frequency.where(F.col("frequency") > edge)


# -- F9 ---------------------------------------------------------------------------------


def store_selection(selected: DataFrame, path: str, selector_key: str) -> None:
    """Write ``(split_id, gene_id)`` under the selector's key."""
    keyed = selected.withColumn("selector_key", F.lit(selector_key))
    keyed.write.mode("append").partitionBy("selector_key", "split_id").parquet(path)


def read_selection(spark: SparkSession, path: str, selector_key: str, split_id: int | None = None) -> DataFrame:
    """Read a selection; other keys and splits are not scanned."""
    rows = spark.read.parquet(path).where(F.col("selector_key") == selector_key)
    return rows if split_id is None else rows.where(F.col("split_id") == split_id)


def select_per_split(select, rows: DataFrame, split_ids: Sequence[int]) -> DataFrame:
    """Run ``select(train_rows)`` on the train side of every split: ``(split_id, gene_id)``."""
    parts = []
    for split in split_ids:
        train, _ = sides(rows, split)
        parts.append(select(train).select(F.lit(int(split)).alias("split_id"), "gene_id"))
    return reduce(DataFrame.unionByName, parts)
